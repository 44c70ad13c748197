"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectable.llm.registry import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each node in ``edges`` (a, b), longs without nulls.

    Each task first folds its own edges to a forest. Then rounds contract the
    graph: every node joins the neighbour of the least hash, if that is below
    its own, and edges are renamed and made distinct. Hashes change with the round, so that a
    constant share of the nodes goes each time, also on long chains. Each
    round's tables are written to the shared folder.
    """
    edges = written(edges.filter("a <> b").mapInArrow(_forest, "a bigint, b bigint").distinct(), "edges")
    total, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c, n=turn: F.xxhash64(F.lit(n), c)
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(order("b").alias("hash"), "b")).alias("best"))
        to = F.when(F.col("best.hash") < order("node"), F.col("best.b")).otherwise(F.col("node"))
        step = written(best.select("node", to.alias("to")), "step")
        step = step.join(step.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to"))
        step = written(step, "step")
        if total is None:
            total = step.withColumnRenamed("to", "root")
        else:
            moved = total.join(step.withColumnRenamed("node", "root"), "root", "left")
            total = written(moved.select("node", F.coalesce("to", "root").alias("root")), "total")
        renamed = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        renamed = renamed.join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        pair = renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b")
        edges = written(pair.distinct(), "edges")
        turn += 1
        if not edges.limit(1).count():
            break
    least = total.groupBy("root").agg(F.min("node").alias("least"))
    return written(total.join(least, "root").select("node", F.col("least").alias("root")), "components")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if find(x) != x]
        yield pa.RecordBatch.from_pydict({"a": pa.array(nodes, pa.int64()), "b": pa.array([find(x) for x in nodes], pa.int64())})
