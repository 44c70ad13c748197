"""Exact k-nearest search of a table of queries in a table of vectors.

Two physical forms give the same rows:

* a query table of checked, bounded size is shipped to the tasks and the base
  table is streamed past it once, without a shuffle of the base;
* a larger query table meets the base in a grid of cells. Hot keys are split
  on both sides, so every cell holds a bounded number of rows.

Each task or cell emits at most k rows per query, before the only shuffle by
query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectable import session
from vectable.functions import topk

BASE_CELL_BYTES = 32 * 1024 * 1024
QUERY_CELL_BYTES = 16 * 1024 * 1024
FOUND_BYTES = 24  # query, id and score of a row that is kept
EMIT_ROWS = 100_000
MAX_LISTED_KEYS = 1000
TASKS_PER_CORE = 4
TASK_BYTES = 1024 * 1024 * 1024
MAX_TASKS = 100_000


def top_ranked(scored: DataFrame, k: int, metric: str) -> DataFrame:
    """(query_id, id, score, rank): the k best rows of each query."""
    best_first = F.col("score").asc() if topk.ASCENDING[metric] else F.col("score").desc()
    order = Window.partitionBy("query_id").orderBy(best_first, F.col("id").asc())
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "id", "score", "rank")
    )


def _result_schema(base: DataFrame, queries: DataFrame) -> str:
    qid, bid = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (base, "id")))
    return f"query_id {qid}, id {bid}, score double"


def _emit(best: topk.Best, query_ids: pa.Array, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    q, ids, score = best.rows()
    kept = ids if ids.dtype.kind in "iu" else ids.tolist()
    for at in range(0, max(len(q), 1), EMIT_ROWS):
        some = slice(at, at + EMIT_ROWS)
        yield pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(q[some])), pa.array(kept[some], id_type), pa.array(score[some])],
            names=["query_id", "id", "score"],
        )


def _stream_past(base, block: pa.Table, k, metric, decode, schema, keyed: bool, kind) -> DataFrame:
    """Base streamed past a query block that every task holds."""
    query_ids = block.column("query_id").combine_chunks()
    matrix = topk.vectors(block.column("vector"), metric in ("HAMMING", "JACCARD"))
    members: dict | None = None
    if keyed:
        members = {}
        for i, row in enumerate(block.column("keys").to_pylist()):
            for key in row:
                members.setdefault(key, []).append(i)
        members = {key: np.array(rows) for key, rows in members.items()}
        if len(members) <= MAX_LISTED_KEYS:
            base = base.filter(F.col("key").isin(list(members)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, id_type = kind(matrix, k, metric), None
        for batch in batches:
            if not batch.num_rows:
                continue
            id_type = batch.schema.field("id").type
            ids, rows = topk.keys(batch.column("id")), decode(batch.column("vector"))
            if members is None:
                best.offer(ids, rows)
            else:
                found = batch.column("key").dictionary_encode()
                codes = found.indices.to_numpy(zero_copy_only=False)
                runs = np.split(np.argsort(codes, kind="stable"), np.cumsum(np.bincount(codes))[:-1])
                for key, at in zip(found.dictionary.to_pylist(), runs):
                    if key in members:
                        best.offer(ids[at], rows[at], members[key])
            best.settle()
        if id_type is not None:
            yield from _emit(best, query_ids, id_type)

    columns = ["id", "vector"] + (["key"] if keyed else [])
    # Few long tasks rather than one per split, as each emits k rows per query; but
    # none of more than TASK_BYTES, however few cores the application has at its start.
    by_bytes = min(-(-session.estimated_bytes(base) // TASK_BYTES), MAX_TASKS)
    tasks = max(TASKS_PER_CORE * base.sparkSession.sparkContext.defaultParallelism, by_bytes)
    return base.select(*columns).coalesce(tasks).mapInArrow(scan, schema)


def _cells(base, queries, k, metric, decode, schema, dim: int, keyed: bool, kind) -> DataFrame:
    """Base and queries met in bounded cells (key, base part, query part)."""
    bits = metric in ("HAMMING", "JACCARD")
    base_rows = max(1, BASE_CELL_BYTES // (8 * dim))
    query_rows = max(1, QUERY_CELL_BYTES // (8 * dim + FOUND_BYTES * k))
    if keyed:
        queries = queries.withColumn("key", F.explode("keys"))
    else:
        base, queries = base.withColumn("key", F.lit(0)), queries.withColumn("key", F.lit(0))
    sizes = (
        base.groupBy("key").agg(F.count("*").alias("nb"))
        .join(queries.groupBy("key").agg(F.count("*").alias("nq")), "key")
        .select(
            "key",
            F.ceil(F.col("nb") / base_rows).alias("base_parts"),
            F.ceil(F.col("nq") / query_rows).alias("query_parts"),
        )
    )
    sizes = session.broadcast_checked(session.cut(sizes), 100_000)

    def part(id_col: str, parts: str) -> Column:
        return F.pmod(F.xxhash64(id_col), F.col(parts))

    def all_parts(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1))

    left = (
        base.join(sizes, "key")
        .withColumn("bp", part("id", "base_parts"))
        .withColumn("qp", all_parts("query_parts"))
        .select("key", "bp", "qp", "id", "vector")
    )
    right = (
        queries.join(sizes, "key")
        .withColumn("qp", part("query_id", "query_parts"))
        .withColumn("bp", all_parts("base_parts"))
        .select("key", "bp", "qp", "query_id", F.col("vector").alias("asked"))
    )

    def cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
        id_type = rows.schema.field("id").type
        block = asked.column("query_id").combine_chunks()
        matrix = topk.vectors(asked.column("asked"), bits) if asked.num_rows else np.empty((0, 0))
        best = kind(matrix, k, metric)
        if rows.num_rows and asked.num_rows:
            best.offer(topk.keys(rows.column("id")), decode(rows.column("vector")))
        return pa.Table.from_batches(_emit(best, block, id_type))

    grid = ["key", "bp", "qp"]
    return left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(cell, schema)


def search(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str,
    *,
    keyed: bool = False,
    repeated: bool = False,
    decode: Callable[[pa.Array], np.ndarray] | None = None,
    broadcast_bytes: int = session.BROADCAST_BYTES,
    kind: Callable[[np.ndarray, int, str], topk.Best] = topk.Best,
) -> DataFrame:
    """(query_id, id, score, rank) of the k best base rows of every query.

    ``base`` has ``id`` and ``vector`` (and ``key`` when ``keyed``); ``queries``
    has ``query_id`` and ``vector`` (and ``keys``, the array of keys it may
    look into). ``repeated`` says that an id may be stored under several keys.
    ``decode`` turns a stored base column into a matrix, which ``kind`` scores
    against a block of queries.
    """
    topk.check_metric(metric)
    bits = metric in ("HAMMING", "JACCARD")
    decode = decode or (lambda column: topk.vectors(column, bits))
    queries = queries.filter(F.col("vector").isNotNull())
    base = base.filter(F.col("vector").isNotNull())
    if bits:
        queries, base = (df.filter(~F.exists("vector", lambda x: x.isNull())) for df in (queries, base))
    # The dimension is that of most queries; other queries and rows take no part.
    dim_of_most = queries.agg(F.mode(F.size("vector"), True)).first()[0]
    if dim_of_most is not None:
        queries = queries.filter(F.size("vector") == dim_of_most)
        if isinstance(base.schema["vector"].dataType, T.ArrayType):
            base = base.filter(F.size("vector") == dim_of_most)
    shape = queries.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.size("keys") if keyed else F.lit(0)), F.lit(0)).alias("n_keys"),
    ).first()
    schema = _result_schema(base, queries)
    if not shape["n"] or k < 1:
        empty = base.sparkSession.createDataFrame([], schema)
        return top_ranked(empty, max(k, 1), metric)
    dim = dim_of_most * (64 if bits else 1)
    base = session.spread(base)
    # Every task holds the queries and, for each, the k rows kept.
    if shape["n"] * (dim * 8 + k * FOUND_BYTES) + shape["n_keys"] * 64 <= broadcast_bytes:
        columns = ["query_id", "vector"] + (["keys"] if keyed else [])
        block = queries.select(*columns).toArrow()
        scored = _stream_past(base, block, k, metric, decode, schema, keyed, kind)
    else:
        scored = _cells(base, queries, k, metric, decode, schema, dim, keyed, kind)
    if repeated:
        scored = scored.distinct()
    return top_ranked(scored, k, metric)
