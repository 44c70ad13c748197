"""Exact top-k by term-at-a-time accumulation.

Vectors are sparse rows of integer weights (term = component, zeros left out).
A task turns a block of candidates into postings per term; for each query its
terms are taken one after another and their weighted postings are added into a
dense score array over the block. A partition selection keeps the rows that
reach the k-th score; per query the best of all tasks are merged by a window
whose group limit cuts each task's rows before the shuffle.

The queries are worked on in blocks of about ``QUERY_ROWS``; every block meets
all candidates, which are read once a block and are never shuffled.

Results in odd cases: rows with a null id, and vectors that are null or hold null
or non-finite components, neither ask nor answer; missing components count as zero; rows that
repeat answer once each; of queries with the same id the smallest vector asks;
a query's own id never answers it; scores beyond a long are cut to its limits;
empty tables have no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS = 4096
BLOCK_ROWS = 8192
_SAFE = 2**62


def usable(vector: Column) -> Column:
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col("id").isNotNull() & vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def exact_top_k(base: DataFrame, queries: DataFrame, k: int, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` best of ``base`` (id, vector) for each of ``queries`` (id, vector).

    Weights are floor(scale * component), scores their integer inner products;
    order is by descending score, then by id.
    """
    context = base.sparkSession.sparkContext
    held = base.select("id", "vector").filter(usable(F.col("vector")))
    asked = queries.select("id", "vector").filter(usable(F.col("vector"))).groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = -(-asked.count() // QUERY_ROWS)
    if not blocks:
        return base.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")
    found = None
    for n in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).collect()
        block = context.broadcast(([r.id for r in rows], [r.vector for r in rows]))
        part = held.mapInArrow(_scorer(block, k, scale), "query_id bigint, id bigint, score bigint")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def weights(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * value) as int64, or as Python integers where these could overflow."""
    scaled = np.floor(np.asarray(values, np.float64) * scale)
    if not len(scaled) or np.abs(scaled).max() < 2**31:
        return scaled.astype(np.int64)
    return np.array([int(v) for v in scaled], object)


class Postings:
    """Weighted postings of a block of vectors: for each term the rows that hold it and their weights."""

    def __init__(self, offsets: np.ndarray, values: np.ndarray, scale: float):
        w = weights(values, scale)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        term = np.arange(len(values)) - offsets[row]
        kept = np.flatnonzero(w != 0)
        order = kept[np.argsort(term[kept], kind="stable")]
        cuts = np.searchsorted(term[order], np.arange((term.max() + 2) if len(term) else 1))
        self.rows = len(offsets) - 1
        self.lists = [(row[order[a:b]], w[order[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.peak = int(np.abs(w).max()) if len(w) else 0

    def scores(self, terms: list[tuple[int, int]]) -> np.ndarray:
        """Dense scores of all rows for one sparse query."""
        bound = self.peak * sum(abs(w) for _, w in terms)
        out = np.zeros(self.rows, np.int64 if bound < _SAFE else object)
        for term, weight in terms:
            if term < len(self.lists):
                at, held = self.lists[term]
                out[at] += held * weight
        return out if out.dtype != object else np.clip(out, 1 - 2**63, 2**63 - 1).astype(np.int64)


def _scorer(block, k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = block.value
        asked = []
        for name, vector in zip(names, vectors, strict=True):
            w = weights(np.array(vector, np.float64), scale)
            asked.append((name, [(int(t), int(w[t])) for t in np.flatnonzero(w != 0)]))
        best: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                lists = part.column("vector")
                offsets = lists.offsets.to_numpy().astype(np.int64)
                values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                postings = Postings(offsets - offsets[0], values, scale)
                for name, terms in asked:
                    got = _best(ids, postings.scores(terms), name, k)
                    best[name] = _merged(best[name], got, k) if name in best else got
        rows = [(name, *both) for name, both in best.items()]
        yield pa.RecordBatch.from_pydict(
            {
                "query_id": pa.array(np.concatenate([np.full(len(i), n, np.int64) for n, i, _ in rows] or [[]]), pa.int64()),
                "id": pa.array(np.concatenate([i for _, i, _ in rows] or [[]]), pa.int64()),
                "score": pa.array(np.concatenate([s for _, _, s in rows] or [[]]), pa.int64()),
            }
        )

    return run


def _best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best rows but ``own``, by partition selection at the k-th score."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        limit = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= limit]
    order = at[np.lexsort((ids[at], -scores[at]))][:k]
    return ids[order], scores[order]


def _merged(a, b, k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, scores = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]
