"""Inverted lists, 8-bit codes, product quantization and re-ranking.

Centroids and codebooks are small tables: at most a few tens of thousands of
rows, checked before they are read to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectable import session
from vectable.functions import topk
from vectable.operators.search import search, top_ranked

NLIST, PQ_M, PQ_NBITS = 100, 8, 8  # fixed values: declared defaults
CANDIDATE_ROWS = 1_000_000
ASKED_ROWS = 50_000
MAX_CENTROID_BYTES = 256 * 1024 * 1024


def _require_small(centroids: DataFrame) -> None:
    """Centroids go to the driver and to every task: refuse what is too large for that."""
    held = centroids.agg(F.sum(F.size("centroid") * 8)).first()[0] or 0
    if held > MAX_CENTROID_BYTES:
        raise ValueError(f"{held} bytes of centroids; at most {MAX_CENTROID_BYTES}")


def _fitting(rows: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` elements; others are left out of lists, codes and training."""
    return rows.filter(F.col("vector").isNotNull() & (F.size("vector") == dim))


def _finite(matrix: np.ndarray) -> np.ndarray:
    return matrix[np.isfinite(matrix).all(axis=1)]


def _matrix(centroids: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a centroid table, ordered by key; size-checked."""
    _require_small(centroids)
    block = centroids.select(key, "centroid").toArrow()
    order = np.argsort(topk.keys(block.column(key)), kind="stable")
    return topk.keys(block.column(key))[order], topk.vectors(block.column("centroid"))[order]


def _start(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The usable vectors among the ``k`` rows of the smallest hash of (id, seed): the same on any cluster."""
    first = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).toArrow()
    return _finite(topk.vectors(first.column("vector"))) if first.num_rows else np.empty((0, 0))


def _training_rows(base: DataFrame) -> DataFrame:
    """(id, vector) of the commonest dimension, stored once: every round reads them."""
    dim = base.agg(F.mode(F.size("vector"), True)).first()[0] or 0
    return session.spread(session.stored(_fitting(base.select("id", "vector"), dim), "training"))


def train_lists(
    base: DataFrame, nlist: int = NLIST, seed: int = 0, iterations: int = 20, start: DataFrame | None = None
) -> DataFrame:
    """(list_id, centroid): k-means over all rows; nlist is clamped to the row count.

    Starts from the rows with the smallest hash of (id, seed), or from the
    centroids of ``start`` (list_id, centroid).
    """
    rows = _training_rows(base)
    first = _matrix(start, "list_id")[1] if start is not None else _start(rows, nlist, seed)
    words = _lloyd(rows, first[None], iterations) if len(first) else first[None]
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(words[0])]
    return base.sparkSession.createDataFrame(centers, "list_id int, centroid array<double>")


def assign_lists(base: DataFrame, centroids: DataFrame, metric: str = "L2") -> DataFrame:
    """``base`` with ``list_id``, its nearest centroid by ``metric``; ties go to the smaller id.

    Vectors of another dimension, with an element that is null or not finite,
    or (COSINE) without a direction, are in no list.
    """
    list_ids, matrix = _matrix(centroids, "list_id")

    @F.arrow_udf("int")
    def nearest_list(vector: pa.Array) -> pa.Array:
        rows = topk.vectors(vector)
        near = topk.nearest_one(rows, matrix) if metric == "L2" else topk.nearest(rows, matrix, 1, metric)[:, 0]
        return pa.array(list_ids[near], pa.int32(), mask=near < 0)

    rows = session.spread(_fitting(base, matrix.shape[1]))
    return rows.withColumn("list_id", nearest_list("vector")).filter(F.col("list_id").isNotNull())


def write_lists(lists: DataFrame, path: str) -> None:
    """Store rows partitioned by list, a hot list spread over several files."""
    lists.repartitionByRange(min(session.file_count(lists), 1_000_000), "list_id", "id").write.partitionBy("list_id").parquet(path)


def with_probes(queries: DataFrame, centroids: DataFrame, nprobe: int, metric: str = "L2") -> DataFrame:
    """``queries`` with ``keys``: the nprobe nearest list ids by ``metric``; none for queries that fit no list."""
    list_ids, matrix = _matrix(centroids, "list_id")

    @F.arrow_udf("array<int>")
    def probes(vector: pa.Array) -> pa.Array:
        near = topk.nearest(topk.vectors(vector), matrix, nprobe, metric)
        return pa.array([list_ids[row[row >= 0]].tolist() for row in near], pa.list_(pa.int32()))

    return _fitting(queries, matrix.shape[1]).withColumn("keys", probes("vector"))


def _probe(lists, centroids, queries, k, nprobe, metric, stored, decode=None, **options):
    base = lists.select("id", F.col(stored).alias("vector"), F.col("list_id").alias("key"))
    asked = with_probes(queries, centroids, nprobe, metric)
    return search(base, asked, k, metric, keyed=True, decode=decode, **options)


def ivf_search(
    lists: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int,
    metric: str = "L2", **options,
) -> DataFrame:
    """Exact scores inside the nprobe nearest lists of every query."""
    return _probe(lists, centroids, queries, k, nprobe, metric, "vector", **options)


# -- 8-bit codes -------------------------------------------------------------


def sq8_bounds(base: DataFrame) -> DataFrame:
    """(pos, lo, hi): smallest and largest value of every dimension."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = hi = None
        for batch in batches:
            if batch.num_rows:
                rows = _finite(topk.vectors(batch.column(0)))
                if not len(rows):
                    continue
                low, high = rows.min(0), rows.max(0)
                lo = low if lo is None else np.minimum(lo, low)
                hi = high if hi is None else np.maximum(hi, high)
        if lo is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(lo), dtype=np.int32)), pa.array(lo), pa.array(hi)],
                names=["pos", "lo", "hi"],
            )

    dim = base.agg(F.mode(F.size("vector"), True)).first()[0] or 0
    rows = session.spread(_fitting(base.select("vector"), dim))
    parts = rows.mapInArrow(extremes, "pos int, lo double, hi double")
    return parts.groupBy("pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _bounds_arrays(bounds: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = bounds.orderBy("pos").toArrow()
    return table.column("lo").to_numpy(), table.column("hi").to_numpy()


def sq8_encode(base: DataFrame, bounds: DataFrame) -> DataFrame:
    """``base`` with ``code`` (one byte per dimension) in place of ``vector``."""
    lo, hi = _bounds_arrays(bounds)
    span = np.where(hi > lo, hi - lo, 1.0)

    @F.arrow_udf("binary")
    def encoded(vector: pa.Array) -> pa.Array:
        rows = topk.vectors(vector)
        good = np.isfinite(rows).all(axis=1)
        steps = np.floor((np.where(good[:, None], rows, 0.0) - lo) / span * 255.0 + 0.5)
        return _codes(np.clip(steps, 0, 255).astype(np.uint8), good)

    rows = session.spread(_fitting(base, len(lo)))
    return rows.withColumn("code", encoded("vector")).drop("vector").filter(F.col("code").isNotNull())


def _codes(codes: np.ndarray, good: np.ndarray) -> pa.Array:
    """Binary column of the rows of ``codes``, cut from one buffer; null where a row is not ``good``."""
    width = codes.shape[1]
    offsets = np.arange(len(codes) + 1, dtype=np.int32) * width
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(codes))]
    whole = pa.Array.from_buffers(pa.binary(), len(codes), buffers)
    return whole if good.all() else pa.compute.if_else(pa.array(good), whole, None)


def _code_bytes(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0), np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.reshape(len(column), -1)


def ivf_sq8_search(
    lists: DataFrame, bounds: DataFrame, centroids: DataFrame, queries: DataFrame, k: int,
    nprobe: int, metric: str = "L2", **options,
) -> DataFrame:
    """Search the probed lists by their 8-bit codes."""
    lo, hi = _bounds_arrays(bounds)
    span = hi - lo

    def decode(column: pa.Array) -> np.ndarray:
        return lo + _code_bytes(column) / 255.0 * span

    return _probe(lists, centroids, queries, k, nprobe, metric, "code", decode, **options)


# -- product quantization ----------------------------------------------------


def _codebook_arrays(codebooks: DataFrame) -> np.ndarray:
    """Array (m, codes, sub-dimension) of a (sub, code, centroid) table."""
    _require_small(codebooks)
    table = codebooks.orderBy("sub", "code").select("sub", "centroid").toArrow()
    m = len(set(table.column("sub").to_pylist()))
    words = topk.vectors(table.column("centroid"))
    return words.reshape(m, -1, words.shape[1])


def _lloyd(rows: DataFrame, words: np.ndarray, iterations: int) -> np.ndarray:
    """Rounds of k-means of every sub-vector from ``words`` (sub, code, element), all in one pass per round.

    A codeword that wins no row keeps its place; means are rounded to nine digits.
    """
    m = words.shape[0]
    schema = "sub int, code int, total array<double>, n bigint"
    for _ in range(iterations):
        now = words

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(now.shape), np.zeros(now.shape[:2], np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                split = _finite(topk.vectors(batch.column(0)))
                split = split.reshape(len(split), m, -1)
                for s in range(m):
                    won = topk.nearest_one(split[:, s], now[s])
                    order = np.argsort(won, kind="stable")
                    used, first = np.unique(won[order], return_index=True)
                    if len(used):
                        total[s][used] += np.add.reduceat(split[order, s], first)
                    n[s] += np.bincount(won, minlength=now.shape[1])
            at = np.argwhere(n > 0)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(at[:, 0].astype(np.int32)),
                        pa.array(at[:, 1].astype(np.int32)),
                        pa.array(total[n > 0].tolist(), pa.list_(pa.float64())),
                        pa.array(n[n > 0]),
                    ],
                    names=["sub", "code", "total", "n"],
                )

        parts = rows.select("vector").mapInArrow(sums, schema)
        means = (
            parts.select("sub", "code", "n", F.posexplode("total").alias("pos", "value"))
            .groupBy("sub", "code", "pos")
            .agg((F.sum("value") / F.sum("n")).alias("mean"))
            .toArrow()
        )
        words = now.copy()
        at = [means.column(c).to_numpy() for c in ("sub", "code", "pos")]
        words[tuple(at)] = np.round(means.column("mean").to_numpy(), 9)
        if np.array_equal(words, now):
            break
    return words


def pq_train(
    base: DataFrame, m: int = PQ_M, nbits: int = PQ_NBITS, iterations: int = 10, seed: int = 0, start: DataFrame | None = None
) -> DataFrame:
    """(sub, code, centroid): k-means of every sub-vector.

    Starts from the rows with the smallest hash of (id, seed), or from the
    whole vectors of ``start`` (list_id, centroid).
    """
    rows = _training_rows(base)
    first = _matrix(start, "list_id")[1] if start is not None else _start(rows, 2**nbits, seed)
    if not len(first) or first.shape[1] % m:
        raise ValueError("m must divide the dimension of a non-empty table")
    words = _lloyd(rows, first.reshape(len(first), m, -1).transpose(1, 0, 2).copy(), iterations)
    out = [
        (s, c, [float(x) for x in words[s, c]])
        for s in range(words.shape[0])
        for c in range(words.shape[1])
    ]
    return base.sparkSession.createDataFrame(out, "sub int, code int, centroid array<double>")


def pq_encode(base: DataFrame, codebooks: DataFrame) -> DataFrame:
    """``base`` with ``code`` (m bytes) in place of ``vector``."""
    words = _codebook_arrays(codebooks)
    m = words.shape[0]
    if words.shape[1] > 256:
        raise ValueError("a code is one byte: at most 256 codewords per sub-vector")

    @F.arrow_udf("binary")
    def encoded(vector: pa.Array) -> pa.Array:
        split = topk.vectors(vector).reshape(len(vector), m, -1)
        won = np.stack([topk.nearest_one(split[:, s], words[s]) for s in range(m)], axis=1)
        return _codes(won.astype(np.uint8), (won >= 0).all(axis=1))

    rows = session.spread(_fitting(base, m * words.shape[2]))
    return rows.withColumn("code", encoded("vector")).drop("vector").filter(F.col("code").isNotNull())


def ivf_pq_search(
    lists: DataFrame, codebooks: DataFrame, centroids: DataFrame, queries: DataFrame, k: int,
    nprobe: int, metric: str = "L2", **options,
) -> DataFrame:
    """Search the probed lists by product codes (L2, COSINE, IP); the query side stays unquantized.

    Vectors are not rebuilt: each code byte is looked up in a table of its query.
    """
    kind = partial(topk.TableBest, words=_codebook_arrays(codebooks))
    return _probe(lists, centroids, queries, k, nprobe, metric, "code", _code_bytes, kind=kind, **options)


def rerank_search(
    lists: DataFrame, codebooks: DataFrame, centroids: DataFrame, queries: DataFrame, k: int,
    nprobe: int, refine: int = 4, raw: DataFrame | None = None, metric: str = "L2", **options,
) -> DataFrame:
    """Product-code candidates, k * refine of them, re-scored from ``raw`` vectors.

    Without ``raw`` the coded scores stand.
    """
    if raw is None:
        return ivf_pq_search(lists, codebooks, centroids, queries, k, nprobe, metric, **options)
    found = ivf_pq_search(lists, codebooks, centroids, queries, k * refine, nprobe, metric, **options)
    found = session.stored(found.select("query_id", "id"), "candidates")
    # Few candidates, and few asked vectors, go to the raw rows where these are read (both counted).
    asked = queries.select("query_id", F.col("vector").alias("asked")).filter(F.col("asked").isNotNull())
    pairs = raw.select("id", "vector").join(session.broadcast_checked(found, CANDIDATE_ROWS), "id")
    pairs = pairs.join(session.broadcast_checked(asked, ASKED_ROWS), "query_id").filter(F.size("vector") == F.size("asked"))

    @F.arrow_udf("double")
    def scored(a: pa.Array, b: pa.Array) -> pa.Array:
        score = np.round(topk.pair_scores(topk.vectors(a), topk.vectors(b), metric), topk.DIGITS) + 0.0
        return pa.array(score, pa.float64(), mask=~np.isfinite(score))

    pairs = pairs.select("query_id", "id", scored("asked", "vector").alias("score"))
    return top_ranked(pairs.filter(F.col("score").isNotNull()), k, metric)
