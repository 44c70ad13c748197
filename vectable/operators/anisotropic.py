"""Product codes for inner products: errors along the vector weigh more than errors across it.

For a query that lies near a vector, the error of its coded inner product comes
from the part of the residual along that vector. The loss of a code is the
squared residual plus (weight - 1) times its squared part along the vector (Guo
et al., 2020). Codes are chosen sub-vector by sub-vector, each given the others;
codewords are the least-squares answer of the rows that chose them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectable import session
from vectable.functions import topk
from vectable.operators import ivf

THRESHOLD = 0.2  # fixed value: cosine from which a pair counts
SWEEPS = 2
STEP = 0.3  # of the way to the least-squares answer, as all codewords move at once
DIGITS = 9
BLOCK_VALUES = 4_000_000


def along_weight(dim: int, threshold: float = THRESHOLD) -> float:
    """How much more errors along a vector weigh than errors across it."""
    if not 0.0 <= threshold < 1.0:
        raise ValueError("threshold must be within 0..1, without 1")
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def chosen(rows: np.ndarray, words: np.ndarray, weight: float, sweeps: int = SWEEPS) -> np.ndarray:
    """Code of each sub-vector of finite ``rows``; words is (sub, code, element).

    Starts from the nearest codewords; each sweep goes through the sub-vectors
    in order. Losses are compared rounded, ties go to the smaller code.
    """
    m = len(words)
    split = rows.reshape(len(rows), m, -1)
    out = np.stack([topk.nearest_one(split[:, s], words[s]) for s in range(m)], axis=1)
    size = (rows * rows).sum(axis=1)
    extra = np.divide(weight - 1, size, out=np.zeros(len(rows)), where=size > 0)
    at = np.arange(len(rows))
    sub_size = (split * split).sum(axis=2)
    along = np.stack([sub_size[:, s] - np.einsum("ij,ij->i", split[:, s], words[s, out[:, s]]) for s in range(m)], axis=1)
    for _ in range(sweeps):
        for s in range(m):
            dots = split[:, s] @ words[s].T
            error = sub_size[:, s, None] - 2 * dots + (words[s] * words[s]).sum(axis=1)[None, :]
            others = along.sum(axis=1) - along[:, s]
            loss = error + extra[:, None] * (others[:, None] + sub_size[:, s, None] - dots) ** 2
            out[:, s] = np.round(loss, DIGITS).argmin(axis=1)
            along[:, s] = sub_size[:, s] - dots[at, out[:, s]]
    return out


def _blocks(matrix: np.ndarray, words: np.ndarray) -> Iterator[np.ndarray]:
    step = max(1, BLOCK_VALUES // max(1, words.shape[1] * words.shape[2]))
    for at in range(0, len(matrix), step):
        yield matrix[at : at + step]


def anisotropic_encode(base: DataFrame, codebooks: DataFrame, weight: float | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """``base`` with ``code`` (m bytes) in place of ``vector``; vectors that do not fit are left out, as in ``pq_encode``."""
    words = ivf._codebook_arrays(codebooks)
    if words.shape[1] > 256:
        raise ValueError("a code is one byte: at most 256 codewords per sub-vector")
    dim = words.shape[0] * words.shape[2]
    weight = along_weight(dim) if weight is None else weight

    @F.arrow_udf("binary")
    def encoded(vector: pa.Array) -> pa.Array:
        rows = topk.vectors(vector)
        good = np.isfinite(rows).all(axis=1)
        rows = np.where(good[:, None], rows, 0.0)
        codes = np.concatenate([np.empty((0, len(words)), np.int64), *(chosen(part, words, weight, sweeps) for part in _blocks(rows, words))])
        return ivf._codes(codes.astype(np.uint8), good)

    rows = session.spread(ivf._fitting(base, dim))
    return rows.withColumn("code", encoded("vector")).drop("vector").filter(F.col("code").isNotNull())


def anisotropic_train(
    base: DataFrame, m: int = ivf.PQ_M, nbits: int = ivf.PQ_NBITS, iterations: int = 20, seed: int = 0,
    weight: float | None = None, start: DataFrame | None = None,
) -> DataFrame:
    """(sub, code, centroid): codebooks of the loss that weighs errors along the vectors.

    Starts from ``start`` (sub, code, centroid) or from plain product codebooks. A round
    chooses all codes, and adds up, per codeword, the normal equations of its rows;
    its codewords are kept if the summed loss fell, else the round before stands.
    """
    codebooks = start if start is not None else ivf.pq_train(base, m, nbits, seed=seed)
    words = ivf._codebook_arrays(codebooks)
    rows = session.stored(ivf._fitting(base.select("vector"), words.shape[0] * words.shape[2]), "training")
    weight = along_weight(words.shape[0] * words.shape[2]) if weight is None else weight
    best, least = words, np.inf
    for _ in range(iterations + 1):
        moved, loss = _round(session.spread(rows), words, weight)
        if not loss < least:
            break
        best, least, words = words, loss, moved
    out = [(s, c, [float(x) for x in best[s, c]]) for s in range(best.shape[0]) for c in range(best.shape[1])]
    return base.sparkSession.createDataFrame(out, "sub int, code int, centroid array<double>")


def _round(rows: DataFrame, words: np.ndarray, weight: float) -> tuple[np.ndarray, float]:
    """(codewords after one round, summed loss before it)."""
    m, codes, width = words.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((m, codes, width, width)), np.zeros((m, codes, width))
        n, loss = np.zeros((m, codes), np.int64), 0.0
        for batch in batches:
            matrix = topk.vectors(batch.column(0))
            matrix = matrix[np.isfinite(matrix).all(axis=1)] if matrix.size else matrix[:0]
            for part in _blocks(matrix, words):
                won = chosen(part, words, weight)
                split = part.reshape(len(part), m, width)
                residual = split - words[np.arange(m), won]
                along = np.einsum("nsw,nsw->ns", residual, split)
                size = (part * part).sum(axis=1)
                extra = np.divide(weight - 1, size, out=np.zeros(len(part)), where=size > 0)
                loss += float((residual * residual).sum() + (extra * along.sum(axis=1) ** 2).sum())
                for s in range(m):
                    x = split[:, s]
                    target = x * (1 + extra * (along.sum(axis=1) - along[:, s] + (x * x).sum(axis=1)))[:, None]
                    for c in np.unique(won[:, s]):
                        mine = won[:, s] == c
                        left[s, c] += (x[mine] * extra[mine, None]).T @ x[mine]
                        right[s, c] += target[mine].sum(axis=0)
                        n[s, c] += int(mine.sum())
        at = np.argwhere(n > 0)
        yield pa.RecordBatch.from_pydict(
            {
                "sub": pa.array(at[:, 0].astype(np.int32)),
                "code": pa.array(at[:, 1].astype(np.int32)),
                "n": pa.array(n[n > 0]),
                "sums": pa.array([np.concatenate([left[s, c].ravel(), right[s, c]]) for s, c in at], pa.list_(pa.float64())),
                "loss": pa.array([loss if not i else 0.0 for i in range(len(at))], pa.float64()),
            }
        )

    parts = rows.select("vector").mapInArrow(sums, "sub int, code int, n bigint, sums array<double>, loss double")
    total = (
        parts.select("sub", "code", "n", "loss", F.posexplode("sums").alias("pos", "value"))
        .groupBy("sub", "code", "pos")
        .agg(F.sum("value").alias("value"), F.sum("n").alias("n"), F.sum("loss").alias("loss"))
        .toArrow()
    )
    moved, loss = words.copy(), 0.0
    sub, code, pos, value, n, part = (total.column(c).to_numpy() for c in ("sub", "code", "pos", "value", "n", "loss"))
    loss = float(part[pos == 0].sum())
    held = np.zeros((m, codes, width * width + width))
    held[sub, code, pos] = value
    counts = np.zeros((m, codes))
    counts[sub, code] = n
    for s, c in np.argwhere(counts > 0):
        a = held[s, c, : width * width].reshape(width, width) + counts[s, c] * np.eye(width)
        answer = np.linalg.solve(a, held[s, c, width * width :])
        moved[s, c] = np.round(words[s, c] + STEP * (answer - words[s, c]), DIGITS)
    return moved, loss
