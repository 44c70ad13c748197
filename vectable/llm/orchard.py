"""Compression of vectors to codes, with nearest entries found by Orchard search.

A vector of integers floor(scale * x) is cut into equal parts; each part
position has a codebook, trained by rounds of assignment and floored means. The
nearest entry is found from a table of the entries' mutual distances: every
entry keeps the others sorted by distance from it. A search walks the list of
its best entry, marks the entries it has seen, and jumps to the list of each
entry that improves on it; as soon as the next in the list is more than twice
the current distance away, no unseen entry can be as near. numpy walks the
lists of all parts of a block of rows at once.

A round is one pass over the table: tasks send sums and counts of each entry,
which Spark adds up; the codebooks, of fixed size, go to every task. All
arithmetic is on integers, so results do not depend on partitions.

Results in odd cases: vectors that are null, or hold null or non-finite
components, are left out, as are those of another length than most (of equally
many the shorter); a length that the parts do not divide is filled up with
zeros; the first entries come from the smallest ids without nulls, of rows with
one id from the smallest vector; fewer ids give fewer entries; rows of null id
are coded like others, and repeated rows each; with no row, or no id, the
result is empty; integers too large for 64 bits are handled exactly, errors
beyond a long are cut to its limit. Columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096  # fixed values
BLOCK_ROWS = 4096
_LIMB = 40  # bits of a limb, in which sums of any size are added up as longs
_LIMBS = 5
_TOP = (1 << 63) - 1


@dataclass
class Codebooks:
    """Entries of each part position as integers, and what they were made with."""

    books: list[np.ndarray]  # per part: entries x width
    dim: int
    scale: int

    def sha256(self) -> str:
        """Hash of all components in order of part, entry and place."""
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for x in book.ravel()).encode()).hexdigest()


def integers(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * value) as int64, or as Python integers where these are too large for exact arithmetic."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if not scaled.size or np.abs(scaled).max() < 2**26:
        return scaled.astype(np.int64)
    return np.array([int(v) for v in scaled.ravel()], object).reshape(scaled.shape)


def fitting(batch: pa.RecordBatch, column: str, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, integer matrix) of the vectors of ``dim`` finite components."""
    lists = batch.column(column)
    fits = pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(fits)
    flat = pc.list_flatten(lists.take(pa.array(at))) if len(at) else pa.array([], lists.type.value_type)
    matrix = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(len(at), dim)
    finite = np.isfinite(matrix).all(axis=1)
    return at[finite], integers(matrix[finite], scale)


def parted(matrix: np.ndarray, parts: int) -> list[np.ndarray]:
    """Equal consecutive parts of the columns, the last ones filled up with zeros."""
    width = -(-matrix.shape[1] // parts)
    filled = np.zeros((len(matrix), width * parts), matrix.dtype)
    filled[:, : matrix.shape[1]] = matrix
    return [filled[:, p * width : (p + 1) * width] for p in range(parts)]


class Lists:
    """Distances between the entries of a codebook, and for each entry all of them sorted by distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gap = entries[:, None, :] - entries[None, :, :]
        self.gaps = (gap * gap).sum(axis=2) if entries.shape[1] else np.zeros((len(entries), len(entries)), entries.dtype)
        self.order = np.argsort(self.gaps, axis=1, kind="stable")

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, squared distance) of each point; ties to the lower entry."""
        if points.dtype != self.entries.dtype:
            points = points.astype(object)
        n, k = len(points), len(self.entries)
        best, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        gap = points - self.entries[0]
        dist = (gap * gap).sum(axis=1) if points.shape[1] else np.zeros(n, points.dtype)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        open_ = np.arange(n)
        while len(open_):
            other = self.order[best[open_], place[open_]]
            near = (self.gaps[best[open_], other] <= 4 * dist[open_]).astype(bool)  # of squares: twice the distance
            open_, other = open_[near], other[near]
            place[open_] += 1
            new = ~seen[open_, other]
            asked, other = open_[new], other[new]
            seen[asked, other] = True
            gap = points[asked] - self.entries[other]
            found = (gap * gap).sum(axis=1) if points.shape[1] else np.zeros(len(asked), points.dtype)
            better = ((found < dist[asked]) | ((found == dist[asked]) & (other < best[asked]))).astype(bool)
            moved = asked[better]
            best[moved], dist[moved], place[moved] = other[better], found[better], 0
            open_ = open_[place[open_] < k]
        return best, dist


def _lists(books: Codebooks) -> list[Lists]:
    """Search lists; entries too large for 64-bit arithmetic as Python integers."""
    large = any(book.dtype == object or (book.size and np.abs(book).max() >= 2**26) for book in books.books)
    return [Lists(book.astype(object if large else np.int64)) for book in books.books]


def _blocks(batches: Iterator[pa.RecordBatch], column: str, books: Codebooks) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
    """(rows, numbers of those that fit, their parts)."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            rows, matrix = fitting(part, column, books.dim, books.scale)
            yield part, rows, parted(matrix, len(books.books))


def train(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codebooks | None:
    """Codebooks of the vectors of ``df``; None where no row can give an entry."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    df = df.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sizes = df.filter(F.col("vector").isNotNull() & ~bad).groupBy(F.size("vector").alias("dim")).count()
    most = sizes.orderBy(F.desc("count"), "dim").first()
    if most is None:
        return None
    first = _first(df, most.dim, entries)
    if not first:
        return None
    seeds = integers(np.array(first, np.float64).reshape(len(first), most.dim), scale)
    books = Codebooks(parted(seeds, parts), most.dim, scale)
    for _ in range(rounds):
        books = _moved(df, books)
    return books


def _first(df: DataFrame, dim: int, entries: int) -> list[list[float]]:
    """The vectors of the smallest ids; each task sends no more than ``entries`` rows."""
    kind = df.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            rows, _ = fitting(batch, "vector", dim, 1)
            part = batch.take(pa.array(rows))
            part = part.filter(pc.is_valid(part.column("id")))
            if len(held) == entries:
                part = part.filter(pc.less_equal(part.column("id"), pa.scalar(max(held), part.column("id").type)))
            for name, values in zip(part.column("id").to_pylist(), part.column("vector").to_pylist(), strict=True):
                held[name] = min(held.get(name, values), values)
            held = {name: held[name] for name in sorted(held)[:entries]}
        yield pa.RecordBatch.from_pydict(
            {"id": pa.array(list(held), batch_type(kind)), "vector": pa.array(list(held.values()), pa.list_(pa.float64()))}
        )

    schema = T.StructType([T.StructField("id", kind), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    best = df.mapInArrow(run, schema).groupBy("id").agg(F.min("vector").alias("vector"))
    return [r.vector for r in best.orderBy("id").limit(entries).collect()]


def batch_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _moved(df: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks after one round: each entry the floored mean of the parts nearest to it; unused ones stay."""
    width = books.books[0].shape[1]
    sent = df.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        lists = _lists(known)
        total = [np.zeros(book.shape, object) for book in known.books]
        count = [np.zeros(len(book), np.int64) for book in known.books]
        for _, _, points in _blocks(batches, "vector", known):
            for p, mine in enumerate(points):
                best, _ = lists[p].nearest(mine)
                count[p] += np.bincount(best, minlength=len(count[p]))
                for e in np.unique(best):
                    total[p][e] += mine[best == e].sum(axis=0).astype(object)
        keys = [(p, e, w) for p, book in enumerate(known.books) for e in range(len(book)) if count[p][e] for w in range(width)]
        sums = [int(total[p][e][w]) for p, e, w in keys]
        columns = {name: pa.array([key[i] for key in keys], pa.int32()) for i, name in enumerate(("part", "entry", "place"))}
        columns["n"] = pa.array([int(count[p][e]) for p, e, _ in keys], pa.int64())
        for i in range(_LIMBS):
            last = i == _LIMBS - 1
            columns[f"limb{i}"] = pa.array([s >> _LIMB * i if last else (s >> _LIMB * i) & ((1 << _LIMB) - 1) for s in sums], pa.int64())
        yield pa.RecordBatch.from_pydict(columns)

    limbs = [f"limb{i}" for i in range(_LIMBS)]
    sums = df.select("vector").mapInArrow(run, "part int, entry int, place int, n bigint, " + ", ".join(f"{x} bigint" for x in limbs))
    sums = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in limbs))
    moved = [book.astype(object) for book in books.books]
    for r in sums.collect():
        moved[r.part][r.entry, r.place] = sum(r[x] << _LIMB * i for i, x in enumerate(limbs)) // r.n
    sent.unpersist()
    small = all(not book.size or np.abs(book).max() < 2**26 for book in moved)
    return Codebooks([book.astype(np.int64) if small else book for book in moved], books.dim, books.scale)


def encode(df: DataFrame, books: Codebooks | None, vector: str = "embedding") -> DataFrame:
    """The rows of ``df`` whose vector fits, with code (two hex digits per part) and error (squared distance)."""
    df = df.drop("code", "error")
    kept = df.schema.fields
    schema = T.StructType([*kept, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if books is None:
        return df.withColumns({"code": F.lit(""), "error": F.lit(0).cast("bigint")}).filter(F.lit(False))
    sent = df.sparkSession.sparkContext.broadcast(books)
    digits = np.array([f"{e:02x}" for e in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _lists(sent.value)
        for part, rows, points in _blocks(batches, vector, sent.value):
            code, error = np.zeros(len(rows), "<U1"), 0
            for own, mine in zip(lists, points, strict=True):
                best, dist = own.nearest(mine)
                code, error = np.char.add(code, digits[best]), error + dist
            held = part.take(pa.array(rows))
            columns = {f.name: held.column(f.name) for f in kept}
            error = [min(int(x), _TOP) for x in error] if len(rows) else []
            yield pa.RecordBatch.from_pydict(columns | {"code": pa.array(code.tolist(), pa.string()), "error": pa.array(error, pa.int64())})

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, books: Codebooks, code: str = "code", vector: str = "decoded") -> DataFrame:
    """``df`` with the vector (array of double) that ``code`` stands for; null for a null code."""
    entries = [[[float(x) / books.scale for x in entry] for entry in book] for book in books.books]
    tables = [F.array(*(F.array(*(F.lit(x) for x in entry)) for entry in book)) for book in entries]
    parts = [F.element_at(book, F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") + 1) for p, book in enumerate(tables)]
    return df.withColumn(vector, F.when(F.col(code).isNotNull(), F.slice(F.concat(*parts), 1, books.dim)))
