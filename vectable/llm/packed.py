"""Rows that each hold whole numpy arrays, for work on many small keys that Spark deals out by bucket.

A packed row is (key, kind, at, data): ``data`` holds named arrays, byte planes first and
compressed, so that small numbers in wide integers cost little.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from vectable.llm.registry import folder

SCHEMA = "key bigint, kind string, at bigint, data binary"
_ARROW = pa.schema([("key", pa.int64()), ("kind", pa.string()), ("at", pa.int64()), ("data", pa.binary())])
#: Packed rows that a task sends at once.
SENT_ROWS = 256
Row = tuple[int, str, int, bytes | None]


def pack(**arrays: np.ndarray) -> bytes:
    head = json.dumps([[name, a.dtype.str, len(a)] for name, a in arrays.items()]).encode()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays.values()]
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(planes))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for name, kind, n in json.loads(raw[4:at]):
        wide = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n)
        out[name] = np.ascontiguousarray(planes.T).view(kind).reshape(n)
        at += n * wide
    return out


def batch_of(rows: list[Row]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def batches_of(rows: Iterable[Row]) -> Iterator[pa.RecordBatch]:
    held: list[Row] = []
    for row in rows:
        held.append(row)
        if len(held) == SENT_ROWS:
            yield batch_of(held)
            held = []
    yield batch_of(held)


def rows_of(table: pa.Table | pa.RecordBatch) -> list[Row]:
    return list(zip(*(table.column(c).to_pylist() for c in ("key", "kind", "at", "data")), strict=True))


def each(df: DataFrame, make: Callable[[Row], Iterable[Row]]) -> DataFrame:
    """The packed rows that ``make`` gives for each packed row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from batches_of(row for given in rows_of(batch) for row in make(given))

    return df.mapInArrow(run, SCHEMA)


def grouped(df: DataFrame, make: Callable[[int, dict[str, list[Row]]], Iterable[Row]]) -> DataFrame:
    """The packed rows that ``make`` gives for each key of ``df`` and its rows by kind."""

    def run(table: pa.Table) -> pa.Table:
        kinds: dict[str, list[Row]] = {}
        for row in sorted(rows_of(table), key=lambda r: (r[2], r[3] or b"")):
            kinds.setdefault(row[1], []).append(row)
        return pa.Table.from_batches([batch_of(list(make(table.column("key")[0].as_py(), kinds)))])

    return df.groupBy("key").applyInArrow(run, SCHEMA)


def by_kind(df: DataFrame, name: str) -> dict[str, DataFrame]:
    """``df`` written to the shared folder, one folder per kind, and read again on demand."""
    path = folder(df.sparkSession, name)
    df.write.partitionBy("kind").parquet(path)
    stored = df.sparkSession.read.schema(SCHEMA).parquet(path).select("key", "kind", "at", "data")
    return _Kinds(stored)


class _Kinds(dict):
    def __init__(self, stored: DataFrame):
        self.stored = stored

    def __missing__(self, kind: str) -> DataFrame:
        self[kind] = self.stored.filter(self.stored["kind"] == kind)
        return self[kind]


def runs(sorted_: np.ndarray) -> np.ndarray:
    """First place of each run of equal values."""
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.empty(0, np.int64)


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order; by sorting, which costs less here than the hash table of ``np.unique``."""
    values = np.sort(values)
    return values[runs(values)]


def stable_order(keys: np.ndarray, most: int) -> np.ndarray:
    """Stable order of whole ``keys`` from 0 to ``most``: short ones by radix, others sorted together with their places where 63 bits hold both."""
    if most < 1 << 16:
        return np.argsort(keys.astype(np.uint16), kind="stable")
    bits = len(keys).bit_length()
    if int(most).bit_length() + bits > 63:
        return np.argsort(keys, kind="stable")
    placed = keys.astype(np.int64)
    placed <<= bits
    placed |= np.arange(len(keys))
    placed.sort()
    placed &= (1 << bits) - 1
    return placed


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and for each the sums of the values, which are whole numbers: they are added in no fixed order."""
    order = np.argsort(keys)
    keys = keys[order]
    first = runs(keys)
    return (keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values))
