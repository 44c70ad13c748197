"""Removal of byte passages that occurred before, by suffix arrays of content shards.

A byte goes when it lies in a ``LENGTH``-byte string that also starts earlier:
in a document of a smaller id, or earlier in the same document.

1. Every start of a string gets a key: the least hash of the ``GRAM``-byte grams
   in the string. Equal strings have equal keys, and neighbouring starts mostly
   share theirs, so a text falls into short runs of starts with one key.
2. Runs whose key occurs once in the corpus hold no repeat; they are left out
   by a count over keys. A task sends a key that repeats among its own texts
   once, so a passage of many documents is no hot key.
3. The bytes of the other runs go to shards by key, so that equal strings meet. A
   shard of more than ``SHARD_BYTES`` is cut into parts, and each pair of parts
   is one task. Equal chunks of a part are folded to the first; the rest of a part gets a suffix array by Larsson-Sadakane refinement and
   Kasai's common prefixes, whose classes of equal strings show the repeats; two
   parts are merged by binary search of the classes of one in the other.
4. Repeats go back to their documents as ranges of starts.

Results in odd cases: null texts are empty; texts of fewer bytes than
``LENGTH`` stay whole; rows of the same id and text are the same document and
lose the same bytes; rows of the same id and other text come one after the
other in the order of a hash; a null id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectable.llm.arrow import slices
from vectable.llm.registry import written
from vectable.llm.suffix import Shard
from vectable.llm.words import mix, powers, prefix_sums, sliding_min
from vectable.session import broadcast_checked, by_key

LENGTH = 100  # fixed value
GRAM = 24
SHARD_BYTES = 1024 * 1024
BROADCAST_ROWS = 1_000_000
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def runs_of(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, number of starts, key) of each run of starts with one key."""
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.empty(0, np.int64)
    if len(raw) < length or not (sizes >= length).any():
        return empty, empty, empty, np.empty(0, np.uint64)
    sums = prefix_sums(_VALUE[raw])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * powers(len(sums))[1][: len(raw) - GRAM + 1])
    least = sliding_min(grams, length - GRAM + 1)
    offsets = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    key = least[offsets[owner] + start]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (start[1:] == 0)
    at = np.flatnonzero(fresh)
    return owner[at], start[at], np.diff(np.append(at, len(key))), key[at]


def _self_repeating(texts: list[bytes], owner, start, n, key, length: int) -> np.ndarray:
    """Runs whose key stands at two places in them: only these can hold the same string twice."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *(len(t) for t in texts)])[:-1]
    sums = prefix_sums(_VALUE[raw])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * powers(len(sums))[1][: len(raw) - GRAM + 1])
    out = np.zeros(len(key), bool)
    span = n + length - GRAM
    cuts = np.flatnonzero(np.diff(np.cumsum(span) // 500_000)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
        if a == b:
            continue
        size = span[a:b]
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(offsets[owner[a:b]] + start[a:b], size)
        out[a:b] = np.add.reduceat((grams[at] == np.repeat(key[a:b], size)).astype(np.int64), first) > 1
    return out


def _keyed(length: int):
    """Rows (key, doc, start): start >= 0 asks whether the key repeats, -1 says so, -2 - start needs no answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                docs = part.column(0).to_numpy(zero_copy_only=False)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                owner, start, n, key = runs_of(texts, length)
                if not len(key):
                    continue
                sure = _self_repeating(texts, owner, start, n, key, length)
                _, which, times = np.unique(key, return_inverse=True, return_counts=True)
                known = (times > 1)[which] | sure
                told = np.unique(key[known])
                doc = docs[owner]
                free = mix(doc[known].astype(np.uint64) ^ mix(start[known].astype(np.uint64)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(np.concatenate([key[~known], told, free]).view(np.int64)),
                        "doc": pa.array(np.concatenate([doc[~known], np.zeros(len(told), np.int64), doc[known]])),
                        "start": pa.array(np.concatenate([start[~known], np.full(len(told), -1), -2 - start[known]])),
                    }
                )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, start) of the runs in a partition whose key repeats; all rows of a key are here."""
    columns = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if not columns:
        return
    key, doc, start = (np.concatenate(c) for c in zip(*columns, strict=True))
    sure = start < -1
    yield pa.RecordBatch.from_pydict({"doc": pa.array(doc[sure]), "start": pa.array(-2 - start[sure])})
    key, doc, start = key[~sure], doc[~sure], start[~sure]
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    said = np.bincount(which, start == -1, minlength=len(times)) > 0
    found = ((times > 1) | said)[which] & (start >= 0)
    yield pa.RecordBatch.from_pydict({"doc": pa.array(doc[found]), "start": pa.array(start[found])})


def _chunks(shards: int, length: int):
    """Bytes of the listed runs as (shard, id, tie, start, n, chunk); chunks that repeat in a slice are sent once.

    The others of a slice repeat an earlier chunk as a whole: they come back as rows without bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("text")):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                ids = pc.fill_null(part.column("id"), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                ties = part.column("tie").to_numpy(zero_copy_only=False)
                owner, start, n, key = runs_of(texts, length)
                asked = part.column("starts").to_pylist()
                wanted = np.concatenate([np.array(a, np.int64) + (i << 40) for i, a in enumerate(asked)])
                kept = np.flatnonzero(np.isin((owner << 40) + start, wanted))
                kept = kept[np.lexsort((start[kept], ties[owner[kept]], ids[owner[kept]]))]
                first: dict[bytes, tuple] = {}
                rows = []
                for r in kept.tolist():
                    o, s, c = int(owner[r]), int(start[r]), int(n[r])
                    chunk = texts[o][s : s + c + length - 1]
                    mine = (int(ids[o]), int(ties[o]))
                    again = first.setdefault(chunk, (*mine, s)) != (*mine, s)
                    rows.append((int(key[r] % np.uint64(shards)), *mine, s, c, None if again else chunk))
                names = ["shard", "id", "tie", "start", "n", "chunk"]
                kinds = [pa.int64()] * 5 + [pa.binary()]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _ranges(ids, ties, starts) -> dict:
    """Columns (id, tie, low, high) of sorted starts as runs of successive ones."""
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (np.diff(starts) != 1) | (np.diff(ids) != 0) | (np.diff(ties) != 0)
    low = np.flatnonzero(fresh)
    high = np.append(low[1:], len(starts)) - 1
    arrays = (ids[low], ties[low], starts[low], starts[high]) if len(starts) else (ids, ties, starts, starts)
    return dict(zip(("id", "tie", "low", "high"), map(pa.array, arrays), strict=True))


class _Part:
    """The chunks of one part of a shard in document order, as one text."""

    def __init__(self, rows: dict, chosen: np.ndarray, length: int):
        order = chosen[np.lexsort((rows["start"][chosen], rows["tie"][chosen], rows["id"][chosen]))]
        first: dict[bytes, int] = {}
        fresh = np.array([first.setdefault(rows["chunk"][i], i) == i for i in order.tolist()], bool)
        again, order = order[~fresh], order[fresh]
        #: chunks that say an earlier one again: all their starts are repeats
        self.again = {"id": rows["id"][again], "tie": rows["tie"][again], "low": rows["start"][again]}
        self.again["high"] = self.again["low"] + rows["n"][again] - 1
        chunks = [rows["chunk"][i] for i in order]
        n, size = rows["n"][order], np.array([len(c) for c in chunks], np.int64)
        begin = np.cumsum(size) - size
        self.owner = np.repeat(order, size)
        within = np.arange(size.sum()) - np.repeat(begin, size)
        self.start = rows["start"][self.owner] + within
        self.id, self.tie = rows["id"][self.owner], rows["tie"][self.owner]
        self.shard = Shard(np.frombuffer(b"".join(chunks), np.uint8), within < np.repeat(n, size), length)

    def before(self, at: np.ndarray, other: _Part, there: np.ndarray) -> np.ndarray:
        """Whether the starts ``at`` here come before ``there`` in the other part."""
        a, b = (self.id[at], self.tie[at], self.start[at]), (other.id[there], other.tie[there], other.start[there])
        less, same = np.zeros(len(at), bool), np.ones(len(at), bool)
        for x, y in zip(a, b, strict=True):
            less |= same & (x < y)
            same &= x == y
        return less

    def ranges(self, at: np.ndarray) -> dict:
        return _ranges(self.id[at], self.tie[at], self.start[at])

    def later(self, other: _Part) -> np.ndarray:
        """Starts here that repeat a string which ``other`` holds earlier."""
        match = other.shard.find(self.shard)
        held = np.flatnonzero(match >= 0)
        first = np.full(len(match), -1)
        first[held] = other.shard.earliest[match[held]]
        first = first[self.shard.cls]
        at = np.flatnonzero(first >= 0)
        starts = self.shard.starts[at]
        return np.sort(starts[other.before(first[at], self, starts)])


def _compared(length: int):
    def run(table: pa.Table) -> pa.Table:
        a, b = table.column("part_a")[0].as_py(), table.column("part_b")[0].as_py()
        rows = {c: table.column(c).to_numpy() for c in ("id", "tie", "start", "n", "part")}
        rows["chunk"] = table.column("chunk").to_pylist()
        left = _Part(rows, np.flatnonzero(rows["part"] == a), length)
        if a == b:
            return pa.concat_tables([pa.table(left.ranges(left.shard.repeats())), pa.table(left.again)])
        right = _Part(rows, np.flatnonzero(rows["part"] == b), length)
        return pa.concat_tables([pa.table(left.ranges(left.later(right))), pa.table(right.ranges(right.later(left)))])

    return run


def _once(named: DataFrame) -> DataFrame:
    """``named`` with one row for each (id, tie): only rows that stand more than once are dealt by them."""
    listed = written(named.groupBy("id", "tie").agg(F.count("*").alias("n")).filter("n > 1").select("id", "tie"), "twice")
    if listed.isEmpty():
        return named
    twice = broadcast_checked(listed, BROADCAST_ROWS)
    again = named.join(twice, ["id", "tie"], "left_semi").dropDuplicates(["id", "tie"])
    return named.join(twice, ["id", "tie"], "left_anti").unionByName(written(again.select(named.columns), "once")).select(named.columns)


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, tie, ranges) of documents (id long, tie, text): starts (low to high) of strings that occurred before."""
    named = docs.select("id", "tie", F.xxhash64("id", "tie").alias("doc"), "text").filter(F.octet_length("text") >= length)
    named = _once(named)
    keyed = named.select("doc", "text").mapInArrow(_keyed(length), "key bigint, doc bigint, start bigint")
    found = by_key(keyed, "key").mapInArrow(_repeated, "doc bigint, start bigint")
    lists = written(found.groupBy("doc").agg(F.collect_set("start").alias("starts")), "starts")
    joined = named.join(lists, "doc")
    runs = lists.agg(F.sum(F.size("starts"))).first()[0] or 0
    shards = max(1, runs * 2 * length // SHARD_BYTES)
    chunks = written(
        joined.select("id", "tie", "text", "starts").mapInArrow(
            _chunks(shards, length), "shard bigint, id bigint, tie bigint, start bigint, n bigint, chunk binary"
        ),
        "chunks",
    )
    whole = chunks.filter("chunk is null").select("id", "tie", F.col("start").alias("low"), (F.col("start") + F.col("n") - 1).alias("high"))
    sent = chunks.filter("chunk is not null")
    parts = sent.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("chunk")) / SHARD_BYTES).cast("int").alias("parts"))
    cut = sent.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("id", "tie", "start"), F.col("parts")).cast("int"))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.withColumn("part_a", F.least("part", "other")).withColumn("part_b", F.greatest("part", "other"))
    compared = cells.drop("parts", "other").groupBy("shard", "part_a", "part_b").applyInArrow(
        _compared(length), "id bigint, tie bigint, low bigint, high bigint"
    )
    every = whole.unionByName(compared).groupBy("id", "tie")
    return written(every.agg(F.collect_set(F.struct("low", "high")).alias("ranges")), "ranges")


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, as_text: bool = False
) -> DataFrame:
    """``docs`` with n_bytes, spans (start, end: maximal removed runs in bytes) and kept (the remaining bytes).

    ``as_text`` makes ``kept`` a string of the characters that are still whole.
    """
    docs = docs.drop("n_bytes", "spans", "kept")
    least = F.lit(np.iinfo(np.int64).min)
    tie = F.xxhash64(F.coalesce(text, F.lit("")))
    found = repeated_ranges(docs.select(F.coalesce(F.col(doc_id), least).alias("id"), tie.alias("tie"), F.col(text).alias("text")), length)
    keyed = docs.withColumn("_id", F.coalesce(F.col(doc_id), least)).withColumn("_tie", tie)
    lists = found.select(F.col("id").alias("_id"), F.col("tie").alias("_tie"), F.col("ranges").alias("_ranges"))
    joined = keyed.join(lists, ["_id", "_tie"], "left").drop("_id", "_tie")
    kept = docs.schema.fields
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [*kept, T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.StringType() if as_text else T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index(text)):
                texts = [(t or "").encode() for t in part.column(text).to_pylist()]
                spans, left = [], []
                for raw, ranges in zip(texts, part.column("_ranges").to_pylist(), strict=True):
                    mine = _united([(r["low"], r["high"] + length) for r in ranges or ()])
                    spans.append([{"start": a, "end": b} for a, b in mine])
                    edges = [0, *(x for s in mine for x in s), len(raw)]
                    left.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                columns = {f.name: part.column(f.name) for f in kept}
                made = pa.struct([("start", pa.int64()), ("end", pa.int64())])
                yield pa.RecordBatch.from_pydict(
                    columns
                    | {
                        "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                        "spans": pa.array(spans, pa.list_(made)),
                        "kept": pa.array([b.decode("utf-8", "ignore") for b in left], pa.string()) if as_text else pa.array(left, pa.binary()),
                    }
                )

    return joined.mapInArrow(run, schema)


def _united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]
