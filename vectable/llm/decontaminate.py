"""Benchmark decontamination by winnowing.

The fingerprints of a text are the smallest hashes of word ``K``-grams in each
window of ``WINDOW`` successive ones. Two texts that share ``K + WINDOW - 1`` =
13 words hold the same window there, so they share a fingerprint: no shared
span of that length is missed. Fingerprints of benchmark items are joined with
those of each document, and every hit is extended word by word, on the bytes,
in both directions; runs of 13 words and more count.

Items of fewer than 13 words are one window each; for each such length the
grams of that length are compared at every position, and hits are verified on
the bytes as well.

The benchmark is worked on in blocks of at most ``BLOCK_BYTES`` of text (sized
by an aggregation), each sent to all tasks once; documents are read once a
block and are never shuffled. Spans of all blocks are united per document.

Results in odd cases: null texts and texts without words have no words and no
hits; an item without words has no window; repeated items are hit alike; an item
with a null id is named "null"; repeated rows of the documents each get a row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectable.llm.arrow import slices
from vectable.llm.words import Words, grams, sliding_min, words_of

SPAN = 13  # fixed value: words of a window
K = 5
WINDOW = SPAN - K + 1
BLOCK_BYTES = 16 * 1024 * 1024


def fingerprints(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, word positions) of the winnowed ``K``-grams of all texts in ``words``.

    Grams that cross into the next text never win a window; windows that cross
    only add grams that stand within a text.
    """
    values = grams(words.hashes, K)
    if not len(values):
        return values, np.empty(0, np.int64)
    last = words.first[1:][np.searchsorted(words.first, np.arange(len(values)), side="right") - 1]
    crossing = np.arange(len(values)) + K > last
    values[crossing] = np.iinfo(np.uint64).max
    padded = np.concatenate([values, np.full(WINDOW - 1, np.iinfo(np.uint64).max, np.uint64)])
    low = sliding_min(padded, WINDOW)  # of the windows that start at each gram
    chosen = np.zeros(len(values), bool)
    for back in range(WINDOW):
        n = len(values) - back
        chosen[back:] |= values[back:] == low[:n]
    chosen &= ~crossing
    at = np.flatnonzero(chosen)
    return values[at], at


class Benchmark:
    """One block of items, ready to be met by documents."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.words = words_of([(t or "").encode() for t in texts])
        count = np.diff(self.words.first)
        hashes, at = fingerprints(self.words)
        self.item_of = np.repeat(np.arange(len(ids)), count)
        long = count[self.item_of[at]] >= SPAN if len(at) else np.empty(0, bool)
        order = np.argsort(hashes[long], kind="stable")
        self.hashes, self.at = hashes[long][order], at[long][order]
        #: length -> (sorted hashes of short items, their items)
        self.short = {}
        for m in sorted({int(c) for c in count if 0 < c < SPAN}):
            items = np.flatnonzero(count == m)
            value = grams(self.words.hashes, m)[self.words.first[items]]
            order = np.argsort(value, kind="stable")
            self.short[m] = (value[order], items[order])

    def hits(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, first word, end word, item) of every run that holds a window, in word positions of ``words``."""
        text_of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        values, at = fingerprints(words)
        done: dict[tuple[int, int], int] = defaultdict(lambda: -1)
        for p, q in _matches(values, at, self.hashes, self.at):
            if done[q - p, int(self.item_of[q])] > p:
                continue
            text, item = int(text_of[p]), int(self.item_of[q])
            low = min(p - int(words.first[text]), q - int(self.words.first[item]))
            high = min(int(words.first[text + 1]) - p, int(self.words.first[item + 1]) - q)
            a = 0
            while a < low and words.word(p - a - 1) == self.words.word(q - a - 1):
                a += 1
            b = 0
            while b < high and words.word(p + b) == self.words.word(q + b):
                b += 1
            done[q - p, item] = p + max(b, 1)
            if a + b >= SPAN:
                yield text, p - a, p + b, item
        for m, (known, items) in self.short.items():
            values = grams(words.hashes, m)
            at = np.arange(len(values))
            at = at[at + m <= words.first[1:][text_of[at]]] if len(at) else at
            for p, n in _matches(values[at], at, known, np.arange(len(items))):
                q = int(self.words.first[items[n]])
                if all(words.word(p + j) == self.words.word(q + j) for j in range(m)):
                    yield int(text_of[p]), p, p + m, int(items[n])


def _matches(values, at, known, known_at) -> Iterator[tuple[int, int]]:
    """(at, known_at) of all equal hashes, by ascending ``at``; ``known`` is sorted."""
    if not len(known) or not len(values):
        return
    low, high = np.searchsorted(known, values), np.searchsorted(known, values, side="right")
    for i in np.flatnonzero(high > low).tolist():
        for j in range(int(low[i]), int(high[i])):
            yield int(at[i]), int(known_at[j])


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list]]:
    """Items in blocks of bounded bytes: (ids, texts)."""
    items = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    part = F.pmod(F.xxhash64("item", "text"), F.lit(max(blocks, 1)))
    for n in range(blocks):
        rows = items.filter(part == n).collect() if blocks > 1 else items.collect()
        yield [r.item for r in rows], [r.text for r in rows]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document.

    ``spans`` are the hit runs (start, end) in words, united and in order;
    ``items`` are the ids of the items found, as sorted distinct strings.
    """
    context = docs.sparkSession.sparkContext
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    blocks = [context.broadcast(block) for block in _blocks(benchmark, item_id, item_text)]
    if len(blocks) < 2:
        found = source.mapInArrow(_finder(blocks[0] if blocks else context.broadcast(([], []))), _schema(source))
    else:
        source = source.withColumn("row", F.xxhash64("id", "text"))
        parts = [source.mapInArrow(_finder(block), _schema(source)) for block in blocks]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items")]
        found = every.groupBy("id", "row", "n_words").agg(*lists, (F.count("*") / len(blocks)).cast("int").alias("n"))
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).drop("row", "n", "copy")
    return found.select(
        F.col("id").alias(doc_id), "n_words", _united("spans").alias("spans"),
        F.array_sort(F.array_distinct("items")).alias("items"),
    )


def _schema(source: DataFrame) -> str:
    row = ", row bigint" if "row" in source.columns else ""
    kind = source.schema["id"].dataType.simpleString()
    return f"id {kind}{row}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def _united(spans: str):
    """Sorted spans with overlapping or touching ones joined."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        meets = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"])
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(span))
        )

    return F.aggregate(F.array_sort(spans), empty, step)


def _finder(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Benchmark(*block.value)
        names = ["null" if i is None else str(i) for i in known.ids]
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("text")):
                words = words_of([None if t is None else t.encode() for t in part.column("text").to_pylist()])
                spans = [[] for _ in range(part.num_rows)]
                items = [set() for _ in range(part.num_rows)]
                for n, start, end, item in known.hits(words):
                    base = int(words.first[n])
                    spans[n].append({"start": start - base, "end": end - base})
                    items[n].add(names[item])
                columns = {c: part.column(c) for c in part.schema.names if c != "text"}
                yield pa.RecordBatch.from_pydict(
                    columns
                    | {
                        "n_words": pa.array(np.diff(words.first)),
                        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        "items": pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                    }
                )

    return run
