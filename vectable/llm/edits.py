"""Token counts that follow edits.

A document's state is its text, the length and the token count of each
pre-token, and a segment tree of their sums over blocks of ``BLOCK`` pre-tokens.
An edit (at, removed, inserted) is located by a walk down the tree. The byte-level
pattern decides about a pre-token by its own characters and at most two that
follow, and never by what precedes; so encoding starts at the first pre-token
that reaches to within two characters of the edit, and stops at the first new
boundary past the edit that was one before. Only the pre-tokens between are
encoded; their block and the sums above it are updated.

Counts are those of the ordinary text (strings of added tokens are text too).

Results in odd cases: a null text is empty; null edits are none; positions
beyond the text mean its end, negative ones and null its start; null insertions are empty;
edits apply one after the other, each to the text that the one before left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectable.llm.arrow import slices
from vectable.llm.bpe import Vocabulary, vocabulary, word_pattern, words_in

BLOCK = 64
EDITS = "array<struct<at:int,removed:int,inserted:string>>"
_STATE = [
    T.StructField("leaf_chars", T.ArrayType(T.IntegerType())),
    T.StructField("leaf_tokens", T.ArrayType(T.IntegerType())),
    T.StructField("n_tokens", T.LongType()),
]


def counted(known: Vocabulary, word: str) -> int:
    return len(known.memo[word]) // 4


class TokenTree:
    """Pre-tokens of one document in blocks, under a segment tree of (characters, tokens)."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.text = text
        self._build(list(zip(chars.tolist(), tokens.tolist(), strict=True)))

    def _build(self, leaves: list[tuple[int, int]]) -> None:
        self.blocks = [leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)] or [[]]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for n, block in enumerate(self.blocks):
            self.chars[self.width + n] = sum(c for c, _ in block)
            self.tokens[self.width + n] = sum(t for _, t in block)
        for n in range(self.width - 1, 0, -1):
            self._add(n)

    def _add(self, n: int) -> None:
        self.chars[n] = self.chars[2 * n] + self.chars[2 * n + 1]
        self.tokens[n] = self.tokens[2 * n] + self.tokens[2 * n + 1]

    def _update(self, block: int) -> None:
        n = self.width + block
        self.chars[n] = sum(c for c, _ in self.blocks[block])
        self.tokens[n] = sum(t for _, t in self.blocks[block])
        while n > 1:
            n //= 2
            self._add(n)

    def _find(self, position: int) -> tuple[int, int, int]:
        """(block, leaf, first character) of the pre-token that holds ``position``."""
        n, begin = 1, 0
        while n < self.width:
            n *= 2
            if position >= begin + self.chars[n]:
                begin += self.chars[n]
                n += 1
        block = n - self.width
        for leaf, (size, _) in enumerate(self.blocks[block] if block < len(self.blocks) else ()):
            if position < begin + size:
                return block, leaf, begin
            begin += size
        raise IndexError(position)

    def edit(self, known: Vocabulary, at: int, removed: int, inserted: str) -> int:
        """Apply one edit; the number of pre-tokens encoded."""
        at = min(max(at, 0), len(self.text))
        removed = min(max(removed, 0), len(self.text) - at)
        if not removed and not inserted:
            return 0
        block = leaf = start = 0
        if self.text:
            block, leaf, start = self._find(min(max(at - 2, 0), len(self.text) - 1))
        text = self.text[:at] + inserted + self.text[at + removed :]
        settled, shift = at + len(inserted), len(inserted) - removed
        fresh, old = [], start
        last, nth = block, leaf  # the first old pre-token that stays
        for m in _matches(text, start):
            fresh.append((m.end() - m.start(), counted(known, m[0])))
            if m.end() < settled:
                continue
            while old < m.end() - shift and last < len(self.blocks):
                if nth >= len(self.blocks[last]):
                    last, nth = last + 1, 0
                    continue
                old += self.blocks[last][nth][0]
                nth += 1
            if old == m.end() - shift:
                break
        else:
            last, nth = len(self.blocks), 0
        rest = self.blocks[last][nth:] if last < len(self.blocks) else []
        self.blocks[block] = self.blocks[block][:leaf] + fresh + (rest if last == block else [])
        for n in range(block + 1, min(last, len(self.blocks))):
            self.blocks[n] = []
            self._update(n)
        if block < last < len(self.blocks):
            self.blocks[last] = rest
            self._update(last)
        self.text = text
        if len(self.blocks[block]) > 4 * BLOCK:
            self._build([x for b in self.blocks for x in b])
        else:
            self._update(block)
        return len(fresh)

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.array([x for b in self.blocks for x in b], np.int32).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def _matches(text: str, start: int):
    try:
        text[start:].encode("latin-1")
    except UnicodeEncodeError:
        return word_pattern().finditer(text, start)
    return word_pattern(255).finditer(text, start)


def leaves_of(known: Vocabulary, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each pre-token."""
    words = words_in(text)
    tokens = np.fromiter((len(p) // 4 for p in map(known.memo.__getitem__, words)), np.int32, len(words))
    return np.fromiter(map(len, words), np.int32, len(words)), tokens


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate([np.empty(0, np.int32), *parts])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def token_trees(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with the state of each text: leaf_chars, leaf_tokens and n_tokens."""
    df = df.drop(*(f.name for f in _STATE))
    kept = df.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index(text)):
                both = [leaves_of(known, t or "") for t in part.column(text).to_pylist()]
                columns = {f.name: part.column(f.name) for f in kept}
                made = {
                    "leaf_chars": _lists([c for c, _ in both]),
                    "leaf_tokens": _lists([t for _, t in both]),
                    "n_tokens": pa.array([int(t.sum()) for _, t in both], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns | made)

    return df.mapInArrow(run, T.StructType([*kept, *_STATE]))


def apply_edits(df: DataFrame, edits: str = "edits", text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` (of ``token_trees``) after its edits: new text and state, and n_encoded, the pre-tokens encoded for it."""
    df = df.drop("n_encoded").withColumn(edits, F.col(edits).cast(EDITS))
    kept = df.schema.fields
    schema = T.StructType([*kept, T.StructField("n_encoded", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index(text)):
                texts, leaves, encoded, totals = [], [], [], []
                columns = {f.name: part.column(f.name) for f in kept}
                chars, tokens = columns["leaf_chars"], columns["leaf_tokens"]
                for n, (old, script) in enumerate(zip(columns[text].to_pylist(), columns[edits].to_pylist(), strict=True)):
                    tree = TokenTree(old or "", chars[n].values.to_numpy(), tokens[n].values.to_numpy())
                    done = 0
                    for e in script or ():
                        if e is not None:
                            done += tree.edit(known, e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
                    texts.append(tree.text)
                    leaves.append(tree.leaves())
                    encoded.append(done)
                    totals.append(tree.n_tokens)
                made = {
                    text: pa.array(texts, pa.string()),
                    "leaf_chars": _lists([c for c, _ in leaves]),
                    "leaf_tokens": _lists([t for _, t in leaves]),
                    "n_tokens": pa.array(totals, pa.int64()),
                    "n_encoded": pa.array(encoded, pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns | made)

    return df.mapInArrow(run, schema)
