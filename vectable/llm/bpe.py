"""Byte-level BPE encoding and decoding by a contiguous rank array.

A vocabulary file of the tokenizers library (JSON: byte-level BPE with ordered
merges) is read on each executor; its path is a parameter. Text is cut at the
file's added tokens, then into words by the byte-level pattern. For each short
word the part boundaries and the ranks of neighbouring parts lie in two plain
lists: the lowest rank is looked up by a scan, the boundary between its two
parts is deleted, and the two ranks beside it are refreshed. Words longer than
``LONG_WORD`` bytes use a heap over linked parts, with the same result.

Results in odd cases: a null text is encoded as the empty text; an empty text
has no tokens and decodes to the empty text; null ids decode to null.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vectable.llm.arrow import with_columns

LONG_WORD = 256
#: Words remembered by a worker; beyond it the memory starts anew (results stay the same).
MEMO_WORDS = 250_000
_SHIFT = 20
_MASK = (1 << _SHIFT) - 1
_NONE = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """Symbol -> byte of the byte-level alphabet: printable bytes stand for themselves, the rest move to U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def _ranges(codes: list[int]) -> str:
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@lru_cache(2)
def word_pattern(top: int = sys.maxunicode) -> re.Pattern:
    """The byte-level pre-token pattern for texts of characters up to ``top``.

    Letters, numbers and white space are plain character sets.
    """
    kinds = [unicodedata.category(chr(c))[0] for c in range(top + 1)]
    letter = _ranges([c for c, kind in enumerate(kinds) if kind == "L"])
    number = _ranges([c for c, kind in enumerate(kinds) if kind == "N"])
    white = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    space = _ranges([c for c in white if c <= top])
    return re.compile(
        f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


def words_in(text: str) -> list[str]:
    """Pre-tokens of ``text``; texts of Latin-1 characters take the small character sets."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return word_pattern().findall(text)
    return word_pattern(255).findall(text)


class _Memo(dict):
    """Word -> its ids as packed int32, encoded on the first request."""

    def __init__(self, encode_word):
        self.encode_word = encode_word

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        packed = self[word] = array("i", self.encode_word(word)).tobytes()
        return packed


class Vocabulary:
    """Merges, byte tables and added tokens of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*ids.values(), *self.added.values()]) + 1
        self.table = [b""] * size
        for token, i in ids.items():
            self.table[i] = bytes(symbols[c] for c in token)
        for token, i in self.added.items():
            self.table[i] = token.encode()
        self.of_byte = [ids[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])]
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(ids[a] << _SHIFT | ids[b], rank << _SHIFT | ids[a + b])
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.memo = _Memo(self.encode_word)

    def encode_short(self, word: bytes) -> tuple[list[int], list[int]]:
        """(ids, boundaries) of one word by repeated scans of its rank array."""
        of_byte, rank = self.of_byte, self.pairs.get
        parts = [of_byte[b] for b in word]
        bounds = list(range(len(word) + 1))
        ranks = [rank(a << _SHIFT | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            parts[i] = best & _MASK
            del parts[i + 1], bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] << _SHIFT | parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << _SHIFT | parts[i], _NONE)
        return parts, bounds

    def encode_long(self, word: bytes) -> list[int]:
        """Ids of a long word: the same merges, taken from a heap."""
        rank = self.pairs.get
        parts = [self.of_byte[b] for b in word]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue = [(r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] << _SHIFT | parts[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i] if parts[i] >= 0 else len(parts)
            if j >= len(parts) or rank(parts[i] << _SHIFT | parts[j]) != r:
                continue
            parts[i], parts[j] = r & _MASK, -1
            k = after[i] = after[j]
            if k < len(parts):
                before[k] = i
                if (r := rank(parts[i] << _SHIFT | parts[k])) is not None:
                    heapq.heappush(queue, (r, i))
            if (h := before[i]) >= 0 and (r := rank(parts[h] << _SHIFT | parts[i])) is not None:
                heapq.heappush(queue, (r, h))
        return [p for p in parts if p >= 0]

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode()
        return self.encode_short(raw)[0] if len(raw) <= LONG_WORD else self.encode_long(raw)

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text`` as int32."""
        pieces = self.cut.split(text) if self.cut and self.cut.search(text) else [text]
        out = []
        for n, piece in enumerate(pieces):
            if n % 2:
                out.append(array("i", [self.added[piece]]).tobytes())
            else:
                out.extend(map(self.memo.__getitem__, words_in(piece)))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.table[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(4)
def vocabulary(path: str | None = None) -> Vocabulary:
    return Vocabulary(path or default_vocabulary())


def encode(
    df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, decoded: str | None = None
) -> DataFrame:
    """``df`` with the token ids (array of int) of column ``text``.

    With ``decoded`` the ids are decoded into a column of that name in the same pass.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        known = vocabulary(path)
        coded = [known.encode(t or "") for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, coded)])
        flat = np.concatenate([np.empty(0, np.int32), *coded])
        out = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
        if decoded:
            out.append(pa.array([known.decode(c.tolist()) for c in coded], pa.string()))
        return out

    made = {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {})
    return with_columns(df, text, made, run)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of the token ids in column ``ids``; bytes that are not UTF-8 become U+FFFD."""

    def run(coded: pa.Array) -> list[pa.Array]:
        known = vocabulary(path)
        return [pa.array([None if i is None else known.decode(i) for i in coded.to_pylist()], pa.string())]

    return with_columns(df, ids, {text: T.StringType()}, run)
