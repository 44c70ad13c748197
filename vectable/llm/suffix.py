"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, search of one array in another."""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a big-endian number; zeros follow the end."""
    padded = np.zeros(len(text) + 8, np.uint64)
    padded[: len(text)] = text
    out = padded[: len(text)] << np.uint64(56)
    for j in range(1, 8):
        out |= padded[j : j + len(text)] << np.uint64(56 - 8 * j)
    return out


def suffix_array(text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes; a suffix that ends sorts first.

    Suffixes are sorted by eight bytes, then only groups that are still tied
    are sorted by the ranks that lie as far ahead as the order is known, which
    doubles that distance, until no tie is left.
    """
    n = len(text)
    sa = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int64)
    at, depth = np.arange(n), 8
    fresh = np.ones(n, bool)
    fresh[1:] = words[sa[1:]] != words[sa[:-1]]
    while True:
        start = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[sa[at]] = start
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        at = at[~alone]
        if not len(at):
            return sa
        p = sa[at]
        ahead = p + depth
        inside = ahead < n
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + depth + 1, n - ahead + depth)
        key = (rank[p].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        sa[at], key = p[order], key[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        depth *= 2


def common_prefixes(text: np.ndarray, words: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length that each suffix, by position, shares with the one before it in ``sa``.

    Kasai: when the bytes before both suffixes agree, the length is one less than that of
    the position before; only the other positions are compared, eight bytes a step.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[sa[1:]], before[sa[:1]] = sa[:-1], -1
    derived = np.zeros(n, bool)
    derived[1:] = (before[1:] > 0) & (text[:-1] == text[np.maximum(before[1:], 1) - 1])
    first = np.flatnonzero(~derived & (before >= 0))
    length = np.zeros(n, np.int64)
    live, shared = first, np.zeros(len(first), np.int64)
    index = np.arange(len(first))
    while len(live):
        a, b = live + shared[index], before[live] + shared[index]
        room = np.minimum(n - a, n - b)
        differ = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
        step = np.minimum(_leading_bytes(differ), np.maximum(room, 0))
        shared[index] += step
        on = (step == 8) & (room > 8)
        live, index = live[on], index[on]
    length[first] = shared
    anchor = np.maximum.accumulate(np.where(derived, 0, np.arange(n)))
    return np.where(derived, length[anchor] - (np.arange(n) - anchor), length)


def _leading_bytes(differ: np.ndarray) -> np.ndarray:
    """Equal leading bytes of words whose exclusive or is ``differ``: 0 to 8."""
    out = np.zeros(len(differ), np.int64)
    for j in range(1, 9):
        out += (differ >> np.uint64(64 - 8 * j)) == 0
    return out


class Shard:
    """A text with its suffix array, and the classes of valid starts that share ``length`` bytes."""

    def __init__(self, text: np.ndarray, valid: np.ndarray, length: int):
        self.text, self.length = text, length
        self.words = words_at(text)
        self.sa = suffix_array(text, self.words)
        shared = common_prefixes(text, self.words, self.sa)[self.sa]
        group = np.cumsum(shared < length)
        kept = valid[self.sa]
        #: valid starts in suffix order, and the class of each
        self.starts, group = self.sa[kept], group[kept]
        fresh = np.ones(len(group), bool)
        fresh[1:] = group[1:] != group[:-1]
        self.cls = np.cumsum(fresh) - 1
        self.edge = np.flatnonzero(fresh)
        #: the earliest start of each class
        self.earliest = np.minimum.reduceat(self.starts, self.edge) if len(self.edge) else self.starts[:0]

    def repeats(self) -> np.ndarray:
        """Starts that are not the first of their class."""
        return np.sort(self.starts[self.starts != self.earliest[self.cls]]) if len(self.cls) else self.starts

    def find(self, other: Shard) -> np.ndarray:
        """For each class of ``other`` the class here with the same bytes, or -1: binary search over the classes."""
        mine, asked = self.starts[self.edge], other.starts[other.edge]
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(mine))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            less = self._compare(mine[mid], other, asked[open_]) < 0
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        out = np.full(len(asked), -1)
        near = np.flatnonzero(low < len(mine))
        same = self._compare(mine[low[near]], other, asked[near]) == 0
        out[near[same]] = low[near[same]]
        return out

    def _compare(self, a: np.ndarray, other: Shard, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the ``length`` bytes here at ``a`` against those of ``other`` at ``b``."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for at in range(0, self.length, 8):
            x, y = self.words[a[live] + at], other.words[b[live] + at]
            if self.length - at < 8:
                drop = np.uint64(8 * (8 - self.length + at))
                x, y = x >> drop, y >> drop
            out[live] = (x > y).astype(np.int64) - (x < y)
            live = live[x == y]
            if not len(live):
                break
        return out
