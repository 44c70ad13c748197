"""Words of whole texts and their hashes, over byte buffers in numpy.

A word is a run of digits, ASCII letters (A-Z lower-cased) and non-ASCII
characters. Hashes are polynomial sums modulo 2^64 over a byte buffer, mixed at
the end; whoever needs certainty compares the bytes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = np.arange(256)
    upper = (code >= 65) & (code <= 90)
    lower = np.where(upper, code + 32, code).astype(np.uint8)
    inside = (code >= 128) | ((lower >= 97) & (lower <= 122)) | ((code >= 48) & (code <= 57))
    return lower, inside, mix(lower.astype(np.uint64) + np.uint64(1))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


LOWER, INSIDE, VALUE = _byte_tables()


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    steps = np.full(n, _BASE, np.uint64)
    back = np.full(n, inverse, np.uint64)
    steps[0] = back[0] = 1
    return np.multiply.accumulate(steps), np.multiply.accumulate(back)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(B^i, B^-i) for i below ``n`` at least."""
    return _powers(1 << max(16, (n - 1).bit_length()))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[x] * B^x for i <= x < j."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]


@dataclass
class Words:
    """Words of several texts: byte spans in ``buffer`` (lower-cased), hashes, and the first word of each text."""

    buffer: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # len(texts) + 1

    def word(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]]


def words_of(texts: list[bytes | None]) -> Words:
    texts = [t or b"" for t in texts]
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edges = np.zeros(len(raw) + 2, np.int8)
    edges[1:-1] = INSIDE[raw]
    turn = np.diff(edges)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    hashes = mix(span_hashes(prefix_sums(VALUE[raw]), starts, ends) ^ (ends - starts).astype(np.uint64))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(LOWER[raw].tobytes(), starts, ends, hashes, np.searchsorted(starts, begins))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; entry i starts at word i."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + hashes[j : j + n]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    if len(values) < width:
        return values[:0]
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[: len(values) - step], values[step:])
        done += step
    return values


def text_hash(text: str) -> int:
    """64 signed bits of a text, the same in every process."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
