"""Exact k-best selection of one Arrow batch against a bounded block of queries.

This is the inner step of the search operators. Spark decides which rows meet
which queries; here numpy scores them and keeps the k best per query. Scores
are rounded to six decimals and ties go to the smaller id, everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

DIGITS = 6
ASCENDING = {"L2": True, "HAMMING": True, "COSINE": False, "IP": False, "JACCARD": False, "AGREEMENT": False}
_CELLS = 1_000_000  # score-matrix entries held at a time
_QUERIES = 256  # queries scored at a time
_FIRST = 1024  # rows of the first block, from which a group of queries takes its first limits; the next ones double
_ROUNDING = 2.0**-24  # of single precision
_ADDED = 64  # coded rows whose table entries are added up at a time
_PENDING = 500_000  # candidates held, beside the rows kept, before they are merged
_VALUES = 2_000_000  # vector values held at a time when re-scoring by differences


def check_metric(metric: str) -> str:
    if metric not in ASCENDING:
        raise ValueError(f"unknown metric {metric!r}")
    return metric


def vectors(column: pa.Array, bits: bool = False) -> np.ndarray:
    """Matrix of a list column; packed words are unpacked to 0/1 columns."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    if not bits:
        return rows.astype(np.float64)
    as_bytes = np.ascontiguousarray(rows.astype("<i8")).view(np.uint8)
    return np.unpackbits(as_bytes, axis=1, bitorder="little").astype(np.float64)


def keys(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    return np.array(column.to_pylist())


def _score_matrix(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all rows of q against all rows of b, smaller is better; those of L2 squared.

    AGREEMENT is the share of equal entries, for signatures.
    """
    if metric == "AGREEMENT":
        equal = np.zeros((len(q), len(b)))
        for j in range(q.shape[1]):
            equal -= q[:, j, None] == b[None, :, j]
        return equal / q.shape[1]
    if metric in ("L2", "HAMMING"):  # |q|^2 + |b|^2 - 2 q b as one product
        left = np.column_stack([q, (q * q).sum(1), np.ones(len(q))])
        return left @ np.column_stack([-2 * b, np.ones(len(b)), (b * b).sum(1)]).T
    dots = q @ b.T
    if metric == "IP":
        return np.negative(dots, out=dots)
    if metric == "COSINE":
        norms = -np.sqrt((q * q).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(norms < 0, dots / norms, np.inf) if (norms == 0).any() else np.divide(dots, norms, out=dots)
    either = (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :] - dots
    return -np.where(either > 0, dots / np.maximum(either, 1), 1.0)


def _distances(q: np.ndarray, base: np.ndarray, qi: np.ndarray, bi: np.ndarray) -> np.ndarray:
    """L2 distances of the pairs (q[qi], base[bi]), by differences."""
    out = np.empty(len(qi))
    step = max(1, _VALUES // max(1, q.shape[1]))
    for at in range(0, len(qi), step):
        gap = q[qi[at : at + step]] - base[bi[at : at + step]]
        out[at : at + step] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _true_places(flags: np.ndarray) -> np.ndarray:
    """Places of the few true ones among ``flags``, whose number 8 divides: looked for eight at a time."""
    words = np.flatnonzero(flags.view(np.uint64))
    word, byte = np.nonzero(flags.reshape(-1, 8)[words])
    return words[word] * 8 + byte


def _merged(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, id, rank from 0) of the k best of each query in ``parts`` (query, score, id); a row that comes twice counts once."""
    q, score, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((ids, score, q))
    q, score, ids = q[order], score[order], ids[order]
    once = np.r_[True, (q[1:] != q[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])][: len(q)]
    q, score, ids = q[once], score[once], ids[once]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    keep = rank < k
    return q[keep], score[keep], ids[keep], rank[keep]


class Best:
    """Running k best base rows for each query of a block; a row offered twice counts once."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.queries, self.k, self.metric = queries, k, metric
        self.finite = np.isfinite(queries).all(axis=1) if queries.size else np.ones(len(queries), bool)
        self.norms = np.sqrt((queries * queries).sum(1)) if metric == "L2" else None
        self.worst = np.full(len(queries), np.inf)
        self._kept: tuple | None = None
        self._pending: list[tuple] = []
        self._waiting = 0
        self._last: np.ndarray | None = None  # the id at place k, where ids are numbers

    def offer(self, ids: np.ndarray, base: np.ndarray, members: np.ndarray | None = None):
        """Score base rows against the queries ``members`` (all when None).

        Rows and queries that are not finite take no part.
        """
        members = np.arange(len(self.queries)) if members is None else members
        members = members[self.finite[members]]
        fits = np.isfinite(base).all(axis=1)
        if not fits.all():
            ids, base = ids[fits], base[fits]
        if not len(members) or not len(ids):
            return
        if self.metric == "L2" and type(self) is Best:
            self._offer_near(ids, base, members)
            return
        for first in range(0, len(members), _QUERIES):
            some = members[first : first + _QUERIES]
            width = max(1, _CELLS // len(some))
            ready = self._prepared(some, min(width, len(ids)))
            for start in range(0, len(ids), width):
                self._offer_block(ids[start : start + width], base[start : start + width], some, ready)
                # Merged early, so that what waits does not grow with the rows offered.
                if self._waiting > max(_PENDING, 0 if self._kept is None else len(self._kept[0])):
                    self.settle()

    def _prepared(self, members: np.ndarray, width: int):
        """What the queries ``members`` need for blocks of ``width`` rows."""
        return self.queries[members]

    def _near(self, costs: np.ndarray, members: np.ndarray, scale: np.ndarray, squared: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places (query, row) of all costs that may be among the k best, a little wider than the k-th score."""
        slack = 2e-6 * scale
        limit = self.worst[members] + slack
        near = costs <= (limit * limit if squared else limit)[:, None]
        if costs.shape[1] >= self.k and np.count_nonzero(near) > 2 * self.k * len(members):
            least = np.partition(costs, self.k - 1, axis=1)[:, : self.k]
            if not np.isfinite(least).all():
                costs[~np.isfinite(costs)] = np.inf
                least = np.partition(costs, self.k - 1, axis=1)[:, : self.k]
            nth = least[:, self.k - 1]
            limit = np.minimum(limit, (np.sqrt(np.maximum(nth, 0.0)) if squared else nth) + slack)
            near = costs <= (limit * limit if squared else limit)[:, None]
        qi, bi = np.divmod(np.flatnonzero(near), near.shape[1])
        finite = np.isfinite(costs[qi, bi])
        return (qi, bi) if finite.all() else (qi[finite], bi[finite])

    def _wait(self, members: np.ndarray, scores: np.ndarray, ids: np.ndarray):
        scores = np.round(scores, DIGITS) + 0.0
        if self._last is not None:
            worst = self.worst[members]
            better = (scores < worst) | ((scores == worst) & (ids <= self._last[members]))
            members, scores, ids = members[better], scores[better], ids[better]
        self._pending.append((members, scores, ids))
        self._waiting += len(ids)

    def _offer_block(self, ids, base, members, q):
        costs = _score_matrix(q, base, self.metric)
        qi, bi = self._near(costs, members, np.ones(len(members)), False)
        if len(qi):
            self._wait(members[qi], costs[qi, bi], ids[bi])

    def _offer_near(self, ids: np.ndarray, base: np.ndarray, members: np.ndarray):
        """``offer`` by L2 distance: a product says which rows may be near, differences give their scores.

        The product is of single precision once every query of a group has k rows, with limits widened by what
        rounding can do, so it leaves out no row; a block in which it lets too many pass is taken in double precision.
        """
        center = base.mean(axis=0)
        moved = base - center
        sizes = (moved * moved).sum(1)
        largest = np.sqrt((base * base).sum(1).max())  # rows nearer the origin than this
        right = np.column_stack([-2 * moved, np.ones(len(moved)), sizes]).astype(np.float32)
        del moved
        width = min(len(ids), max(1, _CELLS // min(_QUERIES, len(members))))
        held = min(_QUERIES, len(members)) * width
        costs, flags = np.empty(held, np.float32), np.zeros(held + 8, bool)
        for first in range(0, len(members), _QUERIES):
            some = members[first : first + _QUERIES]
            q, limit, kept, waiting = self.queries[some], self.worst[some], None, []
            moved = q - center
            own = (moved * moved).sum(1)
            reach = max(own.max(), sizes.max())
            error = 4 * (q.shape[1] + 8) * _ROUNDING * reach
            left = np.column_stack([moved, own, np.ones(len(q))]).astype(np.float32)
            scale = 1 + np.maximum(self.norms[some], largest)
            start = 0
            while start < len(ids):
                known = np.isfinite(limit).all() and reach < 1e30
                stop = min(len(ids), start + (width if start == 0 and (known or len(ids) <= width) else min(width, max(start, _FIRST))))
                at = None
                if known:
                    cells = len(some) * (stop - start)
                    block = np.matmul(left, right[start:stop].T, out=costs[:cells].reshape(len(some), -1))
                    wide = np.nextafter(((limit + 2e-6 * scale) ** 2 + error).astype(np.float32), np.float32(np.inf))
                    flags[cells : cells + 8] = False
                    np.less_equal(block, wide[:, None], out=flags[:cells].reshape(len(some), -1))
                    at = _true_places(flags[: -(-cells // 8) * 8])
                if at is not None and len(at) <= max(2 * self.k * len(some), cells // 8):
                    qi, bi = np.divmod(at, stop - start)
                else:
                    qi, bi = self._near(_score_matrix(q, base[start:stop], "L2"), some, scale, True)
                score = np.round(_distances(q, base[start:stop], qi, bi), DIGITS) + 0.0
                near = score <= limit[qi]
                waiting.append((qi[near], score[near], ids[start:stop][bi[near]]))
                start = stop
                if start == len(ids) or kept is None or sum(len(w[0]) for w in waiting) > len(kept[0]):
                    kept, waiting = _merged(waiting + ([kept] if kept is not None else []), self.k), []
                    full = kept[3] == self.k - 1
                    limit[kept[0][full]] = np.minimum(limit[kept[0][full]], kept[1][full])
                    kept = kept[:3]
            self._wait(some[kept[0]], kept[1], kept[2])
            if self._waiting > max(_PENDING, 0 if self._kept is None else len(self._kept[0])):
                self.settle()

    def settle(self):
        """Merge what was offered since the last call."""
        if not self._pending:
            return
        q, score, ids, rank = _merged(self._pending + ([self._kept] if self._kept is not None else []), self.k)
        full = rank == self.k - 1
        self.worst[q[full]] = score[full]
        if ids.dtype.kind in "iu":
            self._last = np.zeros(len(self.queries), ids.dtype) if self._last is None else self._last
            self._last[q[full]] = ids[full]
        self._kept, self._pending, self._waiting = (q, score, ids), [], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, id, score) of the k best, score in its natural sign."""
        self.settle()
        if self._kept is None:
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        q, score, ids = self._kept
        return q, ids, score if ASCENDING[self.metric] else 0.0 - score


def nearest(queries: np.ndarray, base: np.ndarray, k: int, metric: str = "L2") -> np.ndarray:
    """Row numbers of the k best base rows of each query, best first; -1 where there is none."""
    k = min(k, len(base))
    best = Best(queries, k, metric)
    best.offer(np.arange(len(base)), base)
    q, ids, _ = best.rows()
    out = np.full((len(queries), k), -1)
    first = np.searchsorted(q, np.arange(len(queries)))
    out[q, np.arange(len(q)) - first[q]] = ids
    return out


def nearest_one(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Row number of the nearest of ``words`` by rounded L2 distance, ties to the smaller; -1 for rows that are not finite."""
    out = np.full(len(rows), -1)
    good = np.flatnonzero(np.isfinite(rows).all(axis=1)) if rows.size or len(rows) else np.empty(0, int)
    own = np.sqrt((words * words).sum(1))
    step = max(1, _CELLS // max(1, len(words)))
    for at in range(0, len(good), step):
        block = rows[good[at : at + step]]
        size = (block * block).sum(1)
        gaps = np.sqrt(np.maximum(size[:, None] + (own * own)[None, :] - 2 * (block @ words.T), 0.0))
        scale = 1 + np.maximum(np.sqrt(size), own.max())
        near = gaps <= gaps.min(axis=1)[:, None] + 2e-6 * scale[:, None]
        won = near.argmax(axis=1)
        doubt = np.flatnonzero(near.sum(axis=1) > 1)
        if len(doubt):  # the matrix form loses digits: these are told apart by differences
            i, j = np.nonzero(near[doubt])
            gap = block[doubt[i]] - words[j]
            exact = np.full((len(doubt), len(words)), np.inf)
            exact[i, j] = np.round(np.sqrt(np.einsum("ij,ij->i", gap, gap)), DIGITS)
            won[doubt] = exact.argmin(axis=1)
        out[good[at : at + step]] = won
    return out


def near_pairs(rows: np.ndarray, sizes: np.ndarray, limits: np.ndarray, m: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, cost): the ``m`` best others of each row in its own group, of a cost within its limit.

    Groups are runs of ``sizes`` rows; callers bound them. Costs are rounded scores, smaller is better; ties go to the
    row that comes first. A row itself takes one of ``m`` + 1 places where it is among these. Rows that are not finite take no part.
    """
    squared = metric == "L2"
    norms = np.sqrt((rows * rows).sum(1)) if rows.size else np.zeros(len(rows))
    slack = 2e-6 * (1 + norms[np.isfinite(norms)].max(initial=0.0)) if squared else 2e-6
    open_to = limits + slack
    if squared:
        open_to = np.where(open_to < 0, -np.inf, open_to * open_to)
    src, dst, cost = [], [], []
    with np.errstate(invalid="ignore", over="ignore"):
        for first, size in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
            some = slice(first, first + size)
            costs = _score_matrix(rows[some], rows[some], metric)
            at = np.flatnonzero(costs <= open_to[some, None])
            qi, bi = np.divmod(at, size)
            src.append(first + qi)
            dst.append(first + bi)
            if not squared:
                cost.append(costs.ravel()[at])
        src, dst = (np.concatenate(x) if x else np.empty(0, int) for x in (src, dst))
        if squared:  # the matrix form loses digits near zero: scored by differences
            exact = _distances(rows, rows, src, dst)
        else:
            exact = np.concatenate(cost) if cost else np.empty(0)
    exact = np.round(exact, DIGITS) + 0.0
    keep = np.isfinite(exact) & (exact <= limits[src])
    src, dst, exact = src[keep], dst[keep], exact[keep]
    order = np.lexsort((dst, exact, src))
    src, dst, exact = src[order], dst[order], exact[order]
    first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else np.empty(0, int)
    rank = np.arange(len(src)) - np.repeat(first, np.diff(np.r_[first, len(src)]))
    keep = (rank <= m) & (src != dst)
    return src[keep], dst[keep], exact[keep]


class TableBest(Best):
    """``Best`` over code bytes: a row's score is looked up, not computed.

    For each query and sub-vector a table says what every codeword adds to the
    score; a row adds up one entry per code byte. The tables of two neighbouring sub-vectors are
    added up front where a block of rows is longer than their entries.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str, words: np.ndarray):
        super().__init__(queries, k, metric)
        if metric not in ("L2", "IP", "COSINE"):
            raise ValueError(f"codes have no {metric} scores")
        self.words, self.sizes = words, (words * words).sum(axis=2)  # sub, code

    def _prepared(self, members, width):
        words, queries = self.words, self.queries[members]
        split = queries.reshape(len(queries), len(words), -1)
        tables = np.einsum("qsw,scw->scq", split, words, optimize=True)
        if self.metric == "L2":
            tables = (split * split).sum(axis=2).T[:, None, :] + self.sizes[:, :, None] - 2 * tables
            # sums of squares lose digits near zero: small entries are taken from differences
            s, c, q = np.nonzero(tables < 1e-6 * (1 + self.sizes[:, :, None]))
            gap = split[q, s] - words[s, c]
            tables[s, c, q] = np.einsum("ij,ij->i", gap, gap)
        else:
            tables = -tables
        if self.metric == "COSINE":
            norms = np.sqrt((queries * queries).sum(1))
            tables = np.divide(tables, norms, out=np.full_like(tables, np.inf), where=norms > 0)
        codes = tables.shape[1]
        paired = width >= 2 * codes * codes and len(tables) % 2 == 0
        if paired:
            tables = (tables[0::2, :, None, :] + tables[1::2, None, :, :]).reshape(len(tables) // 2, codes * codes, -1)
        return np.ascontiguousarray(tables), paired

    def _offer_block(self, ids, base, members, ready):
        tables, paired = ready
        at = [base[:, s] for s in range(base.shape[1])]
        if paired:
            at = [a.astype(np.int64) * self.words.shape[1] + b for a, b in zip(at[0::2], at[1::2], strict=True)]
        costs = np.empty((len(members), len(base)))
        for first in range(0, len(base), _ADDED):  # few rows at a time, so that their sums stay in the cache
            some = slice(first, first + _ADDED)
            total = tables[0][at[0][some]]
            for table, place in zip(tables[1:], at[1:], strict=True):
                total += table[place[some]]
            costs[:, some] = total.T
        if self.metric == "COSINE":
            size = np.sqrt(sum(own[base[:, s]] for s, own in enumerate(self.sizes)))
            with np.errstate(divide="ignore", invalid="ignore"):
                costs /= size
            costs[:, ~(size > 0)] = np.inf
        squared = self.metric == "L2"
        qi, bi = self._near(costs, members, np.ones(len(members)), squared)
        if len(qi):
            found = costs[qi, bi]
            self._wait(members[qi], np.sqrt(np.maximum(found, 0.0)) if squared else found, ids[bi])


def pair_scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Scores of row i of a against row i of b; NaN where undefined."""
    if metric == "L2":
        return np.sqrt(np.einsum("ij,ij->i", a - b, a - b))
    dots = np.einsum("ij,ij->i", a, b)
    if metric == "IP":
        return dots
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    if metric == "HAMMING":
        return aa + bb - 2 * dots
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "COSINE":
            return dots / (np.sqrt(aa) * np.sqrt(bb))
        return np.where(aa + bb > 0, dots / (aa + bb - dots), 1.0)
