"""Walk of sparse rows past a block of sparse queries, skipping row blocks that cannot matter.

Rows come in order of falling peak weight, in blocks of ``BLOCK_ROWS``. A block
carries the largest and smallest weight of each of its terms; what these allow a query at most is
compared with the query's running k-th score, and only blocks that may reach it are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from vectable.functions.topk import DIGITS, keys

BLOCK_ROWS = 256
QUERY_ROWS = 64
_MARGIN = 2e-6  # scores are rounded to six decimals


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, first entry of each row and the end) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Walk:
    """Running k best rows of each query; ``scored`` and ``skipped`` count (query, block) pairs."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, first: np.ndarray, k: int):
        self.names, self.term = np.unique(terms, return_inverse=True)
        self.weight, self.first, self.k = weights.astype(np.float64), first, k
        self.kth = np.full(len(first) - 1, -np.inf)
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(self.kth)
        self.scored = self.skipped = 0
        self.positive = bool((self.weight > 0).all())

    def offer(self, batch: pa.RecordBatch | pa.Table) -> None:
        """Rows (id, terms, weights), the terms of a row once each."""
        if not batch.num_rows or not len(self.names):
            return
        ids = keys(batch.column("id"))
        terms, first = entries(batch.column("terms"))
        weights, _ = entries(batch.column("weights"))
        at = np.minimum(np.searchsorted(self.names, terms), len(self.names) - 1)
        known = self.names[at] == terms
        row = np.repeat(np.arange(len(ids)), np.diff(first))
        at, row, weights = at[known], row[known], weights[known].astype(np.float64)
        for low in range(0, len(ids), BLOCK_ROWS):
            a, b = np.searchsorted(row, [low, low + BLOCK_ROWS])
            if b > a:
                self._block(ids[low : low + BLOCK_ROWS], row[a:b] - low, at[a:b], weights[a:b])

    def _block(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        held, at = np.unique(term, return_inverse=True)
        high, low = np.zeros(len(held)), np.zeros(len(held))
        np.maximum.at(high, at, weight)
        np.minimum.at(low, at, weight)
        place = np.full(len(self.names), -1)
        place[held] = np.arange(len(held))
        mine = place[self.term]
        there = mine >= 0
        most = np.where(self.weight > 0, high[mine], low[mine]) * self.weight
        edge = np.concatenate([[0], np.cumsum(there)])
        shares = edge[self.first[1:]] > edge[self.first[:-1]]
        bound = np.diff(np.concatenate([[0], np.cumsum(np.where(there, most, 0.0))])[self.first])
        near = shares & (bound >= self.kth - _MARGIN * (1 + np.abs(self.kth, where=np.isfinite(self.kth), out=np.zeros(len(self.kth)))))
        self.scored += int(near.sum())
        self.skipped += int((shares & ~near).sum())
        asked = np.flatnonzero(near)
        rows = np.zeros((len(ids), len(held)))
        rows[row, at] = weight
        positive = self.positive and bool((weight > 0).all())
        for start in range(0, len(asked), QUERY_ROWS):
            part = asked[start : start + QUERY_ROWS]
            sizes = self.first[part + 1] - self.first[part]
            entry = np.repeat(self.first[part] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            owner = np.repeat(np.arange(len(part)), sizes)
            owner, entry = owner[there[entry]], entry[there[entry]]
            query = np.zeros((len(part), len(held)))
            query[owner, mine[entry]] = self.weight[entry]
            score = np.round(query @ rows.T, DIGITS) + 0.0
            if positive:
                met = score > 0
            else:  # weights may cancel: a row counts as soon as it has a term of the query
                has, wants = np.zeros(rows.shape, np.float32), np.zeros(query.shape, np.float32)
                has[row, at] = wants[owner, mine[entry]] = 1
                met = wants @ has.T > 0
            met &= score >= self.kth[part, None]
            for n in np.flatnonzero(met.any(axis=1)):
                self._merge(part[n], ids[met[n]], score[n, met[n]])

    def _merge(self, query: int, ids: np.ndarray, score: np.ndarray) -> None:
        if self.best[query] is not None:
            ids, score = np.concatenate([self.best[query][0], ids]), np.concatenate([self.best[query][1], score])
        order = np.lexsort((ids, -score))[: self.k]
        self.best[query] = ids[order], score[order]
        if len(order) == self.k:
            self.kth[query] = score[order[-1]]

    def rows(self) -> tuple[np.ndarray, list, np.ndarray]:
        """(query number, id, score) of the k best."""
        held = [(q, *both) for q, both in enumerate(self.best) if both is not None]
        query = np.concatenate([np.full(len(ids), q) for q, ids, _ in held] or [np.empty(0, int)])
        return query, [i for _, ids, _ in held for i in ids.tolist()], np.concatenate([s for _, _, s in held] or [np.empty(0)])
