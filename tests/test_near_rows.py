"""The product that finds near rows is of single precision: no row may be lost to it, and few may pass."""

from __future__ import annotations

import numpy as np
import pytest

from vectable.functions import topk


def exact(asked, rows, ids, k):
    found = []
    for n, q in enumerate(asked):
        score = np.round(np.sqrt(((rows - q) ** 2).sum(1)), 6)
        order = np.lexsort((ids, score))[:k]
        found += [(n, int(ids[i]), float(score[i])) for i in order]
    return found


@pytest.mark.parametrize("kind", ["plain", "far from the origin", "whole numbers", "copies", "tiny", "all scales"])
def test_rows_of_many_blocks(kind):
    drawn = np.random.default_rng(9)
    asked, rows = drawn.normal(size=(300, 12)), drawn.normal(size=(9000, 12))
    if kind == "far from the origin":
        asked, rows = asked + 1e4, rows + 1e4
    if kind == "whole numbers":
        asked, rows = np.round(asked), np.round(rows)
    if kind == "copies":
        rows = rows[drawn.integers(0, 200, size=len(rows))]
        asked[:100] = rows[:100]
    if kind == "tiny":
        asked, rows = asked * 1e-5, rows * 1e-5
    if kind == "all scales":
        asked, rows = (x * 10 ** drawn.uniform(-8, 8, size=(len(x), 1)) for x in (asked, rows))
    ids = drawn.permutation(len(rows))
    best = topk.Best(asked, 7, "L2")
    for some in np.array_split(np.arange(len(rows)), [5000]):
        best.offer(ids[some], rows[some])
    q, found, score = best.rows()
    some = [*range(0, 300, 7)]
    wanted = exact(asked[some], rows, ids, 7)
    got = [(some.index(n), i, s) for n, i, s in zip(q.tolist(), found.tolist(), score.tolist(), strict=True) if n in some]
    assert [g[:2] for g in got] == [w[:2] for w in wanted]
    assert np.allclose([g[2] for g in got], [w[2] for w in wanted], rtol=1e-12, atol=1.1e-6)


def test_few_rows_are_scored_twice(monkeypatch):
    """Limits tighten while a group of queries meets its rows: blocks are not selected from one by one."""
    drawn = np.random.default_rng(4)
    asked, rows = drawn.normal(size=(256, 16)), drawn.normal(size=(40_000, 16))
    sorted_cells = []

    def partition(costs, *args, of=np.partition, **kwargs):
        sorted_cells.append(costs.size)
        return of(costs, *args, **kwargs)

    monkeypatch.setattr(np, "partition", partition)
    best = topk.Best(asked, 10, "L2")
    best.offer(np.arange(len(rows)), rows)
    assert len(best.rows()[0]) == 2560
    assert sum(sorted_cells) <= 256 * 1024
