"""What the inner step of a search holds does not grow with the rows that it is offered."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from vectable.functions import topk

MB = 1024 * 1024


def peak_of(best, ids, rows):
    tracemalloc.start()
    best.offer(ids, rows)
    found = best.rows()
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found, held


@pytest.mark.parametrize("metric", ["L2", "COSINE", "IP"])
def test_many_queries_hold_little(metric):
    drawn = np.random.default_rng(1)
    asked, rows = drawn.normal(size=(8000, 4)), drawn.normal(size=(20_000, 4))
    rows[100:110] = asked[:10]
    (q, ids, score), held = peak_of(topk.Best(asked, 10, metric), np.arange(len(rows)), rows)
    assert held < 120 * MB
    for at in (0, 3, 7999):
        exact = rows @ asked[at]
        if metric == "L2":
            exact = np.sqrt(((rows - asked[at]) ** 2).sum(1))
        elif metric == "COSINE":
            exact = exact / np.sqrt((rows * rows).sum(1)) / np.sqrt(asked[at] @ asked[at])
        exact = np.round(exact, 6) + 0.0
        order = np.lexsort((np.arange(len(rows)), exact if metric == "L2" else -exact))[:10]
        assert ids[q == at].tolist() == order.tolist()
        assert score[q == at].tolist() == exact[order].tolist()


def test_tables_are_built_for_few_queries_at_a_time():
    drawn = np.random.default_rng(2)
    words, asked = drawn.normal(size=(4, 256, 2)), drawn.normal(size=(20_000, 8))
    codes = drawn.integers(0, 256, size=(500, 4)).astype(np.uint8)
    (q, ids, score), held = peak_of(topk.TableBest(asked, 5, "L2", words), np.arange(500), codes)
    assert held < 100 * MB
    rebuilt = np.concatenate([words[s][codes[:, s]] for s in range(4)], axis=1)
    exact = np.round(np.sqrt(((rebuilt - asked[77]) ** 2).sum(1)), 6)
    assert ids[q == 77].tolist() == np.lexsort((np.arange(500), exact))[:5].tolist()


@pytest.mark.parametrize("metric", ["L2", "COSINE", "IP"])
def test_coded_scores_are_held_once(metric):
    """A block of coded rows is scored in its place: beside its scores there is one copy, to select from."""
    drawn = np.random.default_rng(3)
    words, asked = drawn.normal(size=(4, 10, 2)), drawn.normal(size=(topk._QUERIES, 8))
    codes = drawn.integers(0, 10, size=(topk._CELLS // topk._QUERIES, 4)).astype(np.uint8)
    (q, ids, score), held = peak_of(topk.TableBest(asked, 5, metric, words), np.arange(len(codes)), codes)
    assert held < 2.6 * 8 * topk._CELLS
    rebuilt = np.concatenate([words[s][codes[:, s]] for s in range(4)], axis=1)
    for at in (0, 100, len(asked) - 1):
        exact = rebuilt @ asked[at]
        if metric == "L2":
            exact = np.sqrt(((rebuilt - asked[at]) ** 2).sum(1))
        elif metric == "COSINE":
            exact = exact / np.sqrt((rebuilt * rebuilt).sum(1)) / np.sqrt(asked[at] @ asked[at])
        exact = np.round(exact, 6) + 0.0
        order = np.lexsort((np.arange(len(codes)), exact if metric == "L2" else -exact))[:5]
        assert ids[q == at].tolist() == order.tolist()
        assert score[q == at].tolist() == exact[order].tolist()


def test_copies_at_the_last_place_do_not_wait():
    """Of rows that are all alike only those of smaller ids than the kept ones come in."""
    best = topk.Best(np.zeros((300, 4)), 3, "L2")
    rows = np.zeros((2000, 4))
    best.offer(np.arange(4000, 6000), rows)
    best.settle()
    best.offer(np.arange(6000, 8000), rows)
    assert not sum(len(part[0]) for part in best._pending)
    best.offer(np.arange(10, 2010), rows)
    assert best.rows()[1].reshape(300, 3).tolist() == [[10, 11, 12]] * 300
