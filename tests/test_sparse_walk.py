"""Sparse search with block bounds: same rows as plain scoring, and blocks that are left out."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows

from vectable.functions.blockmax import BLOCK_ROWS, Walk
from vectable.operators import sparse

VECTORS = "{} long, vector map<string, double>"


def some_vectors(n, seed, low):
    random.seed(seed)
    terms = [f"t{i}" for i in range(40)]
    out = [(i, {t: random.choice([low, 0.5, 1.0, 2.0, 3.25]) for t in random.sample(terms, random.randint(0, 8))}) for i in range(n)]
    return out + [(n + 1, None), (n + 2, {}), (n + 3, {"only": 1.0})]


def plain(base, asked, k):
    out = []
    for q, wanted in asked:
        met = []
        for i, held in base:
            shared = set(wanted or {}) & set(held or {})
            if shared:
                met.append((-round(sum(wanted[t] * held[t] for t in shared), 6) + 0.0, i))
        out += [(q, i, 0.0 - s, rank) for rank, (s, i) in enumerate(sorted(met)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("low", [0.25, -1.5, 0.0])
def test_both_forms_equal_plain_scoring(spark, monkeypatch, low):
    base, asked = some_vectors(700, 1, low), some_vectors(30, 2, low)
    postings = sparse.sparse_postings(spark.createDataFrame(base, VECTORS.format("id")), 0.0).repartition(5)
    queries = spark.createDataFrame(asked, VECTORS.format("query_id"))
    want = plain(base, asked, 7)
    assert rows(sparse.sparse_search_pruned(postings, queries, 7)) == want
    assert rows(sparse.sparse_search(postings, queries, 7)) == want
    monkeypatch.setattr(sparse, "MAX_BROADCAST_TERMS", 0)
    monkeypatch.setattr(sparse, "CELL_ENTRIES", 60)
    assert rows(sparse.sparse_search_pruned(postings, queries, 7)) == want


def test_no_rows_no_queries_no_k(spark):
    postings = sparse.sparse_postings(spark.createDataFrame(some_vectors(20, 1, 1.0), VECTORS.format("id")), 0.0)
    queries = spark.createDataFrame(some_vectors(3, 2, 1.0), VECTORS.format("query_id"))
    assert sparse.sparse_search_pruned(postings.limit(0), queries, 3).count() == 0
    assert sparse.sparse_search_pruned(postings, queries.limit(0), 3).count() == 0
    assert sparse.sparse_search_pruned(postings, queries, 0).count() == 0


def test_blocks_below_the_running_score_are_skipped():
    rng = np.random.default_rng(2)
    n = 40 * BLOCK_ROWS
    peaks = np.sort(rng.pareto(1.5, n))[::-1]
    lists = [rng.choice(50, 5, replace=False).astype(np.int64) for _ in range(n)]
    weights = [p * rng.uniform(0.5, 1, 5) for p in peaks]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(np.arange(n)), "terms": pa.array(lists), "weights": pa.array(weights)})
    walk = Walk(np.array([1, 2, 3, 7, 9]), np.array([1.0, 2.0, 0.5, 1.0, 1.0]), np.array([0, 3, 5]), 10)
    walk.offer(batch)
    assert walk.skipped > 3 * walk.scored
    query, ids, score = walk.rows()
    for q, wanted in enumerate(({1: 1.0, 2: 2.0, 3: 0.5}, {7: 1.0, 9: 1.0})):
        every = [round(sum(wanted.get(int(t), 0) * w for t, w in zip(a, b, strict=True)), 6) for a, b in zip(lists, weights, strict=True)]
        order = np.lexsort((np.arange(n), -np.array(every)))[:10]
        assert [i for i, x in zip(ids, query, strict=True) if x == q] == order.tolist()
        assert score[query == q] == pytest.approx(np.array(every)[order])
