"""Codes for inner products: loss, errors of the best pairs, recall, odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from vectable.functions import topk
from vectable.operators import anisotropic, ivf

SCHEMA = "id long, vector array<double>"


def decoded(rows, words):
    codes = np.array([list(bytes(r)) for r in rows])
    return words[np.arange(len(words)), codes].reshape(len(codes), -1)


def loss_of(x, y, weight):
    r = x - y
    return (r * r).sum(1) + (weight - 1) * (r * x).sum(1) ** 2 / (x * x).sum(1)


def test_one_sweep_takes_the_least_loss_given_the_other_sub_vectors():
    rng = np.random.default_rng(4)
    rows, words, weight = rng.normal(size=(50, 12)), rng.normal(size=(3, 7, 4)), 5.0
    got = anisotropic.chosen(rows, words, weight, sweeps=1)
    codes = np.stack([topk.nearest_one(rows.reshape(50, 3, 4)[:, s], words[s]) for s in range(3)], axis=1)
    for s in range(3):
        losses = []
        for c in range(7):
            tried = codes.copy()
            tried[:, s] = c
            losses.append(loss_of(rows, words[np.arange(3), tried].reshape(50, 12), weight))
        codes[:, s] = np.array(losses).argmin(axis=0)
    assert (got == codes).all()
    assert (anisotropic.chosen(rows, words, 1.0) == np.stack([topk.nearest_one(rows.reshape(50, 3, 4)[:, s], words[s]) for s in range(3)], axis=1)).all()


def test_best_pairs_keep_their_scores_better_than_under_plain_codes(spark, sf_dir):
    stored = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet")
    base = stored.selectExpr("vec_id as id", "transform(embedding, x -> x * (1.0D + vec_id % 7)) as vector").cache()
    plain = ivf.pq_train(base, 8, 4, iterations=10)
    weight = anisotropic.along_weight(64, 0.5)
    weighed = anisotropic.anisotropic_train(base, 8, 4, start=plain, weight=weight)
    held = {r.id: np.array(r.vector, float) for r in base.collect()}
    ids = sorted(held)
    x = np.array([held[i] for i in ids])
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :10]
    q, near = np.repeat(np.arange(len(x)), 10), best.ravel()
    result = {}
    for name, books, coded in (
        ("plain", plain, ivf.pq_encode(base, plain)),
        ("weighed", weighed, anisotropic.anisotropic_encode(base, weighed, weight)),
    ):
        rows = {r.id: r.code for r in coded.collect()}
        assert all(len(c) == 8 for c in rows.values())
        y = decoded([rows[i] for i in ids], ivf._codebook_arrays(books))
        found = x @ y.T
        np.fill_diagonal(found, -np.inf)
        top = np.argsort(-found, axis=1, kind="stable")[:, :10]
        hits = np.mean([len(set(a) & set(b)) for a, b in zip(top, best, strict=True)]) / 10
        result[name] = hits, float(((x[q] * (x[near] - y[near])).sum(1) ** 2).mean()), float(loss_of(x, y, weight).sum())
    assert result["weighed"][1] < 0.6 * result["plain"][1]
    assert result["weighed"][2] < result["plain"][2]
    assert result["weighed"][0] >= result["plain"][0]


def test_odd_rows(spark):
    words = spark.createDataFrame([(s, c, [float(c), float(-c)]) for s in range(2) for c in range(3)], "sub int, code int, centroid array<double>")
    rows = [(1, [0.0] * 4), (2, None), (3, [1.0]), (4, [float("nan"), 0.0, 0.0, 0.0]), (5, [1.0, None, 0.0, 0.0]), (6, [2.0, -2.0, 1.0, -1.0]), (6, [2.0, -2.0, 1.0, -1.0])]
    got = anisotropic.anisotropic_encode(spark.createDataFrame(rows, SCHEMA), words).collect()
    assert sorted((r.id, list(bytes(r.code))) for r in got) == [(1, [0, 0]), (6, [2, 1]), (6, [2, 1])]
    assert anisotropic.anisotropic_encode(spark.createDataFrame([], SCHEMA), words).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        anisotropic.along_weight(8, 1.0)
    assert anisotropic.along_weight(2, 0.0) == 1.0
