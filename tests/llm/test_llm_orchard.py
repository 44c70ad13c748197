"""Codes by Orchard search: equal to plain k-means on integers, odd rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectable.llm import orchard

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(codebooks, {row number: (code, error)}) by comparing every part with every entry."""
    held = [(n, i, [math.floor(float(np.float32(x)) * scale) for x in v]) for n, (i, v, _) in enumerate(rows)]
    width = -(-len(held[0][2]) // parts)
    cut = lambda v, p: (v + [0] * (width * parts - len(v)))[p * width : (p + 1) * width]
    first = {}
    for _, i, v in held:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    books = [[cut(first[i], p) for i in sorted(first)[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            sums = {}
            for _, _, v in held:
                sums.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, members in sums.items():
                books[p][e] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    out = {}
    for n, _, v in held:
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out[n] = "".join(f"{e:02x}" for _, e in best), min(sum(d for d, _ in best), 2**63 - 1)
    return books, out


def compare(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, n) for n, (i, v, _) in enumerate(rows)], SCHEMA).repartition(3)
    books = orchard.train(df, **settings)
    want_books, want = plain(rows, **settings)
    assert [book.tolist() for book in books.books] == want_books
    got = orchard.encode(df, books).collect()
    assert {r.label: (r.code, r.error) for r in got} == want
    return df, books


@pytest.mark.parametrize(("dim", "spread"), [(16, 1.0), (13, 0.001), (3, 40.0), (16, 1e30)])
def test_equal_to_plain_rounds(spark, dim, spread):
    random.seed(dim)
    rows = [(random.randint(0, 60) - 20, [random.gauss(0, spread) for _ in range(dim)], 0) for _ in range(150)]
    rows += [(None, [0.5] * dim, 0), rows[0], rows[0]]
    compare(spark, rows, rounds=3)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate([[0, 0], [2, 0], [0, 0], [1, 0], [1, 0], [-1, 0], [3, 5]])]
    compare(spark, rows, parts=1, entries=3, rounds=0)
    compare(spark, rows, parts=2, entries=4, rounds=2)


def test_search_visits_few_entries_and_finds_the_nearest():
    rng = np.random.default_rng(1)
    entries, points = rng.integers(-4000, 4000, (64, 4)), rng.integers(-4000, 4000, (500, 4))
    best, dist = orchard.Lists(entries).nearest(points)
    every = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (dist == every.min(1)).all()


def test_rows_that_do_not_fit_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [nan, 0.0], 1), (3, [inf, 0.0], 1), (4, [None, 0.0], None), (5, [1.0], 1), (6, [], 1)]
    good = [(10 + n, [n / 7, -n / 3], None) for n in range(20)]
    df = spark.createDataFrame(odd + good, SCHEMA).withColumns({"code": F.lit(1), "error": F.lit("x")})
    books = orchard.train(df, parts=2)
    got = orchard.encode(df, books)
    assert sorted(r.vec_id for r in got.collect()) == [10 + n for n in range(20)]
    back = orchard.decode(got, books).collect()
    for r in back:
        gap = [math.floor(float(np.float32(x)) * 4096) - round(y * 4096) for x, y in zip(r.embedding, r.decoded, strict=True)]
        assert sum(g * g for g in gap) == r.error


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert orchard.train(none) is None
    assert orchard.encode(none, None).columns == ["vec_id", "embedding", "label", "code", "error"]
    nameless = spark.createDataFrame([(None, [1.0, 2.0], 1)], SCHEMA)
    assert orchard.train(nameless) is None and orchard.encode(nameless, None).count() == 0
    hollow = spark.createDataFrame([(1, [], 1), (2, [], 1)], SCHEMA)
    assert [r.code for r in orchard.encode(hollow, orchard.train(hollow)).collect()] == ["00" * 8] * 2
