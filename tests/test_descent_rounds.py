"""Rounds of the descent: what they store and leave behind does not grow with the pool or with their number."""

from __future__ import annotations

import time

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from vectable import session
from vectable.functions import topk
from vectable.operators import graph


def table(spark, n=400):
    drawn = np.random.default_rng(11)
    return spark.createDataFrame([(i, [float(x) for x in drawn.normal(size=8)]) for i in range(n)], "id long, vector array<double>")


@pytest.mark.parametrize("fan", [4, 9])
def test_a_round_stores_the_edges_that_are_read(spark, monkeypatch, fan):
    base, stored = table(spark), []

    def counted(df, cut=session.cut):
        out = cut(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(session, "cut", counted)
    wide = rows(graph.nn_descent(base, 6, pool=200, iterations=3, fan=fan, stop=0.0))
    assert len(stored) == 4 and max(stored) <= 400 * max(6, fan)
    assert wide == rows(graph.nn_descent(base, 6, pool=max(6, fan), iterations=3, fan=fan, stop=0.0))


def shuffled(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_round_leaves_no_shuffle_files(spark):
    before, setting = shuffled(spark), spark.conf.get(session.SWEEP, None)
    spread = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("g")).count()
    out = session.swept(spread)
    until = time.time() + 20
    while shuffled(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert shuffled(spark) <= before
    assert out.count() == 7 and spread.count() == 7
    assert spark.conf.get(session.SWEEP, None) == setting


@pytest.mark.parametrize("metric", ["L2", "COSINE", "IP"])
def test_pairs_of_groups_are_those_of_the_search(metric):
    drawn = np.random.default_rng(3)
    sizes = drawn.integers(1, 30, size=40)
    vectors = np.round(drawn.normal(size=(sizes.sum(), 4)), 1)
    vectors[8], vectors[20], vectors[31, 0], vectors[5] = np.nan, 0.0, np.inf, vectors[6]
    limits = np.where(drawn.random(len(vectors)) < 0.3, np.inf, drawn.normal(size=len(vectors)) + (metric == "L2"))
    sign = 1.0 if topk.ASCENDING[metric] else -1.0
    wanted = set()
    for first, size in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
        some = slice(first, first + size)
        best = topk.Best(vectors[some], 6, metric)
        best.offer(np.arange(size), vectors[some])
        q, other, score = best.rows()
        at = (q != other) & (sign * score <= limits[some][q])
        wanted |= set(zip((first + q[at]).tolist(), (first + other[at]).tolist(), (sign * score[at]).tolist(), strict=True))
    src, dst, cost = topk.near_pairs(vectors, sizes, limits, 5, metric)
    assert set(zip(src.tolist(), dst.tolist(), cost.tolist(), strict=True)) == wanted
    assert len(src) == len(wanted) > 100
