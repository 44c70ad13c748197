"""Near-duplicates in a bucket of many texts: linear in its size, and nothing lost."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from vectable.operators import neardup

SHARED = 12


def bucket(spark, n, planted=()):
    """(own, members): n texts of one bucket with 12 shingles of all and 28 of their own; copies of ``planted`` differ in one."""
    base = spark.range(n).select("id")
    own = F.concat(
        F.sequence(F.lit(1).cast("bigint"), F.lit(SHARED).cast("bigint")),
        F.transform(F.sequence(F.lit(0), F.lit(27)), lambda k: F.col("id") * 1000 + 10**6 + k),
    )
    sets = base.select("id", F.sort_array(own).alias("shingles"))
    if planted:
        first = sets.filter(F.col("id").isin([a for a, _ in planted]))
        copies = spark.createDataFrame(list(planted), "id long, copy long").join(first, "id")
        copies = copies.select(F.col("copy").alias("id"), F.sort_array(F.concat(F.slice("shingles", 1, 39), F.array(F.lit(1).cast("bigint") - F.col("copy")))).alias("shingles"))
        sets = sets.unionByName(copies)
    count = sets.count()
    key = F.array(*(F.lit(x).cast("bigint") for x in (1, 2, 3, 4)))
    members = sets.select(F.lit(0).alias("band"), key.alias("key"), "id", F.size("shingles").alias("size"), F.lit(count).cast("bigint").alias("n"))
    return sets, members


@pytest.mark.parametrize("n", [5_000, 20_000])
def test_texts_that_never_match_are_not_compared(spark, n):
    own, members = bucket(spark, n)
    assert neardup._cut_buckets(own, members, 0.7).count() == 0


def test_planted_copies_are_found_and_compared_rows_grow_with_them(spark):
    planted = [(i, 100_000 + 10 * i + c) for i in range(0, 300, 7) for c in range(1 + i % 3)]
    for n in (2_000, 4_000):
        own, members = bucket(spark, n, planted)
        cut = neardup._cut_buckets(own, members, 0.7)
        touched = len({a for a, _ in planted}) + len(planted)
        assert cut.select("id").distinct().count() == touched
        assert cut.agg(F.max("n")).first()[0] <= 4
        found = rows(neardup._earliest(own, cut, 0.7))
        assert [(i, f) for i, f, _ in found] == sorted((copy, first) for first, copy in planted)


def test_cut_buckets_give_the_same_answers(spark, monkeypatch):
    random.seed(2)
    words = [f"w{i}" for i in range(30)]
    base = [" ".join(random.choices(words, k=20)) for _ in range(12)]
    texts = [(i, " ".join(random.choice([w, w, w, w, w, random.choice(words)]) for w in random.choice(base).split())) for i in range(150)]
    df = spark.createDataFrame(texts, "id long, text string")
    want = rows(neardup.near_duplicates(df, 0.5))
    assert len(want) > 20
    monkeypatch.setattr(neardup, "HOT_MEMBERS", 2)
    assert rows(neardup.near_duplicates(df, 0.5)) == want
