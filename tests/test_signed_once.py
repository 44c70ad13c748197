"""Signatures are computed once, and shingle sets are dealt only where they are compared."""

from __future__ import annotations

from vectable.functions.text import shingles
from vectable.operators import neardup


def test_candidates_read_stored_bands(spark):
    texts = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "x y z")], "id int, text string")
    found = neardup.lsh_candidates(neardup.minhash(shingles(texts, "text", 3)))
    assert "md5" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.first_id, r.id) for r in found.collect()}
    assert rows == {(1, 2)} and found.count() == neardup.BANDS


def test_only_sets_in_buckets_are_dealt_again(spark, monkeypatch):
    held, stored = [], neardup.session.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "own":
            held.append(out.count())
        return out

    monkeypatch.setattr(neardup.session, "stored", counted)
    words = " ".join(f"w{n}" for n in range(60))
    alone = [(n, f"only{n} other{n} rare{n} word{n}") for n in range(10, 15)]
    texts = spark.createDataFrame([(1, words), (2, words + " more"), (3, words), *alone], "id int, text string")
    found = neardup.near_duplicates(texts, 0.7)
    assert {(r.id, r.first_id) for r in found.collect()} == {(2, 1), (3, 1)}
    assert held == [7, 2]
