from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from vectable.functions.text import shingles
from vectable.operators import neardup, sparse, textsearch

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def sparse_table(spark, n, id_col, seed, signed):
    draw = random.Random(seed)
    low = -3.0 if signed else 0.1
    data = [(i, {w: round(draw.uniform(low, 3.0), 3) for w in draw.sample(WORDS, draw.randint(0, 8))}) for i in range(n)]
    return data, spark.createDataFrame(data, f"{id_col} long, vector map<string,double>")


@pytest.mark.parametrize("signed", [False, True])
def test_pruned_search_equals_brute_force(spark, signed):
    docs, stored = sparse_table(spark, 120, "id", 1, signed)
    asked, queries = sparse_table(spark, 15, "query_id", 2, signed)
    postings = sparse.sparse_postings(stored, 0.0)
    want = []
    for q, qv in asked:
        scored = [(round(sum(qv[t] * dv[t] for t in qv if t in dv), 6) + 0.0, d) for d, dv in docs if set(qv) & set(dv)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        want += [(q, d, s, r + 1) for r, (s, d) in enumerate(scored[:4])]
    assert rows(sparse.sparse_search(postings, queries, 4)) == sorted(want)
    assert rows(sparse.sparse_search_pruned(postings, queries, 4)) == sorted(want)


def test_large_query_side_with_hot_terms(spark, monkeypatch):
    _, stored = sparse_table(spark, 120, "id", 1, False)
    _, queries = sparse_table(spark, 15, "query_id", 2, False)
    postings = sparse.sparse_postings(stored)
    plain = rows(sparse.sparse_search(postings, queries, 4))
    monkeypatch.setattr(sparse, "MAX_BROADCAST_TERMS", 0)
    monkeypatch.setattr(sparse, "HOT_POSTINGS", 10)
    assert rows(sparse.sparse_search(postings, queries, 4)) == plain


def test_drop_ratio(spark):
    df = spark.createDataFrame([(1, {"a": -5.0, "b": 1.0, "c": -0.1, "d": 2.0, "e": 1.0})], "id int, vector map<string,double>")
    assert [r[0] for r in rows(sparse.sparse_postings(df, 0.4).select("term"))] == ["a", "d", "e"]
    assert sparse.sparse_postings(df, 1.0).count() == 0
    with pytest.raises(ValueError):
        sparse.sparse_postings(df, 1.5)


def grams(text, n=3):
    words = text.lower().split()
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} or {" ".join(words)}


def corpus():
    """A third of the texts are one text or close to it; some are short or empty."""
    draw = random.Random(5)
    core = [draw.choice(WORDS) for _ in range(60)]
    texts = {}
    for i in range(150):
        if i % 3 == 0:
            words = list(core)
            for _ in range(draw.choice([0, 0, 1, 3, 8])):
                words[draw.randrange(60)] = draw.choice(WORDS)
        elif i % 10 == 1:
            words = ["short", "text"][: draw.randint(0, 2)]
        else:
            words = [draw.choice(WORDS) for _ in range(draw.randint(3, 40))]
        texts[i] = " ".join(words)
    return texts


def test_near_duplicates_equal_brute_force_within_buckets(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    sets = {i: grams(t) for i, t in texts.items()}
    listed = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, shingles array<string>")
    buckets = {}
    for r in neardup.band_keys(neardup.minhash(listed)).collect():
        buckets.setdefault((r.band, tuple(r.key)), []).append(r.id)
    want = {}
    for members in buckets.values():
        for a in members:
            for b in members:
                if a < b and texts[a] and texts[b]:  # a text without a word repeats nothing
                    j = round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)
                    if j >= 0.6 and (b not in want or a < want[b][0]):
                        want[b] = (a, j)
    assert len(want) >= 40
    expected = sorted((b, a, j) for b, (a, j) in want.items())
    assert rows(neardup.near_duplicates(df, 0.6)) == expected
    monkeypatch.setattr(neardup, "_GROWTH", 2)
    assert rows(neardup.near_duplicates(df, 0.6)) == expected


def test_band_search_equals_brute_force_with_copies(spark):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    sig = neardup.minhash(shingles(df, "text", 3).select("id", "shingles"))
    data = {r.id: list(r.signature) for r in sig.collect()}
    want = []
    for q, qs in data.items():
        scored = []
        for d, ds in data.items():
            if any(qs[b * 4 : b * 4 + 4] == ds[b * 4 : b * 4 + 4] for b in range(8)):
                scored.append((-round(sum(x == y for x, y in zip(qs, ds)) / 32, 6), d))
        want += [(q, d, -s, r + 1) for r, (s, d) in enumerate(sorted(scored)[:5])]
    got = neardup.lsh_search(sig, sig.select(F.col("id").alias("query_id"), "signature"), 5)
    assert rows(got) == sorted(want)


def test_shingles_of_short_texts(spark):
    df = spark.createDataFrame([(1, "A b, a B a"), (2, "a b"), (3, ""), (4, None)], "id int, text string")
    got = {r.id: r.shingles for r in shingles(df, "text", 3).collect()}
    assert got == {1: ["a b a", "b a b"], 2: [], 3: [], 4: []}


def test_text_and_phrase_match_equal_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    asked = {1: "alpha beta", 2: "Gamma, gamma", 3: "nowhere alpha", 4: "short text", 5: "", 6: "mu"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    every, some, places = [], [], []
    for q, t in asked.items():
        words = t.lower().replace(",", "").split()
        for d, text in texts.items():
            have = text.split()
            hits = len(set(words) & set(have))
            if hits:
                some.append((q, d, hits))
            if words and hits == len(set(words)):
                every.append((q, d, hits))
            places += [(q, d, i) for i in range(len(have)) if words and have[i : i + len(words)] == words]
    assert rows(textsearch.text_match(df, "text", queries, "any")) == sorted(some)
    assert rows(textsearch.text_match(df, "text", queries, "all")) == sorted(every)
    assert rows(textsearch.phrase_match(df, "text", queries)) == sorted(places)
    with pytest.raises(ValueError):
        textsearch.text_match(df, "text", queries, "none")


def test_band_search_of_hot_buckets_in_cells(spark, monkeypatch):
    df = spark.createDataFrame(list(corpus().items()), "id long, text string")
    sig = neardup.minhash(shingles(df, "text", 3).select("id", "shingles"))
    asked = sig.select(F.col("id").alias("query_id"), "signature")
    plain = rows(neardup.lsh_search(sig, asked, 5))
    monkeypatch.setattr(neardup, "HOT_PAIRS", 4)
    assert rows(neardup.lsh_search(sig, asked, 5)) == plain
    assert rows(neardup.lsh_search(sig, asked, 5, broadcast_bytes=0)) == plain
