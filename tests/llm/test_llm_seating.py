"""Pitman-Yor scores: equal to a plain version, exact conditionals, odd rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from helpers import documents

from vectable.llm import seating


def plain_tokens(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def word_hash(word):
    return int(seating.END) if word is None else int(seating.tokens_of([word.encode()])[0][0])


def one(values, kind=np.float64):
    return np.array([values], kind)


def drawn(c, strength, base, d, key, turn):
    return int(seating.drawn_tables(one(c, np.int64), one(strength), one(base), d, one(key, np.uint64), turn)[0])


def pair_key(u, w):
    return int(seating.mix(seating.mix(one(u, np.uint64)) + one(w, np.uint64))[0])


def plain_scores(rows, rounds=seating.ROUNDS, burn=seating.BURN):
    """[(id, held, tokens, known, all tokens, base, score)] with dictionaries, one dish at a time."""
    texts = [(i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, plain_tokens(t)) for i, t in rows]
    count = Counter(w for _, held, words in texts if not held for w in words)
    pairs = Counter(p for _, held, words in texts if not held for p in zip(["start", *words], words, strict=False))
    total, types = sum(count.values()), len(count)
    h = {w: word_hash(w) for w in count}
    key = {(u, w): pair_key(int(seating.START) if u == "start" else h[u], h[w]) for u, w in pairs}
    n = lambda c, k: sum(x == k for x in c.values())
    d0, d = seating.discount_of(n(count, 1), n(count, 2)), seating.discount_of(n(pairs, 1), n(pairs, 2))
    t, t0 = dict.fromkeys(pairs, 1), dict.fromkeys(count, 1)
    customers = Counter(u for u, w in pairs.elements())

    def seat_parent(tables, turn):
        c0 = Counter()
        for (_, w), x in t.items():
            c0[w] += x
        before = dict(t0)
        for w in count:
            t0[w] = drawn(c0[w], 1 + d0 * (tables - before[w]), 1 / (types + 1), d0, h[w], turn)
        return c0, sum(t0.values())

    def parent(w, c0, tables):
        return (max(c0[w] - d0 * t0.get(w, 0), 0) + (1 + d0 * tables) / (types + 1)) / (1 + sum(c0.values()))

    c0, tables = seat_parent(types, 0)
    asked = {p for _, _, words in texts for p in zip(["start", *words], words, strict=False)}
    mean = dict.fromkeys(asked, 0.0)
    for turn in range(1, rounds + 1):
        held = Counter()
        for (u, _), x in t.items():
            held[u] += x
        t = {
            (u, w): drawn(c, 1 + d * (held[u] - t[u, w]), parent(w, c0, tables), d, key[u, w], 2 * turn) if c > 1 else 1
            for (u, w), c in pairs.items()
        }
        c0, tables = seat_parent(tables, 2 * turn + 1)
        held = Counter()
        for (u, _), x in t.items():
            held[u] += x
        if turn > burn:
            for u, w in asked:
                base = parent(w, c0, tables)
                inner = (max(pairs[u, w] - d * t.get((u, w), 0), 0) + (1 + d * held[u]) * base) / (1 + customers[u])
                mean[u, w] += (inner if customers[u] else base) / (rounds - burn)
    log = lambda x: math.log10(x)
    return [
        (
            i, held, len(words), sum(count[w] > 0 for w in words), total,
            sum(log((count[w] + 0.1) / (total + 0.1 * (types + 1))) for w in words),
            sum(log(mean[p]) for p in zip(["start", *words], words, strict=False)),
        )
        for i, held, words in texts
    ]


def odd_rows():
    random.seed(4)
    pool = ["the", "The", "THE", "of", "é", "É", "漢字", "x,y", "a\x0bb", "one", "two", "\x00", "\x85"]
    rows = [(n, random.choice([" ", "\n", "\t"]).join(random.choices(pool, k=random.randint(0, 30)))) for n in range(60)]
    return rows + [(100, None), (101, ""), (102, " \n"), (None, "of the one"), (None, None), (3, "the same row"), (3, "the same row"), (104, "never seen words here"), (105, "the " * 900)]


def compared(spark, rows):
    docs = documents(spark, rows)
    got = [tuple(r) for r in seating.score(docs, seating.train(docs)).collect()]
    want = plain_scores(rows)
    order = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_scores_equal_the_plain_version(spark):
    compared(spark, odd_rows())


def test_rare_words_and_hot_pairs_go_other_ways_to_the_same_scores(spark, monkeypatch):
    monkeypatch.setattr(seating, "FREQUENT", 6)
    compared(spark, odd_rows())
    monkeypatch.setattr(seating, "APART", 20)
    monkeypatch.setattr(seating, "BUCKET_BYTES", 200)
    compared(spark, odd_rows())


def test_scores_do_not_depend_on_the_way_the_work_is_dealt(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    first = {r.doc_id: r for r in seating.score(docs, seating.train(docs)).collect()}
    monkeypatch.setattr(seating, "FREQUENT", 500)
    monkeypatch.setattr(seating, "APART", 300)
    monkeypatch.setattr(seating, "BUCKET_BYTES", 20_000)
    again = docs.repartition(5)
    second = {r.doc_id: r for r in seating.score(again, seating.train(again)).collect()}
    assert first.keys() == second.keys()
    for i, r in first.items():
        assert r[:5] == second[i][:5] and r[5:] == pytest.approx(second[i][5:], rel=1e-9)


def test_held_out_texts_are_told_better_than_by_word_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    found = {r.held_out: r for r in seating.perplexity(seating.score(docs, seating.train(docs))).collect()}
    assert found[True].perplexity < 0.2 * found[True].base_perplexity
    assert found[False].perplexity < found[True].perplexity


def seatings(c):
    """Every way to seat c customers: table of each, new tables in order."""
    for way in product(range(c), repeat=c):
        if all(x <= max(way[:i], default=-1) + 1 for i, x in enumerate(way)):
            yield way


def test_tables_follow_their_conditional():
    strength, base, d, c = 1.7, 0.3, 0.6, 5
    weight = np.zeros(c + 1)
    for way in seatings(c):
        k = max(way) + 1
        sizes = Counter(way)
        p = math.prod((strength + d * j) * base for j in range(k))
        weight[k] += p * math.prod(j - d for s in sizes.values() for j in range(1, s))
    keys = np.arange(200_000, dtype=np.uint64)
    got = seating.drawn_tables(np.full(len(keys), c), np.full(len(keys), strength), np.full(len(keys), base), d, keys, 3)
    share = np.bincount(got, minlength=c + 1) / len(keys)
    assert share == pytest.approx(weight / weight.sum(), abs=0.005)


@pytest.mark.parametrize(("d", "strength", "base"), [(0.7, 30.0, 0.05), (0.5, 400.0, 0.1), (0.9, 5.0, 0.001), (0.6, 20_000.0, 0.004)])
def test_large_dishes_follow_their_conditional(d, strength, base):
    n, c = 20_000, 2 * seating.EXACT
    k = np.arange(1, c + 1)
    weight = np.cumsum(np.log(strength + d * (k - 1)) + np.log(base)) + seating.stirling(d, c)[c, 1:]
    share = np.exp(weight - weight.max())
    want = (share * k).sum() / share.sum()
    keys = np.arange(n, dtype=np.uint64)
    got = seating.drawn_tables(np.full(n, c), np.full(n, strength), np.full(n, base), d, keys, 1)
    assert got.mean() == pytest.approx(want, rel=0.03)
    huge = seating.drawn_tables(np.full(9, 10**9), np.full(9, strength), np.full(9, base), d, keys[:9], 1)
    assert (huge >= 1).all() and huge.mean() == pytest.approx((strength / d + 1) * base / (1 - base) + 1, rel=0.5)


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(3)
    c, inner = rng.integers(1, 9, 50), rng.integers(0, 5, 50)
    t, seats = np.minimum(c, rng.integers(1, 4, 50)), np.minimum(inner, rng.integers(1, 4, 50))
    corpus = seating.Corpus(1, 1, words=50, root_discount=0.6, discount=0.8)
    parent = seating.Parent(c.sum(), t.sum(), c, t)
    base = np.append(parent.chance(corpus, c, t), parent.chance(corpus, 0, 0))
    assert base.sum() == pytest.approx(1)
    inner, seats = np.append(inner, 0), np.append(seats, 0)
    assert seating.predictive(corpus, inner, seats, inner.sum(), seats.sum(), base).sum() == pytest.approx(1)


def test_nothing_to_learn_from_and_empty_table(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    docs = documents(spark, [(held, "all rows are held out")])
    (row,) = seating.score(docs, seating.train(docs)).collect()
    assert tuple(row) == (held, True, 6, 0, 0, 0.0, 0.0)
    none = documents(spark, [])
    assert seating.score(none, seating.train(none)).count() == 0
