"""Top-k, slots, the pipeline, and the SQL twins."""

from __future__ import annotations

import math
import zlib

import pytest
from compare import difference, oracle_connection
from helpers import by_id

import corpus_pipeline
from vectable.llm import sharding, topk
from vectable.llm.queries import ORACLES, QUERIES, op7


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert difference(got, con.execute(ORACLES[name]).df()) is None


def brute_top(base, queries, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in base if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in ok:
        if q in queries:
            scored = sorted((-sum(a * b for a, b in zip(w, v, strict=False)), i) for i, v in ok if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 2])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_ROWS", block)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    rows = [(n, [((n * 7 + d * 3) % 11 - 5) / 4 for d in range(6)]) for n in range(40)]
    rows += [(50, None), (51, [1.0, None]), (52, [float("nan")] * 6), (53, [float("inf")] + [0.0] * 5), (54, []), (55, [0.5]), (None, [1.0] * 6), (56, [-0.0001] * 6)]
    base = spark.createDataFrame(rows + [rows[3]], "id long, vector array<double>").selectExpr("*", "1 as score", "2 as query_id").repartition(3)
    asked = {0, 3, 10, 20, 50, 52, 54}
    got = topk.exact_top_k(base, base.filter(base.id.isin(*asked)), 5)
    extra = [r for r in rows if r[0] == 3]
    want = [r for r in brute_top(rows + extra, asked - {3}, 5)] + [r for r in brute_top(rows, {3}, 5)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_top_k_of_huge_weights_and_empty_tables(spark):
    base = spark.createDataFrame([(1, [1e30, 0.0]), (2, [1e30, 1.0]), (3, [-1e30, 0.0])], "id long, vector array<double>")
    got = topk.exact_top_k(base, base.filter("id = 1"), 2).collect()
    assert [(r.id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 2**63 - 1), (3, 1 - 2**63)]
    assert topk.exact_top_k(base, base.limit(0), 2).count() == topk.exact_top_k(base.limit(0), base.limit(0), 2).count() == 0


def test_slots_query(spark, sf_dir):
    docs = by_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = op7(spark, sf_dir).collect()
    load, places = [0] * 8, [[] for _ in range(8)]
    for r in got:
        raw = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert len(got) == len(docs) and max(load) - min(load) < 0.01 * sum(load)
    assert all(sorted(p) == list(range(len(p))) for p in places)


def test_plan_of_slots_is_native(spark, sf_dir):
    plan = op7(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_rebalancing_moves_little_and_growing_fills_the_new_shard(spark):
    totals = spark.range(64).selectExpr("cast(id as int) slot", "cast(100 + id % 3 + if(id % 4 = 0, 300, 0) as bigint) bytes", "1L n_rows")
    first = sharding.even_map(spark, 4, 64)
    second = sharding.rebalanced(first, totals, 4)
    weight = {r.slot: r.bytes for r in totals.collect()}
    before, after = ({r.slot: r.shard for r in m.collect()} for m in (first, second))
    load = [sum(weight[s] for s, x in after.items() if x == n) for n in range(4)]
    assert max(load) - min(load) <= 402 and {r.version for r in second.collect()} == {2}
    light = [s for s, x in before.items() if x != 0]
    assert all(after[s] == before[s] for s in light)
    grown = {r.slot: r.shard for r in sharding.rebalanced(second, totals, 5).collect()}
    moved = [s for s in grown if grown[s] != after[s]]
    assert len(moved) < 24 and sum(grown[s] == 4 for s in moved) > len(moved) / 2


def test_places_of_odd_rows(spark):
    rows = [(None, 1, 0)] * 3 + [(5, 10, 7)] * 2 + [(n, n + 1, n) for n in range(100)]
    records = spark.createDataFrame(rows, "doc_id long, size long, text_crc32 long")
    records = records.withColumn("slot", sharding.slot_of(records.doc_id, records.text_crc32, slots=16))
    totals = sharding.slot_totals(records, 16)
    got = sharding.placed(records, sharding.even_map(spark, 4, 16), totals, "doc_id", "text_crc32").collect()
    for shard in range(4):
        mine = sorted(r.place for r in got if r.shard == shard)
        assert mine == list(range(len(mine)))
    assert len(got) == 105
    none = sharding.slot_totals(records.limit(0), 16)
    assert none.count() == 16 and sharding.rebalanced(sharding.even_map(spark, 4, 16), none, 4).count() == 16
    assert sharding.placed(records.limit(0), sharding.even_map(spark, 4, 16), none, "doc_id").count() == 0


def test_pipeline(spark, sf_dir):
    from test_llm_texts import brute_classes, brute_contamination, brute_repeats

    from vectable.llm import langid
    from vectable.llm.bpe import vocabulary

    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r.doc_id: r.text for r in source.collect()}
    low = {r.doc_id for r in langid.predict(source, langid.fit(source)).collect() if r.rejected}
    assert len(low) <= 0.02 * len(docs)
    left = [(i, t) for i, t in sorted(docs.items()) if i not in low]
    kept = {i for i, cls, *_ in brute_classes(left) if i == cls}
    left = [(i, t) for i, t in left if i in kept]
    cut = brute_repeats(left)
    left = [(i, cut[i][0].decode("utf-8", "ignore")) for i, _ in left if cut[i][0] or not cut[i][1]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {i for i, r in brute_contamination(left, items).items() if r[3]}
    want = {i: t for i, t in left if i not in bad}
    got = by_id(corpus_pipeline.run(spark, sf_dir))
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.round_trip and r.ids == vocabulary().encode(r.text).tolist() and r.n_chars == len(r.text) for r in got.values())


def test_stages_with_odd_rows(spark, tmp_path):
    long = "the tea is with you and that is all there is to say about it today my friend " * 8
    rows = [(1, long, "en", "s", 9), (1, long, "en", "s", 9), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "Der Tee ist da. " * 9, "de", "s", 9), (5, "??", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 as ids", "2 as class_id", "3 as kept", "4 as rejected")
    spark.createDataFrame([(1, "nothing to see")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs, str(tmp_path)).count() == 6
    assert {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()} >= {1}
    assert corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).count() == 5
