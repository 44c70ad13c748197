"""Rules that hold in every operator: odd vectors, open boxes, null keys, kept declarations."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from registry.common import workspace
from vectable.functions import topk
from vectable.operators import dense, graph, ivf, keys, neardup, scalar, search, spatial
from vectable.sources import ingest, tables
from vectable.spec import Field, SpecError, TableSpec

NAN, INF = float("nan"), float("inf")
ODD = [(90, [NAN, 1.0]), (91, [INF, 1.0]), (92, None), (93, [1.0]), (94, [1.0, 2.0, 3.0]), (95, [None, 1.0]), (96, [-INF, NAN])]


def vectors(spark, more=ODD):
    good = [(n, [float(n % 5) - 2.2, float(n % 3) + 0.1]) for n in range(20)]
    return spark.createDataFrame(good + more, "id long, vector array<double>").repartition(3)


@pytest.mark.parametrize("metric", ["L2", "COSINE", "IP"])
@pytest.mark.parametrize("sent", [1 << 26, 0])
def test_odd_vectors_neither_ask_nor_answer(spark, metric, sent):
    ask = lambda df: df.withColumnRenamed("id", "query_id")
    clean, odd = vectors(spark, []), vectors(spark)
    want = rows(dense.knn(clean, ask(clean), 3, metric))
    assert rows(dense.knn(odd, ask(odd), 3, metric, broadcast_bytes=sent)) == want and len(want) == 60


@pytest.mark.parametrize("metric", ["L2", "COSINE", "IP"])
def test_odd_vectors_are_in_no_list_and_no_code(spark, metric):
    centroids = spark.createDataFrame([(0, [1.0, 1.0]), (1, [-2.0, 1.0]), (2, [0.5, -1.0])], "list_id int, centroid array<double>")
    odd, clean = vectors(spark), vectors(spark, [])
    assert rows(ivf.assign_lists(odd, centroids, metric).select("id", "list_id")) == rows(
        ivf.assign_lists(clean, centroids, metric).select("id", "list_id")
    )
    probed = ivf.with_probes(odd.withColumnRenamed("id", "query_id"), centroids, 2, metric)
    assert {r.query_id: len(r["keys"]) for r in probed.filter("query_id < 90").collect()} == dict.fromkeys(range(20), 2)


def test_odd_vectors_train_nothing(spark):
    odd, clean = vectors(spark), vectors(spark, [])
    assert rows(ivf.sq8_bounds(odd)) == rows(ivf.sq8_bounds(clean))
    assert ivf.sq8_encode(odd, ivf.sq8_bounds(odd)).count() == 20
    start = spark.createDataFrame([(0, [1.0, 1.0]), (1, [-2.0, 1.0])], "list_id int, centroid array<double>")
    assert rows(ivf.train_lists(odd, iterations=3, start=start)) == rows(ivf.train_lists(clean, iterations=3, start=start))
    books = ivf.pq_train(odd, m=2, iterations=2, start=start)
    assert rows(books) == rows(ivf.pq_train(clean, m=2, iterations=2, start=start))
    assert rows(ivf.pq_encode(odd, books)) == rows(ivf.pq_encode(clean, books))


def test_training_does_not_depend_on_partitions(spark):
    base = vectors(spark, [])
    assert rows(ivf.train_lists(base, 4, seed=3)) == rows(ivf.train_lists(base.repartition(7), 4, seed=3))


def test_nearest_says_where_there_is_none():
    got = topk.nearest(np.array([[NAN, 0.0], [0.0, 0.0]]), np.array([[1.0, 0.0], [0.0, 0.5]]), 2)
    assert got.tolist() == [[-1, -1], [1, 0]]


def test_tasks_follow_the_bytes_not_the_cores_at_the_start(spark, monkeypatch):
    base = vectors(spark, []).repartition(64)
    monkeypatch.setattr(search, "TASKS_PER_CORE", 0)
    monkeypatch.setattr(search, "TASK_BYTES", 1)
    widths = []
    monkeypatch.setattr(type(base), "coalesce", lambda self, n: widths.append(n) or self)
    dense.knn(base, base.withColumnRenamed("id", "query_id"), 3, "L2")
    assert widths and min(widths) >= 64


def test_open_boxes_and_odd_points(spark):
    points = [(n, n / 7 - 3, n % 5 - 2.0) for n in range(60)] + [(90, NAN, 0.0), (91, INF, 0.0), (92, None, 1.0)]
    boxes = [(1, -1.0, -1.0, INF, INF), (2, -INF, -INF, INF, INF), (3, 0.1, 0.1, 0.2, 0.9), (4, 5.0, 0.0, 1.0, 1.0), (5, 900.0, 900.0, INF, INF), (6, None, 0.0, 1.0, 1.0)]
    p = spark.createDataFrame(points, "id long, x double, y double")
    b = spark.createDataFrame(boxes, "box_id long, x_lo double, y_lo double, x_hi double, y_hi double")
    want = [(i, n) for i, a, c, d, e in boxes if a is not None for n, x, y in points[:60] if a <= x <= d and c <= y <= e]
    assert rows(spatial.box_join(p, b, 0.5)) == sorted(want)
    assert spatial.box_join(p.limit(0), b, 0.5).count() == 0


def test_completions_for_prefixes_of_many_lengths(spark):
    words = spark.createDataFrame([("x" * n,) for n in range(1, 120)], "w string")
    asked = spark.createDataFrame([("x" * n,) for n in range(1, 110)], "prefix string")
    got = scalar.autocomplete(words, "w", asked, 1)
    assert got.count() == 109


def test_search_runs_until_no_beam_is_open(spark):
    base = spark.createDataFrame([(n, [float(n)]) for n in range(90)], "id long, vector array<double>")
    edges = spark.createDataFrame([(n, n + 1, 1.0, 1) for n in range(89)] + [(n + 1, n, 1.0, 2) for n in range(89)], "src long, dst long, score double, rank int")
    ask = spark.createDataFrame([(1, [89.0])], "query_id long, vector array<double>")
    found = graph.graph_search(edges, base, ask, 3, ef=4, entries=1, width=1)
    assert [r.id for r in found.orderBy("rank").collect()] == [89, 88, 87]


def test_null_keys_replace_nothing(spark):
    base = spark.createDataFrame([(None, "a", 1), (None, "b", 1), (1, "c", 1)], "id long, x string, ts int")
    new = spark.createDataFrame([(None, "d", 2), (1, "e", 2)], "id long, x string, ts int")
    assert sorted(r.x for r in keys.upsert(base, new, "id", "ts").collect()) == ["a", "b", "d", "e"]


def test_difference_of_maps_and_variants(spark):
    old = spark.sql("select 1 id, map('a', 1, 'b', 2) m, parse_json('{\"k\": 1}') v union all select 2, map('a', 1), parse_json('1')")
    new = spark.sql("select 1 id, map('b', 2, 'a', 1) m, parse_json('{\"k\": 2}') v union all select 2, map('a', 2), parse_json('1')")
    assert {r.id: r.columns for r in keys.table_diff(old, new, "id").collect()} == {1: ["v"], 2: ["m"]}


SPEC = TableSpec("t", (Field("id", "Int64", is_primary_key=True), Field("k", "Int32", is_partition_key=True), Field("v", "FloatVector", dim=1)))


def test_tables_remember_their_layout(spark):
    path = workspace(spark, "layout")
    df = spark.range(40).selectExpr("id", "cast(id % 4 as int) k", "array(cast(id as float)) v")
    tables.write_table(df, SPEC, path, buckets=61)
    assert tables.read_table(spark, path, equals={"k": 3}).count() == 10
    assert tables.read_declaration(spark, path) == (SPEC, 61)
    with pytest.raises(SpecError):
        tables.read_table(spark, path, SPEC, {"k": 3}, buckets=16)
    bare = workspace(spark, "bare")
    df.write.parquet(bare)
    assert tables.read_table(spark, bare, SPEC, {"k": 3}).count() == 10
    with pytest.raises(SpecError):
        tables.read_table(spark, bare)


def test_published_names_outlive_the_session(spark):
    root = workspace(spark, "pointer")
    df = spark.range(6).selectExpr("id", "cast(id % 2 as int) k", "array(cast(id as float)) v")
    tables.publish_version(df, SPEC, root, "t", "a")
    report = tables.publish_version(df.filter("id < 4"), SPEC, root, "t", "b", previous="a")
    assert (report["columns_added"], report["columns_removed"]) == ([], [])
    assert tables.read_published(spark.newSession(), root, "t").count() == 4
    with pytest.raises(SpecError):
        tables.read_published(spark, root, "other")


def test_ids_at_ingest_follow_the_given_ones(spark):
    spec = TableSpec("own", (Field("id", "Int64", is_primary_key=True, is_auto_id=True), Field("v", "FloatVector", dim=1)))
    df = spark.sql("select 7L id, array(1f) v union all select null, array(3f) union all select null, array(2f) union all select null, array()")
    good, bad = ingest.conform(df, spec)
    assert rows(good.select("id", F.get("v", F.lit(0)))) == [(7, 1.0), (8, 2.0), (9, 3.0)]
    assert [(r.id, r.reasons) for r in bad.collect()] == [(None, ["v: wrong dim"])]


def test_quarantine_keeps_undeclared_columns(spark):
    spec = TableSpec("d", (Field("id", "Int64", is_primary_key=True), Field("v", "FloatVector", dim=1)), enable_dynamic_field=True)
    df = spark.sql("select 1L id, array(cast('NaN' as float)) v, 'kept' note, map('a', 1) m")
    for more in (spec, TableSpec("p", spec.fields)):
        _, bad = ingest.conform(df, more)
        (row,) = bad.collect()
        assert row.reasons == ["v: not finite"] and "kept" in row.raw and '\\"a\\":1' in row.raw.replace('\\\\"', '\\"')


def test_texts_without_a_word_repeat_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "--"), (4, "a b c"), (5, "a b c")], "id long, text string")
    assert rows(neardup.near_duplicates(df, 0.7)) == [(5, 4, 1.0)]


def test_hash_parameters_are_spread():
    found = neardup.hash_parameters(64)
    assert len({a for a, _ in found}) == len({b for _, b in found}) == 64
    assert len({(a * 2 - c) % neardup.PRIME for (a, _), (c, _) in zip(found, found[1:], strict=False)}) == 63
