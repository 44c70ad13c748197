from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from registry.common import as_queries, scaled, vectors
from vectable.functions import metrics
from vectable.operators import dense, graph, ivf, search
from vectable.plans import auto


def few(spark, data):
    return spark.createDataFrame(data, "id long, vector array<float>")


def test_edges_of_exact_search(spark):
    base = few(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None)])
    ask = as_queries(few(spark, [(9, [1.0, 0.0]), (8, None)]))
    assert rows(dense.knn(base, ask, 10, "L2")) == [(9, 1, 1.0, 3), (9, 2, 0.0, 1), (9, 3, 0.0, 2)]
    # A zero vector has no direction.
    assert [r[1] for r in rows(dense.knn(base, ask, 10, "COSINE"))] == [2, 3]
    assert dense.knn(base.filter("id > 9"), ask, 3, "L2").count() == 0
    assert dense.knn(base, ask.filter("query_id > 9"), 3, "L2").count() == 0
    with pytest.raises(ValueError):
        dense.knn(base, ask, 3, "l2")


def test_string_ids(spark):
    base = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("c", [0.0])], "id string, vector array<double>")
    ask = spark.createDataFrame([("q", [1.0])], "query_id string, vector array<double>")
    assert [r[1] for r in dense.knn(base, ask, 2, "L2").orderBy("rank").collect() for r in [tuple(r)]] == ["a", "b"]


def test_pair_scores_of_odd_vectors(spark):
    df = spark.sql("""select * from values (1, array(0.0D, 0.0D), array(1.0D, 1.0D)),
      (2, array(1.0D), array(1.0D, 1.0D)), (3, null, array(1.0D, 1.0D)), (4, array(3.0D, 4.0D), array(0.0D, 0.0D))
      as t(id, a, b)""")
    got = {m: [r.score for r in dense.score_pairs(df, "a", "b", m).orderBy("id").collect()] for m in ("L2", "COSINE")}
    assert got == {"L2": [1.414214, None, None, 5.0], "COSINE": [None, None, None, None]}
    bits = spark.sql("select array(0L) as a, array(0L) as b union all select array(3L), array(1L)")
    assert sorted(r.score for r in dense.score_pairs(bits, "a", "b", "JACCARD").collect()) == [0.5, 1.0]


def test_precision_equals_numpy(spark):
    values = [0.1, -3.75e-6, 65519.0, 1e-8, 0.0, -1.5]
    df = spark.createDataFrame([(values,), (None,)], "v array<float>")
    half = df.select(metrics.reduced("v", "f16").alias("v")).collect()
    assert half[0].v == [float(x) for x in np.array(values, np.float32).astype(np.float16).astype(np.float32)]
    assert half[1].v is None
    coarse = df.select(metrics.reduced("v", "bf16").alias("v")).first().v
    want = (np.array(values, np.float32).view(np.uint32) & 0xFFFF0000).astype(np.uint32).view(np.float32)
    assert coarse == [float(x) for x in want]


def test_sign_bits_of_uneven_rows(spark):
    wide = [1.0 if i in (0, 63, 64) else -1.0 for i in range(70)]
    df = spark.createDataFrame([(wide,), (None,), ([1.0, -1.0, 1.0],)], "v array<float>")
    got = [r.w for r in df.select(metrics.sign_bits("v").alias("w")).collect()]
    assert got == [[1 - 2**63, 1], None, [5]]


def test_hot_key_is_split_and_loses_nothing(spark, sf_dir, monkeypatch):
    base = scaled(spark, sf_dir).withColumn("key", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 20))
    ask = as_queries(base)
    plain = rows(dense.partitioned_knn(base, ask, 5, "key", "L2"))
    monkeypatch.setattr(search, "BASE_CELL_BYTES", 40 * 64 * 8)
    monkeypatch.setattr(search, "QUERY_CELL_BYTES", 30 * 64 * 8)
    assert rows(dense.partitioned_knn(base, ask, 5, "key", "L2", broadcast_bytes=0)) == plain
    one = base.filter("key = 1")
    alone = dense.knn(one, as_queries(one), 5, "L2")
    keyed = dense.partitioned_knn(base, ask.filter("key = 1"), 5, "key", "L2")
    assert rows(alone) == rows(keyed)


def test_every_list_probed_is_exact(spark, sf_dir):
    base = vectors(spark, sf_dir).select("id", "vector")
    ask = as_queries(base)
    centroids = ivf.train_lists(base, 16, seed=1)
    lists = ivf.assign_lists(base, centroids)
    truth = dense.knn(base, ask, 10, "L2")
    assert rows(ivf.ivf_search(lists, centroids, ask, 10, 16)) == rows(truth)
    some = dense.recall(ivf.ivf_search(lists, centroids, ask, 10, 8), truth, 10).first()
    assert some.recall > 0.7
    assert ivf.train_lists(base.limit(3), 100).count() == 3


def test_trained_codes_with_reranking(spark, sf_dir):
    base = vectors(spark, sf_dir).select("id", "vector")
    ask = as_queries(base)
    centroids = ivf.train_lists(base, 4, seed=1)
    lists = ivf.assign_lists(base, centroids)
    books = ivf.pq_train(base, 8, 5, iterations=4)
    assert books.count() == 8 * 32
    coded = ivf.pq_encode(lists, books)
    truth = dense.knn(base, ask, 10, "L2")
    plain = dense.recall(ivf.rerank_search(coded, books, centroids, ask, 10, 4), truth, 10).first().recall
    better = dense.recall(ivf.rerank_search(coded, books, centroids, ask, 10, 4, 8, raw=base), truth, 10).first().recall
    assert better > 0.7 and better > plain
    with pytest.raises(ValueError):
        ivf.pq_train(base, 7)


def test_automatic_choice(spark, sf_dir):
    assert [auto.method_for(n) for n in (10, 2_000_000, 10**9)] == ["exact", "lists", "codes"]
    base = vectors(spark, sf_dir).select("id", "vector")
    ask = as_queries(base)
    truth = dense.knn(base, ask, 5, "L2")
    for method, least in (("lists", 0.6), ("codes", 0.4)):
        found = auto.auto_search(base, ask, 5, method=method, nlist=8, nprobe=4)
        assert dense.recall(found, truth, 5).first().recall > least


def test_graph_recall(spark, sf_dir):
    base = vectors(spark, sf_dir).select("id", "vector")
    exact = graph.knn_graph(base, 16)
    close = graph.nn_descent(base, 16, pool=48, iterations=6, fan=24)
    both = exact.join(close.select("src", "dst"), ["src", "dst"]).count()
    assert both / exact.count() >= 0.85
    edges = graph.both_ways(close, 32)
    found = graph.graph_search(edges, base, as_queries(base), 10, ef=64)
    assert dense.recall(found, dense.knn(base, as_queries(base), 10, "L2"), 10).first().recall >= 0.95
    with pytest.raises(ValueError):
        graph.graph_search(edges, base, as_queries(base), 10, ef=5)


def test_graph_of_copies(spark):
    """A third of the rows are one vector: every row still gets m other rows."""
    base = spark.range(90).select(
        "id", F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0)))
        .otherwise(F.array(F.cos(F.col("id").cast("double")), F.sin(F.col("id").cast("double")))).alias("vector"),
    )
    for edges in (graph.knn_graph(base, 4), graph.nn_descent(base, 4, pool=12)):
        got = edges.groupBy("src").agg(F.count("*").alias("n"), F.count_if(F.col("src") == F.col("dst")).alias("own"))
        assert rows(got.select("n", "own").distinct()) == [(4, 0)]


def test_ring_of_ids_with_gaps_reaches_every_row(spark):
    from registry.graphs import id_ring

    ids = [3, 4, 9, 40, 41, 1000, -7, *range(2000, 2100, 3)]
    ring = {r.src: r.dst for r in id_ring(spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)).collect()}
    at, seen = 3, set()
    while at not in seen:
        seen.add(at)
        at = ring[at]
    assert seen == set(ids)
