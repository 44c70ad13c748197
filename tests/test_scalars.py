from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from registry import QUERIES
from vectable.operators import scalar, spatial


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def test_filters_reach_the_scan(spark, sf_dir):
    table = orders(spark, sf_dir)
    assert "In(o_orderstatus, [F,P])" in plan(scalar.where_equal(table, {"o_orderstatus": ["F", "P"]}))
    between = plan(scalar.where_range(table, "o_totalprice", 1.0, 2.0))
    assert "GreaterThanOrEqual(o_totalprice,1.0)" in between and "LessThanOrEqual(o_totalprice,2.0)" in between
    assert "StringStartsWith(o_orderpriority,1-)" in plan(scalar.where_prefix(table, "o_orderpriority", "1-"))


def test_top_k_per_group_is_limited_before_the_shuffle(spark, sf_dir):
    for name in ("upsert_latest", "snapshot_strong", "knn_l2", "sparse_search"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "row_number()" in text and "Partial" in text and "WindowGroupLimit" in text, name


def test_no_plan_has_a_product_join(spark, sf_dir):
    for name in ("knn_l2", "partitioned_knn_grid", "box_join", "text_match_all", "sparse_search", "lsh_search",
                 "near_duplicates", "phrase_match", "table_diff"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_order_by_limit_is_a_top_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(scalar.order_by(orders(spark, sf_dir), "o_totalprice", 5))


def test_null_logic_and_literal_prefix(spark):
    df = spark.createDataFrame([(1, "a%b"), (2, "axb"), (3, None), (4, "A%")], "id int, s string")
    assert rows(scalar.where_prefix(df, "s", "a%").select("id")) == [(1,)]
    assert rows(scalar.where_equal(df, none_of={"s": "axb"}).select("id")) == [(1,), (4,)]
    assert rows(scalar.where_equal(df, any_of=[{"s": "axb"}, {"id": 3}]).select("id")) == [(2,), (3,)]
    assert rows(scalar.where_range(df, "s", lo="a").select("id")) == [(1,), (2,)]
    assert [r.id for r in scalar.order_by(df, "s").collect()][-1] == 3


def test_facet_counts_of_one_column_with_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    got = scalar.facet_counts(df, ["x"]).collect()
    assert {(r.facet, r.value, r.n) for r in got} == {("x", "a", 2), ("x", None, 1)}


def test_bitmaps_with_a_hot_value(spark):
    df = spark.range(100_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("a"),
                                     (F.col("id") % 7).alias("b"))
    maps = scalar.value_bitmaps(df, "a", "id")
    assert rows(scalar.bitmap_counts(maps)) == [("cold", 66666), ("hot", 33334)]
    sevens = scalar.value_bitmaps(df, "b", "id")
    both = scalar.bitmap_combination([maps.filter("value = 'hot'"), sevens.filter("value in (1, 2)")])
    assert both.first().n == df.filter("a = 'hot' and b in (1, 2)").count()
    assert scalar.bitmap_combination([maps.filter("value = 'none'"), sevens]).first().n == 0


def test_boxes_of_very_different_size(spark):
    points = spark.range(400).select("id", (F.col("id") % 20 - 10.0).alias("x"), (F.floor(F.col("id") / 20) - 10.0).alias("y"))
    data = [(1, -100.0, -100.0, 100.0, 100.0), (2, 0.0, 0.0, 0.0, 0.0), (3, -3.5, -2.0, 1.0, 4.0), (4, 1.0, 1.0, 0.0, 0.0)]
    boxes = spark.createDataFrame(data, "box_id int, x_lo double, y_lo double, x_hi double, y_hi double")
    want = [(b, p.id) for p in points.collect() for b, x0, y0, x1, y1 in data if x0 <= p.x <= x1 and y0 <= p.y <= y1]
    assert rows(spatial.box_join(points, boxes, 0.5)) == sorted(want)
    assert spatial.box_join(points, boxes.filter("box_id > 9"), 0.5).count() == 0
