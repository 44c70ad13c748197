"""Scalar filters, bitmaps, counts, completion and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import query, table, workspace
from vectable.operators import pointmap, scalar, spatial


@query(
    "where_equal",
    """select o_orderkey, o_orderstatus, o_orderpriority from orders
    where o_orderstatus in ('F', 'P') and (o_orderpriority = '1-URGENT' or o_custkey in (7, 11))
      and o_orderstatus not in ('P')""",
)
def where_equal(spark, sf_dir):
    rows = scalar.where_equal(
        table(spark, sf_dir, "orders"),
        all_of={"o_orderstatus": ["F", "P"]},
        any_of=[{"o_orderpriority": "1-URGENT"}, {"o_custkey": [7, 11]}],
        none_of={"o_orderstatus": "P"},
    )
    return rows.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("value_bitmaps", "select o_orderpriority as value, count(*) as n from orders group by 1")
def value_bitmaps(spark, sf_dir):
    maps = scalar.value_bitmaps(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")
    return scalar.bitmap_counts(maps)


@query(
    "bitmap_combination",
    """select count(*) as n from orders
    where o_orderstatus in ('F', 'O') and o_orderpriority in ('1-URGENT', '2-HIGH')""",
)
def bitmap_combination(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    status = scalar.value_bitmaps(orders, "o_orderstatus", "o_orderkey")
    priority = scalar.value_bitmaps(orders, "o_orderpriority", "o_orderkey")
    return scalar.bitmap_combination(
        [status.filter(F.col("value").isin("F", "O")), priority.filter(F.col("value").isin("1-URGENT", "2-HIGH"))]
    )


@query(
    "facet_counts",
    """select 'p_brand' as facet, p_brand as value, count(*) as n from part group by 2
    union all select 'p_type', p_type, count(*) from part group by 2
    union all select 'p_size', p_size::varchar, count(*) from part group by 2""",
)
def facet_counts(spark, sf_dir):
    return scalar.facet_counts(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@query(
    "where_range",
    "select o_orderkey, o_totalprice from orders where o_totalprice between 100000 and 200000",
)
def where_range(spark, sf_dir):
    rows = scalar.where_range(table(spark, sf_dir, "orders"), "o_totalprice", 100000.0, 200000.0)
    return rows.select("o_orderkey", "o_totalprice")


@query(
    "order_by_top",
    "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 100",
)
def order_by_top(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return scalar.order_by(orders, "o_totalprice", 100, descending=True, tie="o_orderkey")


@query("where_prefix", "select p_partkey, p_name from part where starts_with(p_name, 'red ')")
def where_prefix(spark, sf_dir):
    return scalar.where_prefix(table(spark, sf_dir, "part"), "p_name", "red ").select("p_partkey", "p_name")


@query(
    "autocomplete",
    """with prefixes as (
      select distinct left(p_name, 1) as prefix from part union select distinct split_part(p_name, ' ', 1) from part
      union select distinct left(p_name, 7) from part),
    totals as (select p_name as completion, count(*) as n from part group by 1)
    select prefix, completion, n, rank::int as rank from (
      select prefix, completion, n, row_number() over (partition by prefix order by n desc, completion) as rank
      from prefixes join totals on starts_with(completion, prefix)) where rank <= 5""",
)
def autocomplete(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    prefixes = (
        part.select(F.left("p_name", F.lit(1)).alias("prefix"))
        .union(part.select(F.split_part("p_name", F.lit(" "), F.lit(1))))
        .union(part.select(F.left("p_name", F.lit(7))))
        .distinct()
    )
    return scalar.autocomplete(part, "p_name", prefixes, 5)


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
    )


_POINTS = "points as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y from embeddings)"


_WITHIN_SQL = f"""with {_POINTS} select id, round(x, 6) as x, round(y, 6) as y from points
    where x between -0.1::double and 0.1::double and y between -0.05::double and 0.2::double"""


@query("within_box_stored", _WITHIN_SQL)
def within_box_stored(spark, sf_dir):
    """The same box, from points stored along a space-filling curve."""
    path = workspace(spark, "points")
    pointmap.write_points(_points(spark, sf_dir), "x", "y", path)
    rows = pointmap.stored_within_box(pointmap.read_points(spark, path), (-0.1, -0.05, 0.1, 0.2))
    return rows.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("within_box", _WITHIN_SQL)
def within_box(spark, sf_dir):
    rows = spatial.within_box(_points(spark, sf_dir), "x", "y", (-0.1, -0.05, 0.1, 0.2))
    return rows.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    "box_join",
    f"""with {_POINTS},
    boxes as (select id as box_id, x - r as x_lo, y - r as y_lo, x + r as x_hi, y + r as y_hi
      from (select *, 0.01::double * (1 + id % 5) as r from points))
    select box_id, id from points join boxes on x between x_lo and x_hi and y between y_lo and y_hi""",
)
def box_join(spark, sf_dir):
    """Boxes of five sizes around every point."""
    points = _points(spark, sf_dir)
    r = F.lit(0.01) * (1 + F.col("id") % 5)
    boxes = points.select(
        F.col("id").alias("box_id"), (F.col("x") - r).alias("x_lo"), (F.col("y") - r).alias("y_lo"),
        (F.col("x") + r).alias("x_hi"), (F.col("y") + r).alias("y_hi"),
    )
    return spatial.box_join(points, boxes, 0.02)
