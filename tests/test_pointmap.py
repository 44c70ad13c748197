"""Points along a curve: same rows as a plain filter, fewer files and row groups read."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from vectable.operators import pointmap
from vectable.operators.spatial import within_box

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    random.seed(12)
    points = [(i, random.uniform(-3, 5), random.uniform(10, 11)) for i in range(3000)]
    points += [(4000 + i, 1.0, 10.5) for i in range(400)]  # one place
    points += [(5000, None, 10.5), (5001, 0.0, None), (5002, NAN, 10.2), (5003, INF, 10.2), (5004, -INF, 10.9), (5005, 0.0, INF)]
    df = spark.createDataFrame(points, "id long, x double, y double").withColumn("note", F.lit("n"))
    path = str(tmp_path_factory.mktemp("map") / "points")
    pointmap.write_points(df, "x", "y", path, files=12)
    return df, pointmap.read_points(spark, path)


BOXES = [
    (0.0, 10.2, 1.0, 10.6), (1.0, 10.5, 1.0, 10.5), (-3.0, 10.0, 5.0, 11.0), (-INF, 10.1, 0.0, 10.3), (2.0, -INF, INF, INF),
    (-INF, -INF, INF, INF), (6.0, 12.0, 7.0, 13.0), (1.0, 10.6, 0.5, 10.2), (-0.001, 10.0, 0.001, 11.0),
]


@pytest.mark.parametrize("box", BOXES)
def test_same_rows_as_a_plain_filter(stored, box):
    df, points = stored
    got, want = pointmap.stored_within_box(points, box), within_box(df, "x", "y", box)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_a_small_box_reads_few_files(stored):
    _, points = stored
    found = pointmap.stored_within_box(points, (0.0, 10.2, 0.4, 10.3))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert pointmap.ZONE in plan.split("PartitionFilters:")[1].split("]")[0]
    assert pointmap.PLACE in plan.split("PushedFilters:")[1]
    every = {f.split("/")[-2] for f in points.rows.inputFiles()}
    scanned = found.select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f.split("/")[-2] for r in scanned}) <= 4 < len(every) / 4
    found.collect()
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert leaf.metrics().apply("numFiles").value() < len(points.rows.inputFiles()) / 3


def test_one_place_is_spread_over_files(stored):
    _, points = stored
    at = points.rows.filter("id between 4000 and 4399").select(F.input_file_name().alias("f")).distinct().count()
    assert at > 1


def test_ranges_hold_the_box_and_are_bounded():
    random.seed(3)
    top = (1 << pointmap.BITS) - 1

    def place(a, b):
        return sum(((a >> k) & 1) << 2 * k | ((b >> k) & 1) << 2 * k + 1 for k in range(pointmap.BITS))

    for most in (4, 16, 64):
        for _ in range(20):
            (x0, x1), (y0, y1) = (sorted(random.choices(range(top + 1), k=2)) for _ in range(2))
            ranges = pointmap.place_ranges((x0, y0), (x1, y1), most)
            assert len(ranges) <= most and all(a <= b for a, b in ranges)
            assert all(p[1] < q[0] for p, q in zip(ranges, ranges[1:], strict=False))
            for _ in range(50):
                p = place(random.randint(x0, x1), random.randint(y0, y1))
                assert any(a <= p <= b for a, b in ranges)
    assert pointmap.place_ranges((5, 5), (4, 9)) == []


def test_places_follow_the_woven_bits(spark):
    extent = (0.0, 0.0, 4.0, 4.0)
    df = spark.createDataFrame([(0.0, 0.0), (4.0, 4.0), (2.0, 0.0), (0.0, 2.0)], "x double, y double")
    got = [r[0] for r in df.select(pointmap.place_of(F.col("x"), F.col("y"), extent)).collect()]
    assert got == [0, (1 << 32) - 1, 1 << 30, 1 << 31]


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "id long, x double, y double")
    pointmap.write_points(none, "x", "y", str(tmp_path / "none"))
    points = pointmap.read_points(spark, str(tmp_path / "none"))
    assert pointmap.stored_within_box(points, (0.0, 0.0, 1.0, 1.0)).count() == 0
