from __future__ import annotations

from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from registry.common import workspace
from vectable.operators import keys, versions
from vectable.sources import tables
from vectable.spec import Field, SpecError, TableSpec

SPEC = TableSpec(
    "t",
    (
        Field("id", "Int64", is_primary_key=True),
        Field("k", "Int32", is_partition_key=True),
        Field("c", "Double", is_clustering_key=True),
        Field("v", "FloatVector", dim=1),
    ),
)


def frame(spark, n=3000):
    """A third of the rows share one partition key and one clustering value."""
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        "id",
        F.when(hot, 7).otherwise(F.col("id") % 50).cast("int").alias("k"),
        F.when(hot, 0.5).otherwise(F.col("id") / n).alias("c"),
        F.array(F.col("id").cast("float")).alias("v"),
    )


def test_ids_are_dense_with_a_hot_value_and_equal_rows(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("a"), F.lit("x").alias("b")
    )
    out = keys.assign_ids(df, ["a"], start=10).collect()
    assert sorted(r.id for r in out) == list(range(10, 3010))
    assert [r.a for r in sorted(out, key=lambda r: r.id)] == sorted(r.a for r in out)
    empty = keys.assign_ids(df.filter("a < 0"), ["a"])
    assert empty.count() == 0


def test_upsert_prefers_the_latest_then_the_change(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "id int, x string, ts int")
    new = spark.createDataFrame([(1, "c", 5), (1, "d", 4), (3, "e", 1)], "id int, x string, ts int")
    assert rows(keys.upsert(base, new, "id", "ts").select("id", "x")) == [(1, "c"), (2, "b"), (3, "e")]


def test_diff_sees_nulls(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "c", 3)], "id int, x string, y int")
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 9), (4, None, 4)], "id int, x string, y int")
    got = {r.id: (r.change, r.columns) for r in keys.table_diff(old, new, "id").collect()}
    assert got == {2: ("changed", ["x", "y"]), 3: ("removed", []), 4: ("added", [])}


def test_layout_spreads_a_hot_key_and_prunes(spark):
    path = workspace(spark, "layout")
    tables.write_table(frame(spark), SPEC, path)
    stored = spark.read.parquet(path).withColumn("f", F.input_file_name())
    assert stored.filter("k = 7").select("f").distinct().count() > 1
    read = tables.read_table(spark, path, SPEC, {"k": 7}, {"c": (0.4, 0.6)})
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [(_bucket" in plan
    assert "GreaterThanOrEqual(c,0.4)" in plan and "LessThanOrEqual(c,0.6)" in plan
    want = frame(spark).filter("k = 7 and c between 0.4 and 0.6")
    assert rows(read.select("id", "k")) == rows(want.select("id", "k"))


def test_publish_moves_the_view_only_when_keys_are_unique(spark):
    root = workspace(spark, "publish")
    small = frame(spark, 30)
    first = tables.publish_version(small, SPEC, root, "published", "a")
    assert (first["rows"], first["bad"]) == (30, 0)
    more = small.filter("id < 20").withColumn("c", F.col("c") + F.when(F.col("id") == 1, 1.0).otherwise(0.0))
    second = tables.publish_version(more, SPEC, root, "published", "b", previous="a")
    assert second["diff"] == {"removed": 10, "changed": 1}
    with pytest.raises(SpecError):
        tables.publish_version(small.union(small), SPEC, root, "published", "c")
    assert spark.table("published").count() == 20
    assert spark.read.parquet(f"{root}/a").count() == 30


def test_expiry_edges(spark):
    now = datetime(2024, 3, 10, 12)
    df = spark.sql("""select 1 as id, timestamp_ntz'2024-03-10 11:00:00' as ts
      union all select 2, timestamp_ntz'2024-03-10 10:59:59' union all select 3, null""")
    assert rows(versions.expire(df, "ts", 3600, now).select("id")) == [(1,)]
    assert versions.expire(df, "ts", 0, now).count() == versions.expire(df, "ts", None, now).count() == 3
    # Across the change to summer time: 07:30 there is 11:30 UTC.
    there = spark.sql("select 1 as id, timestamp_ntz'2024-03-10 07:30:00' as ts")
    assert versions.expire(there, "ts", 3600, now, "America/New_York").count() == 1
    assert versions.expire(there, "ts", 1800 - 1, now, "America/New_York").count() == 0
    zoned = spark.sql("select timestamp'2024-03-10 11:00:00Z' as ts")
    assert versions.expire(zoned, "ts", 3600, now).count() == 1
    plan = versions.expire(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "ts", 60, now, "Asia/Tokyo")
    assert "GreaterThanOrEqual(ts" in plan._jdf.queryExecution().executedPlan().toString()


def test_snapshot_levels(spark):
    log = spark.sql("""select * from values (1, 'a', timestamp_ntz'2024-01-01 00:00:00', 's1'),
      (1, 'b', timestamp_ntz'2024-01-01 00:00:09', 's2'), (1, 'c', timestamp_ntz'2024-01-01 00:00:11', 's1')
      as t(id, x, ts, who)""")
    now = datetime(2024, 1, 1, 0, 0, 10)

    def seen(level, **more):
        return [r.x for r in versions.snapshot_read(log, "id", "ts", now, level, **more).collect()]

    assert seen("Strong") == ["b"]
    assert seen("Bounded", staleness=5) == ["a"]
    assert seen("Session", staleness=5, session="s2", session_col="who") == ["b"]
    assert seen("Session", staleness=5, session="s1", session_col="who") == ["a"]
    assert seen("Eventually", published_ts=datetime(2023, 1, 1)) == []
    with pytest.raises(ValueError):
        seen("strong")


def test_stream_quarantines_and_keeps_the_first_of_a_key(spark):
    from vectable.streaming.ingest import ingest_stream

    spec = TableSpec("s", (Field("id", "Int64", is_primary_key=True), Field("v", "FloatVector", dim=1)))
    root = workspace(spark, "stream-test")
    source = f"{root}/in"
    for part in range(2):
        spark.sql(f"""select id, case when id = 5 then array() else array(cast(id as float)) end as v,
          timestamp_ntz'2024-01-01 00:00:00' as ts from range({part * 10}, {part * 10 + 15})""").write.mode(
            "append"
        ).parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    ingest_stream(stream, spec, "ts", 3600, f"{root}/ok", f"{root}/bad", f"{root}/state").awaitTermination()
    assert rows(spark.read.parquet(f"{root}/ok").select("id")) == [(i,) for i in range(25) if i != 5]
    assert rows(spark.read.parquet(f"{root}/bad").select("id", F.col("reasons")[0])) == [(5, "v: wrong dim")]
