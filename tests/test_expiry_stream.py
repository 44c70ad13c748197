"""Expiry in a stream: several batches with late rows give what the batch operator gives."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from vectable.streaming.expiry import first_within, first_within_stream

SCHEMA = "id long, ts timestamp, value double, tags array<string>"
START = datetime(2024, 1, 1)
TTL, DELAY = 600, 900


def some_rows(n, seed):
    random.seed(seed)
    out = []
    for i in range(n):
        at = START + timedelta(seconds=random.randint(0, 7200))
        out.append((random.randint(0, 8), at, random.choice([None, 0.5, float(i)]), random.choice([None, [], ["a", None]])))
    return out + out[:5]


def plain(data, ttl):
    kept = {}
    for i, at, *_ in sorted(data, key=lambda r: r[1]):
        mine = kept.setdefault(i, [])
        if not mine or at > mine[-1] + timedelta(seconds=ttl):
            mine.append(at)
    return sorted((i, at) for i, times in kept.items() for at in times)


def test_batch_equals_a_plain_loop(spark):
    data = some_rows(500, 1)
    got = first_within(spark.createDataFrame(data, SCHEMA).repartition(5), "id", "ts", TTL)
    assert got.columns == ["id", "ts", "value", "tags"]
    assert sorted((r.id, r.ts) for r in got.collect()) == plain(data, TTL)
    edge = [(1, START, 0.0, []), (1, START + timedelta(seconds=TTL), 1.0, []), (1, START + timedelta(seconds=TTL + 1), 2.0, []), (1, None, 3.0, [])]
    assert [r.value for r in first_within(spark.createDataFrame(edge, SCHEMA), "id", "ts", TTL).orderBy("ts").collect()] == [0.0, 2.0]
    assert first_within(spark.createDataFrame([], SCHEMA), "id", "ts", TTL).count() == 0


def test_stream_with_late_rows_equals_the_batch(spark, tmp_path):
    data = some_rows(300, 2)
    # rows arrive up to DELAY after their time, in batches of what arrived together
    random.seed(3)
    arrival = sorted((r[1] + timedelta(seconds=random.randint(0, DELAY - 60)), n) for n, r in enumerate(data))
    batches = [[data[n] for _, n in arrival[at : at + 60]] for at in range(0, len(arrival), 60)]
    end = (99, START + timedelta(days=2), 0.0, None)
    batches += [[end], [(1, START, -1.0, ["far too late"])], [(99, START + timedelta(days=4), 1.0, None)]]
    source = tmp_path / "in"
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(source / f"n={n:02}"))
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(*[str(source / "n=*")])
    query = (
        first_within_stream(read, "id", "ts", TTL, DELAY).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = first_within(spark.createDataFrame(data + [end], SCHEMA), "id", "ts", TTL)
    found, wanted = (sorted(map(repr, df.filter("id <> 99").collect())) for df in (got, want))
    assert found == wanted and len(found) > 60
    assert sorted(r.ts for r in got.filter("id = 99").collect()) == [end[1]]
