"""Continuous typed ingest with expiry by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectable.sources.ingest import REASONS, check
from vectable.spec import TableSpec


def first_seen(stream: DataFrame, pk: str, ts: str, ttl_seconds: int) -> DataFrame:
    """First row per key within the TTL; keys older than that leave the state.

    Rows later than the watermark are dropped. The watermark follows the largest
    ``ts`` seen, so this approximates expiry; the batch operator is the exact rule.
    """
    return (
        stream.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, f"{ttl_seconds} seconds")
        .dropDuplicatesWithinWatermark([pk])
    )


def ingest_stream(
    stream: DataFrame,
    spec: TableSpec,
    ts: str,
    ttl_seconds: int,
    path: str,
    quarantine: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Append the first conforming row per key to ``path`` and misfits to ``quarantine``.

    ``ts`` is an undeclared event-time column, kept next to the declared ones.
    Misfits are set aside before keys are compared, so a bad row never hides a
    good one. Each batch is written under the stream's id and its own number: a
    batch that is run again replaces its own files, and a new checkpoint on an
    old target replaces none.
    """
    checked = check(stream.withColumn(ts, F.col(ts).cast("timestamp")), spec)
    timeless = F.when(F.col(ts).isNull(), F.array(F.lit(f"{ts}: null"))).otherwise(F.array().cast("array<string>"))
    checked = checked.withColumn(REASONS, F.concat(REASONS, timeless))
    names = [f.name for f in spec.fields] + [ts]
    good = checked.filter(F.size(REASONS) == 0).select(*names)
    kept = first_seen(good, spec.primary_key, ts, ttl_seconds)
    bad = checked.filter(F.size(REASONS) > 0).select(*names, REASONS, "raw")
    both = kept.select(F.struct(*names).alias("good"), F.lit(None).cast(bad.schema).alias("bad")).unionByName(
        bad.select(F.lit(None).cast(kept.schema).alias("good"), F.struct(*bad.columns).alias("bad"))
    )

    def write(batch: DataFrame, number: int) -> None:
        # The checkpoint names its stream before the first batch.
        named = batch.sparkSession.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id"))
        run = named.first()[0]
        batch.persist()
        for side, target in (("good", path), ("bad", quarantine)):
            rows = batch.filter(F.col(side).isNotNull()).select(f"{side}.*")
            rows.write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")
        batch.unpersist()

    writer = both.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
