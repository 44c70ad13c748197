"""Sharding over fixed virtual slots, in DataFrame functions only.

Records are hashed into ``SLOTS`` virtual slots, bytes and rows are added up
per slot, and a slot-to-shard map decides where each slot lives. The map is a
table (version, slot, shard) in shared storage; a version is never changed.
Version 1 deals slots round. Rebalancing edits it: of each shard that holds
more than its share, slots beyond the share are released, largest first kept,
and every released slot goes to the shard with the fewest bytes at that moment.
Slots of the other shards stay where they are.

The only things gathered are the ``SLOTS`` totals; records move once, by slot.

Results in odd cases: a null text has no bytes (its row counts one); null ids
are hashed as null together with the text's checksum; repeated rows share a
slot and get places of their own; an empty table has no rows and an even map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_totals(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, bytes, n_rows) of every slot, also of empty ones; records are (slot, size, ...)."""
    held = records.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(held, "slot", "left").select(
        "slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def even_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt round."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(F.lit(1).alias("version"), slot.alias("slot"), (slot % shards).alias("shard"))


def rebalanced(slot_map: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version of ``slot_map`` (version, slot, shard): shards of nearly equal bytes, few slots moved.

    ``shards`` may exceed the number in the map: new ones start empty.
    """
    now = slot_map.join(totals, "slot").select("version", "slot", "shard", "bytes")
    largest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot")
    share = totals.agg((F.sum("bytes") / F.lit(shards)).alias("share"))
    upto = F.sum("bytes").over(largest.rowsBetween(Window.unboundedPreceding, 0))
    judged = now.withColumn("upto", upto).crossJoin(F.broadcast(share))  # one row
    judged = judged.withColumn("kept", (F.col("upto") <= F.col("share")) & (F.col("shard") < shards))
    loads = F.array(*[
        F.coalesce(F.sum(F.when(F.col("kept") & (F.col("shard") == n), F.col("bytes"))), F.lit(0)).alias(f"s{n}")
        for n in range(shards)
    ])
    freed = F.collect_list(F.when(~F.col("kept"), F.struct((-F.col("bytes")).alias("less"), "slot")))
    state = judged.agg(loads.alias("loads"), F.array_sort(freed).alias("freed"))
    moved = F.aggregate(
        "freed",
        F.struct(F.col("loads").alias("loads"), F.array().cast("array<struct<slot:int,shard:int>>").alias("moved")),
        _placed,
        lambda s: s["moved"],
    )
    moves = state.select(F.inline(moved)).withColumnRenamed("shard", "target")
    return now.join(F.broadcast(moves), "slot", "left").select(
        (F.col("version") + 1).alias("version"), "slot", F.coalesce("target", "shard").alias("shard")
    )


def _placed(state: Column, piece: Column) -> Column:
    """Give a released slot to the least loaded shard, the first of equals."""
    loads = state["loads"]
    to = F.array_position(loads, F.array_min(loads)).cast("int") - 1
    return F.struct(
        F.transform(loads, lambda load, n: F.when(n == to, load - piece["less"]).otherwise(load)).alias("loads"),
        F.concat(state["moved"], F.array(F.struct(piece["slot"].alias("slot"), to.alias("shard")))).alias("moved"),
    )


def placed(records: DataFrame, slot_map: DataFrame, totals: DataFrame, *order: str) -> DataFrame:
    """``records`` with their shard and a gapless place in it, from 0.

    Places of a slot start where those of the shard's earlier slots end; within
    a slot they follow ``order``. So no task orders more than a slot.
    """
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    spots = slot_map.join(totals, "slot").select(
        "version", "slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("begin")
    )
    within = Window.partitionBy("slot").orderBy(*order)
    return (
        records.withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(spots), "slot")  # one row a slot
        .withColumn("place", F.col("begin") + F.col("nth") - 1)
        .drop("begin", "nth")
    )
