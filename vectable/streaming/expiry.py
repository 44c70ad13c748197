"""First row per key within its time to live, exactly: as a batch operator and as a stateful stream.

The rule: rows of a key are taken in order of time (of equal times by a hash of
the row); one is kept when no row of the key that was kept before it is still
alive, a row exactly as old as the time to live being so. Rows without a time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vectable import session

TIE = "_tie"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _timed(df: DataFrame, ts: str) -> DataFrame:
    """Rows with a time, and a hash of the row to order those of one time."""
    return df.withColumn(TIE, F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))).filter(F.col(ts).isNotNull())


def first_within(df: DataFrame, pk: str, ts: str, ttl_seconds: int) -> DataFrame:
    """Rows of ``df`` that the rule keeps. Tasks read their keys' rows in order and hold one time, whatever a key has."""
    rows = session.by_key(_timed(df, ts), pk).sortWithinPartitions(pk, ts, TIE)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, alive = object(), 0
        for batch in batches:
            kept = []
            for n, (own, at) in enumerate(zip(batch.column(pk).to_pylist(), batch.column("_at").to_pylist(), strict=True)):
                if own != key or at > alive:
                    key, alive = own, at + ttl_seconds * 1_000_000
                    kept.append(n)
            yield batch.take(pa.array(kept, pa.int64()))

    timed = rows.withColumn("_at", micros)
    return timed.mapInArrow(keep, timed.schema).select(*(F.col(f"`{c}`") for c in df.columns))


class _FirstWithin(StatefulProcessor):
    """Rows wait until the watermark has passed their time: then none before them can come any more."""

    def __init__(self, ttl_seconds: int, schema: T.StructType, columns: list[str]):
        self.ttl, self.schema, self.columns = ttl_seconds * 1_000_000, schema, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.alive = handle.getValueState("alive", "until bigint")

    def _settle(self, rows: list, watermark: int) -> Iterator[Row]:
        """Emit what the watermark has passed; keep the rest, and a timer for its first."""
        rows.sort(key=lambda r: (r["_at"], r[TIE]))
        until = self.alive.get()[0] if self.alive.exists() else None
        done = 0
        for row in rows:
            if row["_at"] > watermark:
                break
            done += 1
            if until is None or row["_at"] > until:
                until = row["_at"] + self.ttl
                yield Row(**{c: row[c] for c in self.columns})
        rest = rows[done:]
        if rest:
            self.waiting.put([tuple(r) for r in rest])
        else:
            self.waiting.clear()
        if until is not None and until > watermark:
            self.alive.update((until,))
        else:
            self.alive.clear()  # rows that still come are later than that
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = rest[0]["_at"] if rest else until if until is not None and until > watermark else None
        if due is not None:
            self.handle.registerTimer(due // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = list(self.waiting.get()) if self.waiting.exists() else []
        names = [*self.columns, TIE, "_at"]
        held = [Row(**dict(zip(names, r, strict=True))) for r in held] + [Row(**{c: r[c] for c in names}) for r in rows]
        yield from self._settle(held, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.handleInputRows(key, iter(()), timerValues)

    def close(self) -> None:
        pass


def first_within_stream(stream: DataFrame, pk: str, ts: str, ttl_seconds: int, delay_seconds: int) -> DataFrame:
    """Rows of ``stream`` that the rule keeps, given that none is later than ``delay_seconds``; later ones are dropped.

    A row is given out once the watermark has passed its time. The state of a
    key holds the rows that wait and one time, and goes when that has passed.
    Sets the session's state store to one that keeps timers (RocksDB).
    """
    stream.sparkSession.conf.set(PROVIDER, ROCKS)
    columns = stream.columns
    timed = _timed(stream.withColumn(ts, F.col(ts).cast("timestamp")), ts).withColumn("_at", F.unix_micros(ts))
    timed = timed.withWatermark(ts, f"{delay_seconds} seconds")
    processor = _FirstWithin(ttl_seconds, timed.schema, columns)
    out = T.StructType(timed.schema.fields[: len(columns)])
    return timed.groupBy(pk).transformWithState(processor, out, outputMode="Append", timeMode="EventTime")
