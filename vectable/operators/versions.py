"""Expiry and reads of a change log as of a consistency level."""

from __future__ import annotations

from datetime import datetime, timedelta
from datetime import timezone as timezone_utc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectable.operators.keys import latest
from vectable.spec import LEVELS


def _moment(now: datetime) -> Column:
    return F.lit(now.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def expire(
    df: DataFrame, ts: str, ttl_seconds: int | None, now: datetime, timezone: str = "UTC"
) -> DataFrame:
    """Drop rows older than the TTL at ``now`` (UTC); null or 0 turns expiry off.

    A naive timestamp is wall time in ``timezone``. A row exactly as old as the
    TTL stays. The first filter is looser by a day and reaches the scan.
    """
    if not ttl_seconds:
        return df
    limit = now.replace(tzinfo=None) - timedelta(seconds=ttl_seconds)
    if isinstance(df.schema[ts].dataType, T.TimestampType):
        return df.filter(F.col(ts) >= F.lit(limit.replace(tzinfo=timezone_utc.utc)))
    as_utc = F.convert_timezone(F.lit(timezone), F.lit("UTC"), F.col(ts))
    return df.filter(F.col(ts) >= _moment(limit - timedelta(days=1))).filter(as_utc >= _moment(limit))


def snapshot_read(
    log: DataFrame,
    pk: str,
    commit_ts: str,
    now: datetime,
    level: str = "Strong",
    staleness: int = 5,
    session: object = None,
    session_col: str | None = None,
    published_ts: datetime | None = None,
    tie_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Latest row per key visible under ``level``.

    Strong: commits up to now. Bounded: up to now minus ``staleness`` seconds.
    Session: Bounded, and all own commits up to now. Eventually: up to
    ``published_ts``.
    """
    if level not in LEVELS:
        raise ValueError(f"unknown consistency level {level!r}")
    ts = F.col(commit_ts)
    bounded = ts <= _moment(now - timedelta(seconds=staleness))
    if level == "Strong":
        seen = ts <= _moment(now)
    elif level == "Bounded":
        seen = bounded
    elif level == "Session":
        seen = (ts <= _moment(now)) & (bounded | (F.col(session_col) == session))
    else:
        seen = ts <= _moment(published_ts)
    order = [ts.desc(), *[F.col(c).desc_nulls_last() for c in tie_cols]]
    return latest(log.filter(seen), pk, order)
