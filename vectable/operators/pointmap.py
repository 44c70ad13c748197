"""Points stored along a space-filling curve, so that a box reads few files and row groups.

Each axis is cut into 2^BITS steps over the extent of the points; the bits of
both steps, one after the other, are the place on the curve. Rows are written in
that order, in one directory per zone of the curve. A box becomes a few ranges of
places: zones prune directories, ranges prune row groups, and the box itself decides.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectable import session
from vectable.operators.spatial import within_box

BITS = 16
ZONE_LEVEL = 3
ROW_GROUP_BYTES = 8 * 1024 * 1024
MOST_RANGES = 64
MOST_FILES = 1_000_000
PLACE, ZONE = "_place", "_zone"
_MASKS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


@dataclass(frozen=True)
class PointMap:
    """Stored rows with their place, and the extent that the places refer to."""

    rows: DataFrame
    x: str
    y: str
    extent: tuple[float, float, float, float]


def _span(low: float, high: float) -> float:
    """Width of an axis; half of it at a time, as the whole may be beyond a double."""
    half = high / 2 - low / 2
    return half if half > 0 else 1.0


def _step(value: Column, low: float, high: float) -> Column:
    at = (value / 2 - F.lit(low / 2)) / F.lit(_span(low, high)) * F.lit(float(1 << BITS))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float((1 << BITS) - 1)), at))).cast("bigint")


def _step_of(value: float, low: float, high: float) -> int:
    at = (value / 2 - low / 2) / _span(low, high) * float(1 << BITS)
    return int(max(0.0, min(float((1 << BITS) - 1), at)))


def _woven(step: Column) -> Column:
    """The bits of ``step`` with a zero before each."""
    for shift, mask in _MASKS:
        step = step.bitwiseOR(F.shiftleft(step, shift)).bitwiseAND(F.lit(mask))
    return step


def place_of(x: Column, y: Column, extent: tuple[float, float, float, float]) -> Column:
    """Place on the curve; -1 for points with a coordinate that is null or not a number."""
    x, y = x.cast("double"), y.cast("double")
    known = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    woven = _woven(_step(x, extent[0], extent[2])).bitwiseOR(F.shiftleft(_woven(_step(y, extent[1], extent[3])), 1))
    return F.when(known, woven).otherwise(F.lit(-1).cast("bigint"))


def write_points(df: DataFrame, x: str, y: str, path: str, id_col: str = "id", files: int | None = None) -> None:
    """Store ``df`` along the curve of its columns ``x`` and ``y``; points at one place are spread by ``id_col``."""
    spark = df.sparkSession
    finite = [F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in (x, y)]
    extent = df.agg(F.min(finite[0]), F.min(finite[1]), F.max(finite[0]), F.max(finite[1])).first()
    extent = tuple(0.0 if v is None else float(v) for v in extent)
    placed = df.withColumn(PLACE, place_of(F.col(x), F.col(y), extent))
    zone = F.shiftright(PLACE, 2 * (BITS - ZONE_LEVEL)).cast("int")
    placed = placed.withColumn(ZONE, F.when(F.col(PLACE) < 0, -1).otherwise(zone))
    if files is None:
        files = session.file_count(df)
        if files > MOST_FILES:  # the optimizer knows no size
            files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(files, PLACE, F.xxhash64(id_col)).sortWithinPartitions(PLACE)
    ordered.write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy(ZONE).parquet(f"{path}/points")
    names = "x string, y string, x_lo double, y_lo double, x_hi double, y_hi double, columns string"
    about = spark.createDataFrame([(x, y, *extent, placed.schema.json())], names)
    about.coalesce(1).write.parquet(f"{path}/about")


def read_points(spark: SparkSession, path: str) -> PointMap:
    about = spark.read.parquet(f"{path}/about").first()
    schema = T.StructType.fromJson(json.loads(about.columns))
    return PointMap(spark.read.schema(schema).parquet(f"{path}/points"), about.x, about.y, (about.x_lo, about.y_lo, about.x_hi, about.y_hi))


def place_ranges(low: tuple[int, int], high: tuple[int, int], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges of places that hold every step within ``low`` and ``high``, borders included.

    Squares that lie in part in the box are cut in four, the largest first, while there is room.
    """
    if low[0] > high[0] or low[1] > high[1]:
        return []
    whole, partial = [], [(0, 0, 0)]  # level, x and y of squares
    while partial and len(whole) + len(partial) + 3 <= most:
        level, a, b = partial.pop(0)
        if level == BITS:
            whole.append((level, a, b))
            continue
        side = 1 << (BITS - level - 1)
        for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
            cx, cy = 2 * a + i, 2 * b + j
            x0, y0 = cx * side, cy * side
            x1, y1 = x0 + side - 1, y0 + side - 1
            if x0 > high[0] or y0 > high[1] or x1 < low[0] or y1 < low[1]:
                continue
            inside = low[0] <= x0 and x1 <= high[0] and low[1] <= y0 and y1 <= high[1]
            (whole if inside else partial).append((level + 1, cx, cy))
    ranges = []
    for level, a, b in whole + partial:
        first = sum(((a >> k) & 1) << 2 * k | ((b >> k) & 1) << 2 * k + 1 for k in range(level)) << 2 * (BITS - level)
        ranges.append((first, first + (1 << 2 * (BITS - level)) - 1))
    merged: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if merged and merged[-1][1] + 1 == first:
            merged[-1] = merged[-1][0], last
        else:
            merged.append((first, last))
    return merged


def stored_within_box(points: PointMap, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows of the stored points inside (x_lo, y_lo, x_hi, y_hi), borders included, as ``within_box`` gives them."""
    e = points.extent
    low = _step_of(box[0], e[0], e[2]), _step_of(box[1], e[1], e[3])
    high = _step_of(box[2], e[0], e[2]), _step_of(box[3], e[1], e[3])
    ranges = place_ranges(low, high)
    near = F.lit(False)
    for first, last in ranges:
        near = near | F.col(PLACE).between(first, last)
    zones = sorted({z for first, last in ranges for z in range(first >> 2 * (BITS - ZONE_LEVEL), (last >> 2 * (BITS - ZONE_LEVEL)) + 1)})
    rows = points.rows.filter(F.col(ZONE).isin(zones) & near)
    return within_box(rows, points.x, points.y, box).drop(PLACE, ZONE)
