"""Points in rectangles: one box as a filter, a table of boxes as a join on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_LEVEL = -10  # and a double's range ends 530 levels above


def within_box(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Points inside (x_lo, y_lo, x_hi, y_hi), borders included; plain ranges reach the scan."""
    x_lo, y_lo, x_hi, y_hi = box
    return df.filter(F.col(x).between(x_lo, x_hi) & F.col(y).between(y_lo, y_hi))


def _cell(value: Column, level: Column, size: float) -> Column:
    return F.floor(value / (F.lit(size) * F.pow(F.lit(4.0), level)))


def _no_pairs(points: DataFrame, boxes: DataFrame) -> DataFrame:
    fields = [boxes.schema["box_id"], points.schema["id"]]
    return points.sparkSession.createDataFrame([], T.StructType(fields))


def box_join(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """(box_id, id): every point inside every box, borders included.

    ``points`` has id, x, y; ``boxes`` has box_id, x_lo, y_lo, x_hi, y_hi. Each
    box goes to a grid level (cells of ``cell`` times a power of four) whose
    cells are one to four times as wide as the box: it touches at most four of
    them, and a small box meets no crowd of far points. Points take part at the
    levels in use. Open boxes are placed by the part that reaches into the
    extent of the points; points with a coordinate that is null or not finite
    are in no box.
    """
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in ("x", "y")]
    points = points.filter(finite[0] & finite[1])
    extent = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if extent[0] is None:
        return _no_pairs(points, boxes)
    asked = {c: F.col(c) for c in ("x_lo", "y_lo", "x_hi", "y_hi")}
    for c, least, most in (("x", extent[0], extent[2]), ("y", extent[1], extent[3])):
        asked[f"{c}_lo"] = F.greatest(F.col(f"{c}_lo"), F.lit(least))
        asked[f"{c}_hi"] = F.least(F.col(f"{c}_hi"), F.lit(most))
    whole = F.col("x_lo").isNotNull() & F.col("x_hi").isNotNull() & F.col("y_lo").isNotNull() & F.col("y_hi").isNotNull()
    boxes = boxes.filter(whole).withColumns(asked)
    side = F.greatest(F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo"))
    smallest = F.greatest(side, F.lit(cell * 4.0**MIN_LEVEL))
    level = F.ceil(F.log(4.0, smallest / cell) - 1e-9).cast("int")
    sized = boxes.filter((F.col("x_lo") <= F.col("x_hi")) & (F.col("y_lo") <= F.col("y_hi"))).withColumn(
        "level", level
    )
    levels = [r[0] for r in sized.select("level").distinct().collect()]  # as few as there are levels
    if not levels:
        return _no_pairs(points, boxes)
    low_x, high_x = (_cell(F.col(c), F.col("level"), cell) for c in ("x_lo", "x_hi"))
    low_y, high_y = (_cell(F.col(c), F.col("level"), cell) for c in ("y_lo", "y_hi"))
    placed_boxes = sized.withColumn("cx", F.explode(F.sequence(low_x, high_x))).withColumn(
        "cy", F.explode(F.sequence(low_y, high_y))
    )
    placed_points = (
        points.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels])))
        .withColumn("cx", _cell(F.col("x"), F.col("level"), cell))
        .withColumn("cy", _cell(F.col("y"), F.col("level"), cell))
    )
    inside = F.col("x").between(F.col("x_lo"), F.col("x_hi")) & F.col("y").between(
        F.col("y_lo"), F.col("y_hi")
    )
    return placed_points.join(placed_boxes, ["level", "cx", "cy"]).filter(inside).select("box_id", "id")
