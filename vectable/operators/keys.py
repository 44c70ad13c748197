"""Keys: generated ids, upsert, duplicates, difference of two table versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectable import session

_ROW_BITS = 33  # fixed value: row bits of Spark's monotonically increasing id


def assign_ids(df: DataFrame, order_cols: list[str], start: int = 1, id_col: str = "id") -> DataFrame:
    """Dense unique long ids in the order of ``order_cols``, the same on every run.

    Two passes: a range split and sort, written once, then per-part counts
    turned into offsets. Rows that tie on ``order_cols`` are spread and ordered
    by a hash of their values, and rows equal in every column by a salt: such
    rows are interchangeable.
    """
    columns = df.columns
    hashed = [c for c in columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    tied = df.withColumn("_tie", F.xxhash64(*hashed)).withColumn("_salt", F.rand(7))
    order = [*order_cols, "_tie", "_salt"]
    placed = session.cut(
        tied.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
        .drop("_tie", "_salt")
    )
    placed = placed.withColumn("_part", F.shiftright("_row", _ROW_BITS))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition of the sorted data.
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    within = F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1)
    numbered = placed.join(F.broadcast(offsets), "_part")
    return numbered.select((F.col("_offset") + within + start).alias(id_col), *columns)


def latest(df: DataFrame, pk: str, order: list) -> DataFrame:
    """First row per key in ``order``; each task keeps one row per key before the shuffle."""
    first = F.row_number().over(Window.partitionBy(pk).orderBy(*order))
    return df.withColumn("_rn", first).filter(F.col("_rn") == 1).drop("_rn")


def upsert(
    base: DataFrame, changes: DataFrame, pk: str, ts: str, tie_cols: tuple[str, ...] = ()
) -> DataFrame:
    """Insert new keys and replace existing ones by the row with the latest ``ts``.

    At equal ``ts`` a change wins over a base row, then the larger ``tie_cols``.
    Rows without a key replace nothing and are all kept.
    """
    both = base.withColumn("_new", F.lit(0)).unionByName(
        changes.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    order = [F.col(ts).desc_nulls_last(), F.col("_new").desc()]
    order += [F.col(c).desc_nulls_last() for c in tie_cols]
    keyed, loose = both.filter(F.col(pk).isNotNull()), both.filter(F.col(pk).isNull())
    return latest(keyed, pk, order).unionByName(loose).drop("_new")


def duplicate_keys(df: DataFrame, pk: str) -> DataFrame:
    """Keys seen more than once, with their number of rows."""
    return df.groupBy(pk).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def _comparable(df: DataFrame, name: str) -> Column:
    kind, col = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.VariantType):
        col = F.to_json(col)
    elif isinstance(kind, T.MapType):
        col = F.array_sort(F.map_entries(col))
    return col.alias(name)


def table_diff(old: DataFrame, new: DataFrame, pk: str) -> DataFrame:
    """(pk, change, columns): rows added, removed or changed, with the changed columns.

    Maps are compared by their sorted entries, variants by their JSON text.
    """
    shared = [c for c in old.columns if c in new.columns and c != pk]
    left = old.select(F.col(pk), F.struct(*[_comparable(old, c) for c in shared]).alias("o"))
    right = new.select(F.col(pk), F.struct(*[_comparable(new, c) for c in shared]).alias("n"))
    names = F.array_compact(
        F.array(*[F.when(~F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`")), F.lit(c)) for c in shared])
    )
    change = (
        F.when(F.col("o").isNull(), "added")
        .when(F.col("n").isNull(), "removed")
        .when(F.size(names) > 0, "changed")
    )
    columns = F.when(change == "changed", names).otherwise(F.array().cast("array<string>"))
    return (
        left.join(right, pk, "full_outer")
        .select(pk, change.alias("change"), columns.alias("columns"))
        .filter(F.col("change").isNotNull())
    )
