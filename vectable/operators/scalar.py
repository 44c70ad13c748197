"""Scalar filters and what goes with them: equality, ranges, prefixes, counts, order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BITMAP_ROWS = 32768  # fixed value: positions per bitmap of Spark's bitmap functions


def equals_any(conditions: dict[str, object]) -> Column:
    """AND over the columns of: the column has one of the values."""
    tests = []
    for name, values in conditions.items():
        values = list(values) if isinstance(values, (list, tuple, set, frozenset)) else [values]
        tests.append(F.col(name).isin(values))
    return reduce(lambda a, b: a & b, tests)


def where_equal(
    df: DataFrame,
    all_of: dict[str, object] | None = None,
    any_of: list[dict[str, object]] | None = None,
    none_of: dict[str, object] | None = None,
) -> DataFrame:
    """Equality and IN filters joined by AND (``all_of``), OR (``any_of``) and NOT (``none_of``).

    SQL null logic: a null matches neither a value nor its negation. The plain
    comparisons reach the parquet scan.
    """
    if all_of:
        df = df.filter(equals_any(all_of))
    if any_of:
        df = df.filter(reduce(lambda a, b: a | b, [equals_any(c) for c in any_of]))
    for name, values in (none_of or {}).items():
        df = df.filter(~equals_any({name: values}))
    return df


def value_bitmaps(df: DataFrame, col: str, pk: str) -> DataFrame:
    """(value, bucket, bitmap): rows of each value as bitmaps over non-negative long keys.

    A value with many rows has many buckets, so no group grows with the value.
    """
    return df.groupBy(
        F.col(col).alias("value"), F.bitmap_bucket_number(pk).alias("bucket")
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position(pk)).alias("bitmap"))


def bitmap_counts(bitmaps: DataFrame) -> DataFrame:
    """(value, n): rows per value, from the bitmaps alone."""
    return bitmaps.groupBy("value").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def bitmap_combination(groups: list[DataFrame]) -> DataFrame:
    """One row ``n``: rows that are in every group of bitmaps (AND of ORs)."""
    one_each = [
        g.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")) for g in groups
    ]
    met = (
        reduce(DataFrame.unionByName, one_each)
        .groupBy("bucket")
        .agg(F.count("*").alias("sides"), F.bitmap_and_agg("bitmap").alias("bitmap"))
        .filter(F.col("sides") == len(groups))
    )
    return met.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n"))


def facet_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(facet, value, n): count per value of several columns in one pass over the rows."""
    sets = [[F.col(c)] for c in cols]
    counted = df.groupingSets(sets, *cols).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    last = len(cols) - 1
    facet = reduce(
        lambda acc, i: acc.when(F.col("g") == ((1 << len(cols)) - 1) - (1 << (last - i)), F.lit(cols[i])),
        range(1, len(cols)),
        F.when(F.col("g") == ((1 << len(cols)) - 1) - (1 << last), F.lit(cols[0])),
    )
    named = counted.withColumn("facet", facet)
    value = reduce(
        lambda acc, c: acc.when(F.col("facet") == c, F.col(c).cast("string")),
        cols[1:],
        F.when(F.col("facet") == cols[0], F.col(cols[0]).cast("string")),
    )
    return named.select("facet", value.alias("value"), "n")


def where_range(df: DataFrame, col: str, lo: object = None, hi: object = None) -> DataFrame:
    """Rows with lo <= col <= hi; a missing bound is open. Both bounds reach the scan."""
    if lo is not None:
        df = df.filter(F.col(col) >= F.lit(lo))
    if hi is not None:
        df = df.filter(F.col(col) <= F.lit(hi))
    return df.filter(F.col(col).isNotNull())


def order_by(
    df: DataFrame, col: str, limit: int | None = None, descending: bool = False, tie: str | None = None
) -> DataFrame:
    """Rows in order of a column, nulls last; with ``limit`` a top-k without a full sort."""
    order = [F.col(col).desc_nulls_last() if descending else F.col(col).asc_nulls_last()]
    out = df.orderBy(*order, *([F.col(tie).asc()] if tie else []))
    return out if limit is None else out.limit(limit)


def where_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Rows whose text starts with ``prefix``, letter for letter; ``%`` and ``_`` are plain."""
    return df.filter(F.col(col).startswith(prefix))


def autocomplete(df: DataFrame, col: str, prefixes: DataFrame, k: int) -> DataFrame:
    """(prefix, completion, n, rank): the k most frequent values for each prefix.

    Values are counted first; then each distinct value meets the prefixes by
    equality on its leading characters.
    """
    wanted = prefixes.select("prefix").distinct().withColumn("length", F.char_length("prefix"))
    # Distinct lengths are no more than the longest prefix has characters.
    lengths = [r[0] for r in wanted.select("length").distinct().collect()]
    values = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("completion")).agg(
        F.count("*").alias("n")
    )
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("completion"))
    heads = values.withColumn("length", F.explode(fitting)).withColumn(
        "prefix", F.left("completion", F.col("length"))
    )
    place = F.row_number().over(Window.partitionBy("prefix").orderBy(F.col("n").desc(), "completion"))
    return (
        heads.join(wanted, ["prefix", "length"])
        .withColumn("rank", place)
        .filter(F.col("rank") <= k)
        .select("prefix", "completion", "n", "rank")
    )
