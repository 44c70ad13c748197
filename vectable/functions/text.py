"""Text columns: tokens and shingles."""

from __future__ import annotations

from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: everything but letters and digits separates tokens.
SEPARATOR = r"[^\p{L}\p{N}]+"


def tokens(col: Column | str) -> Column:
    """Lower-case runs of letters and digits, in text order."""
    col = F.col(col) if isinstance(col, str) else col
    return F.array_remove(F.split(F.lower(col), SEPARATOR), "")


def one_per_row(df: DataFrame, items: Column | str, *keep: str | Column, name: str = "term") -> DataFrame:
    """One row per array item, with the ``keep`` columns; items are never null.

    The outer form with a filter behind it: the plain form makes the optimizer
    repeat the whole text expression in a filter at the scan.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def placed_per_row(df: DataFrame, items: Column | str, *keep: str | Column, name: str = "term") -> DataFrame:
    """As ``one_per_row``, with the position ``pos`` of each item, from 0."""
    rows = df.select(*keep, F.posexplode_outer(items).alias("pos", name))
    return rows.filter(F.col(name).isNotNull())


def shingles(df: DataFrame, text: str, n: int, out: str = "shingles") -> DataFrame:
    """Add the distinct word n-grams of a text; none for texts of fewer than n words."""
    words = df.withColumn("_words", F.coalesce(tokens(text), F.array().cast("array<string>")))
    grams = NGram(n=n, inputCol="_words", outputCol="_grams").transform(words)
    return grams.withColumn(out, F.array_distinct("_grams")).drop("_words", "_grams")
