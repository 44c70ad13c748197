"""Exact dense search: flat, filtered, by partition key, and its quality measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectable.functions import metrics
from vectable.operators.search import search


def as_base(df: DataFrame, id_col: str, vector_col: str, **extra: Column | str) -> DataFrame:
    """Rename to the (id, vector, ...) columns the search operators read."""
    more = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in extra.items()]
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), *more)


def as_queries(df: DataFrame, id_col: str, vector_col: str, **extra: Column | str) -> DataFrame:
    """Rename to the (query_id, vector, ...) columns the search operators read."""
    return as_base(df, id_col, vector_col, **extra).withColumnRenamed("id", "query_id")


def score_pairs(pairs: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    """Add ``score`` for two vector columns of the same row."""
    return pairs.withColumn("score", metrics.score(a, b, metric))


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str, **options) -> DataFrame:
    """Exact k nearest base rows of every query."""
    return search(base, queries, k, metric, **options)


def filtered_knn(
    base: DataFrame, queries: DataFrame, k: int, predicate: Column, metric: str = "L2"
) -> DataFrame:
    """Nearest rows among those that satisfy ``predicate``; it runs in the scan."""
    return search(base.filter(predicate), queries, k, metric)


def partitioned_knn(
    base: DataFrame, queries: DataFrame, k: int, key: str, metric: str = "L2", **options
) -> DataFrame:
    """Each query looks only at base rows that share its ``key`` value."""
    keyed_base = base.filter(F.col(key).isNotNull()).withColumn("key", F.col(key))
    keyed_queries = queries.filter(F.col(key).isNotNull()).withColumn("keys", F.array(key))
    return search(keyed_base, keyed_queries, k, metric, keyed=True, **options)


def recall(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: truth rows, hits, recall at k, mean rank displacement of the hits."""
    wanted = truth.filter(F.col("rank") <= k).select("query_id", "id", F.col("rank").alias("true_rank"))
    got = result.filter(F.col("rank") <= k).select("query_id", "id", F.col("rank").alias("got_rank"))
    return wanted.join(got, ["query_id", "id"], "left").agg(
        F.count("*").alias("wanted"),
        F.count("got_rank").alias("hits"),
        F.round(F.count("got_rank") / F.count("*"), 6).alias("recall"),
        F.round(F.avg(F.abs(F.col("got_rank") - F.col("true_rank"))), 6).alias("displacement"),
    )


def precision_report(df: DataFrame, vector_col: str, kind: str) -> DataFrame:
    """(pos, max_error, mean_error): what rounding to f16 or bf16 changes per dimension."""
    both = df.select(F.col(vector_col).alias("v"), metrics.reduced(vector_col, kind).alias("r"))
    gaps = both.select(F.posexplode_outer(F.arrays_zip("v", "r")).alias("pos", "e")).select(
        "pos", F.abs(F.col("e.v").cast("double") - F.col("e.r").cast("double")).alias("gap")
    ).filter(F.col("gap").isNotNull())
    return gaps.groupBy("pos").agg(
        F.round(F.max("gap"), 9).alias("max_error"), F.round(F.avg("gap"), 9).alias("mean_error")
    )
