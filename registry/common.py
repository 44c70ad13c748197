"""Registration, table access and shared SQL pieces."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectable.operators import dense
from vectable.session import checkpoint_root, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for written tables, below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, label): the embeddings as they are."""
    return dense.as_base(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label="label")


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, label): embeddings of unequal length, so that metrics rank differently."""
    factor = 1 + F.col("vec_id") % 7
    stretched = F.transform("embedding", lambda x: x.cast("double") * factor)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), stretched.alias("vector"), "label"
    )


def as_queries(base: DataFrame) -> DataFrame:
    return base.withColumnRenamed("id", "query_id")


SCALED = """scaled as (
  select vec_id as id, label,
         list_transform(embedding, lambda x: x::double * (1 + vec_id % 7)) as v
  from embeddings)"""

VECTORS = """vectors as (
  select vec_id as id, label, embedding::double[] as v from embeddings)"""


def ranked_sql(pairs: str, k: int, ascending: bool = True) -> str:
    """Top k of a (query_id, id, score) relation."""
    way = "asc" if ascending else "desc"
    return f"""select query_id, id, score, rank::int as rank from (
      select query_id, id, score,
             row_number() over (partition by query_id order by score {way}, id) as rank
      from ({pairs}) where score is not null) where rank <= {k}"""
