"""Corpus pipeline: stages that each keep the documents the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectable.llm import stages
from vectable.llm.registry import written
from vectable.session import ship_package

STAGES = [
    ("language", stages.language),
    ("near_duplicates", stages.near_duplicates),
    ("repeated_passages", stages.repeated_passages),
    ("decontamination", stages.decontamination),
    ("encode", stages.encode),
]

# Language identification, posterior pruning and BPE cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again as the next one's input."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
