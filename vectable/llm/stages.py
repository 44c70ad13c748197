"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> the documents kept.

Every stage but the last returns the columns that it was given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectable.llm import bpe, decontaminate, jaccard, langid, repeats
from vectable.llm.queries import contaminated
from vectable.llm.registry import table, written
from vectable.session import broadcast_checked, ship_package

KEY_ROWS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognized: rejected ones, and texts without a letter, go."""
    ship_package(spark)
    extra = [c for c in docs.columns if c in ("lang_pred", "score", "rejected")]
    keyed = docs.withColumns({f"_given_{c}": F.col(c) for c in extra})
    found = langid.predict(keyed, langid.fit(docs)).filter(~F.col("rejected"))
    return found.select(*(F.col(f"_given_{c}").alias(c) if c in extra else c for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class; of repeated rows one stays.

    Documents are known by id and text: of several texts of the smallest id, the one of the least hash stays.
    """
    ship_package(spark)
    found = written(jaccard.joined_rows(docs).select("doc_id", "_row", "_heads"), "heads")
    lost = written(found.filter(~F.col("_heads")).select("doc_id", "_row").distinct(), "lost")
    same = docs["doc_id"].eqNullSafe(lost["doc_id"]) & (jaccard.row_of(docs["doc_id"], docs["text"]) == lost["_row"])
    held = docs.join(broadcast_checked(lost, KEY_ROWS), same, "left_anti")
    kept = found.filter("_heads")
    if kept.count() > kept.distinct().count():  # rows repeat: of rows with one id and one text the first stays
        return held.dropDuplicates(["doc_id", "text"])
    return held


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes that occurred before; texts that lose all their bytes go.

    A character that a cut divides goes as a whole; n_chars follows the text.
    """
    ship_package(spark)
    extra = [c for c in docs.columns if c in ("n_bytes", "spans", "kept")]
    keyed = docs.withColumns({f"_given_{c}": F.col(c) for c in extra})
    found = repeats.without_repeats(keyed, as_text=True)
    found = found.filter((F.size("spans") == 0) | (F.octet_length("kept") > 0))
    found = found.withColumn("text", F.when(F.size("spans") == 0, F.col("text")).otherwise(F.col("kept")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return found.select(*(F.col(f"_given_{c}").alias(c) if c in extra else c for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by an item of ``benchmark``."""
    ship_package(spark)
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    found = contaminated(decontaminate.contamination(keyed.select(F.struct("doc_id", "_hash").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")))
    bad = written(found.filter("contaminated").select("doc_id.doc_id", "doc_id._hash").distinct(), "contaminated")
    bad = broadcast_checked(bad, KEY_ROWS)
    same = keyed["doc_id"].eqNullSafe(bad["doc_id"]) & (keyed["_hash"] == bad["_hash"])
    return keyed.join(bad, same, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of the documents with token ids, their number, and whether they decode to the text."""
    ship_package(spark)
    coded = bpe.encode(docs, "text", "ids", decoded="decoded")
    return coded.select(
        *(c for c in docs.columns if c not in ("ids", "n_tokens", "round_trip")),
        "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
