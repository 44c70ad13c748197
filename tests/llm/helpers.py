"""Small frames with awkward rows."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    """Documents of (id, text) pairs."""
    rows = [(i, t, lang, "src", None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
