"""What one task groups or sorts for a stored index does not grow with the texts."""

from __future__ import annotations

from conftest import rows

from vectable import session
from vectable.operators import textindex, textsearch


def texts(spark, path, n=400):
    made = [(i, " ".join(f"w{(i * 31 + j * 17) % 997}" for j in range(60))) for i in range(n)]
    spark.createDataFrame(made, "id long, text string").coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


def test_more_texts_go_to_more_tasks(spark, tmp_path, monkeypatch):
    held = texts(spark, str(tmp_path / "texts"))
    few = textsearch.token_postings(held, "text")
    wide = session.width(held)
    assert few.rdd.getNumPartitions() == wide
    monkeypatch.setattr(textsearch, "TEXT_BYTES", 1000)
    many = textsearch.token_postings(held, "text")
    assert many.rdd.getNumPartitions() > 2 * wide
    assert rows(many) == rows(few)


def test_a_bucket_goes_to_several_tasks(spark, tmp_path, monkeypatch):
    held = texts(spark, str(tmp_path / "texts"))
    textindex.write_index(held, "text", str(tmp_path / "few"), buckets=2)
    monkeypatch.setattr(textindex, "SORTED_BYTES", 4000)
    textindex.write_index(held, "text", str(tmp_path / "many"), buckets=2)
    few, many = (textindex.read_index(spark, str(tmp_path / name)) for name in ("few", "many"))
    assert len(many.postings.inputFiles()) > 2 * len(few.postings.inputFiles())
    assert rows(many.postings) == rows(few.postings) and rows(many.terms) == rows(few.terms)


def test_tables_of_unknown_size_keep_the_width(spark):
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(1, "a b")]), "id long, text string")
    assert session.width(unknown, 1) >= session.width(unknown)
    assert session.width(session.cut(unknown), 1) < 1000
