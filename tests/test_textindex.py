"""The stored text index: same rows as the searches that read the texts, and what its scans read."""

from __future__ import annotations

import random
from glob import glob

import pytest
from conftest import rows
from pyspark.sql import functions as F

from vectable.operators import textindex
from vectable.operators.textsearch import phrase_match, text_match

TEXT = "id long, text string"
ASKED = "query_id long, text string"


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(8)
    pool = ["the", "of", "cat", "dog", "Été", "one", "two", "three", "ROSE", "漢字"]
    texts = [(i, random.choice([" ", ", ", "\n"]).join(random.choices(pool, k=random.randint(1, 12)))) for i in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "..."), (1003, "only here"), (-5, "the cat of the dog the cat")]
    asked = [
        (1, "the cat"), (2, "The CAT of the dog"), (3, "unseen word"), (4, "the unseen"), (5, ""), (6, None),
        (7, "only here"), (8, "the the"), (9, "été"), (10, "the cat of the dog the cat"), (11, "rose rose rose"),
    ]
    return spark.createDataFrame(texts, TEXT).repartition(3), spark.createDataFrame(asked, ASKED)


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "texts")
    textindex.write_index(tables[0], "text", path, buckets=5)
    return textindex.read_index(spark, path), path


def test_same_rows_as_searches_of_the_texts(tables, stored):
    texts, asked = tables
    index, _ = stored
    assert rows(textindex.stored_text_match(index, asked)) == rows(text_match(texts, "text", asked))
    assert rows(textindex.stored_text_match(index, asked, k=3)) == rows(text_match(texts, "text", asked, k=3))
    assert rows(textindex.stored_text_match(index, asked, "all")) == rows(text_match(texts, "text", asked, "all"))
    assert rows(textindex.stored_phrase_match(index, asked)) == rows(phrase_match(texts, "text", asked))
    with pytest.raises(ValueError, match="mode"):
        textindex.stored_text_match(index, asked, "some")


def scan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_search_reads_the_buckets_of_its_terms_and_shuffles_no_postings(spark, stored):
    index, path = stored
    asked = spark.createDataFrame([(1, "cat rose")], ASKED)
    names = asked.selectExpr("explode(split(text, ' ')) as token")
    held = textindex._join_terms(index, textindex._asked(asked), ["token"])
    plan = scan_text(held)
    assert "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "token" in plan.split("PushedFilters:")[1].split("]")[0]
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    read = held.select("token").count()
    assert read == textindex._of_terms(index.postings, names, index).count()
    wanted = {r[0] for r in names.select(textindex.bucket_of(names.token, index.buckets)).collect()}
    files = textindex._of_terms(index.postings, names, index).select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r.f.split("bucket=")[1].split("/")[0]) for r in files} == wanted and len(wanted) < index.buckets
    for found in (textindex.stored_text_match(index, asked, "all"), textindex.stored_phrase_match(index, asked)):
        assert all(path in f or "vectable" in f or "rdd-" in f for f in found.inputFiles())


def test_counts_are_those_of_the_rows(stored):
    index, _ = stored
    counted = index.postings.groupBy("bucket", "token").count().withColumnRenamed("count", "rows")
    assert rows(counted) == rows(index.terms.select("bucket", "token", "rows"))


def test_hot_terms_are_spread_over_files(spark, tables, tmp_path, monkeypatch):
    texts, asked = tables
    monkeypatch.setattr(textindex, "HOT_POSTINGS", 20)
    path = str(tmp_path / "hot")
    textindex.write_index(texts, "text", path, buckets=1)
    assert len(glob(f"{path}/postings/bucket=0/*.parquet")) > 1
    index = textindex.read_index(spark, path)
    assert rows(textindex.stored_phrase_match(index, asked)) == rows(phrase_match(texts, "text", asked))


def test_many_terms_and_few_rows_to_ship(tables, stored, monkeypatch):
    texts, asked = tables
    index, _ = stored
    monkeypatch.setattr(textindex, "LISTED_TERMS", 2)
    monkeypatch.setattr(textindex, "MAX_BROADCAST_TERMS", 0)
    assert rows(textindex.stored_text_match(index, asked, "all")) == rows(text_match(texts, "text", asked, "all"))
    assert rows(textindex.stored_phrase_match(index, asked)) == rows(phrase_match(texts, "text", asked))


def test_empty_tables(spark, tables, tmp_path):
    none = spark.createDataFrame([], TEXT)
    textindex.write_index(none, "text", str(tmp_path / "none"))
    index = textindex.read_index(spark, str(tmp_path / "none"))
    for found in (textindex.stored_text_match(index, tables[1]), textindex.stored_text_match(index, tables[1], "all"), textindex.stored_phrase_match(index, tables[1])):
        assert found.count() == 0
    with pytest.raises(ValueError, match="bucket"):
        textindex.write_index(none, "text", str(tmp_path / "bad"), buckets=0)
