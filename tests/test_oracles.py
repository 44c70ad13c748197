"""Every registered query with an SQL twin gives the same rows as DuckDB."""

from __future__ import annotations

import pytest
from compare import difference, oracle_connection

from registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert difference(got, con.execute(ORACLES[name]).df()) is None


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5000


@pytest.mark.parametrize("name", ["knn_cosine", "near_duplicates", "sparse_search_pruned", "assign_ids", "phrase_match"])
def test_rows_do_not_depend_on_partitioning(spark, sf_dir, name):
    first = QUERIES[name](spark, sf_dir).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert difference(QUERIES[name](spark, sf_dir).toPandas(), first) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
