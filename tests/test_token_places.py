"""Places of tokens: grouped where the texts are, without sending each place through a shuffle."""

from __future__ import annotations

from vectable.operators import textsearch


def test_places_are_not_shuffled_by_token(spark):
    texts = spark.createDataFrame([(1, "b a b"), (2, None), (1, "a c"), (3, "")], "id int, text string")
    found = textsearch.token_postings(texts, "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(token" not in plan and plan.count("Exchange") == 1
    rows = sorted((r.token, r.id, r.positions) for r in found.collect())
    assert rows == [("a", 1, [0, 1]), ("b", 1, [0, 2]), ("c", 1, [1])]
