"""Token postings, full-text match and phrase match for tables of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectable import session
from vectable.functions.text import one_per_row, placed_per_row, tokens
from vectable.operators.sparse import term_join

TEXT_BYTES = 2 * 1024 * 1024  # estimated bytes of the texts whose places one task groups


def token_postings(df: DataFrame, col: str, id_col: str = "id") -> DataFrame:
    """(token, id, positions): where each token stands in each text, from 0."""
    # The texts are dealt by id, so their many more places are grouped without a further shuffle.
    texts = session.by_key(df.select(F.col(id_col).alias("id"), F.col(col).alias("_text")), "id", each=TEXT_BYTES)
    places = placed_per_row(texts, tokens("_text"), "id", name="token")
    return places.groupBy("token", "id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def _distinct_terms(queries: DataFrame, text: str) -> DataFrame:
    """(query_id, term, asked): the distinct tokens of each query."""
    words = one_per_row(queries, F.array_distinct(tokens(text)), "query_id")
    return words.withColumn("asked", F.lit(1))


def text_match(
    df: DataFrame,
    col: str,
    queries: DataFrame,
    mode: str = "any",
    k: int | None = None,
    id_col: str = "id",
) -> DataFrame:
    """(query_id, id, matched): texts with any or all tokens of each query.

    ``queries`` has ``query_id`` and ``text``. With ``k`` the best k per query by
    matched tokens, then id, with their ``rank``. In mode "all" a text is reached through
    the rarest token of the query alone, and checked against the others: the
    corpus is tokenized once, and what the queries' tokens reach is stored.
    """
    texts = session.spread(df.select(F.col(id_col).alias("id"), F.col(col).alias("_text")))
    words = one_per_row(texts, F.array_distinct(tokens("_text")), "id")
    terms = _distinct_terms(queries, "text")
    if mode == "any":
        matched = term_join(words, terms).groupBy("query_id", "id").agg(
            F.count("*").cast("int").alias("matched")
        )
    elif mode == "all":
        terms = session.cut(terms)
        used = session.broadcast_checked(terms.select("term").distinct(), 1_000_000)
        relevant = session.stored(words.join(used, "term", "left_semi"), "words")
        lead = session.cut(_rarest(relevant, terms))
        lead = session.broadcast_checked(lead, 1_000_000)
        proposed = relevant.join(lead, "term").select("query_id", "id")
        needed = terms.groupBy("query_id").agg(F.count("*").alias("needed"))
        matched = (
            proposed.join(session.broadcast_checked(terms, 1_000_000), "query_id")
            .select("query_id", "id", "term")
            .join(relevant, ["id", "term"])
            .groupBy("query_id", "id")
            .agg(F.count("*").cast("int").alias("matched"))
            .join(needed, "query_id")
            .filter(F.col("matched") == F.col("needed"))
            .drop("needed")
        )
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if k is None:
        return matched
    order = Window.partitionBy("query_id").orderBy(F.col("matched").desc(), "id")
    ranked = matched.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def _rarest(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, term): the token of each query with the fewest rows in ``words``; absent counts as 0."""
    counts = words.groupBy("term").agg(F.count("*").alias("df"))
    order = Window.partitionBy("query_id").orderBy("df", "term")
    return (
        terms.join(counts, "term", "left")
        .na.fill(0, ["df"])
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") == 1)
        .select("query_id", "term")
    )


def phrase_match(df: DataFrame, col: str, queries: DataFrame, id_col: str = "id") -> DataFrame:
    """(query_id, id, start): every place where the tokens of a phrase stand in a row.

    A place is proposed by the rarest token of the phrase only; then the
    expected (id, position, token) rows are looked up by equality.
    """
    texts = session.spread(df.select(F.col(id_col).alias("id"), F.col(col).alias("_text")))
    words = placed_per_row(texts, tokens("_text"), "id")
    asked = queries.select("query_id", tokens("text").alias("phrase")).filter(F.size("phrase") > 0)
    spots = session.cut(
        placed_per_row(asked, "phrase", "query_id").withColumnRenamed("pos", "offset")
    )
    used = session.broadcast_checked(spots.select("term").distinct(), 1_000_000)
    relevant = session.stored(words.join(used, "term", "left_semi"), "words")
    lead = session.cut(
        spots.join(_rarest(relevant, spots.select("query_id", "term").distinct()), ["query_id", "term"])
        .groupBy("query_id", "term")
        .agg(F.min("offset").alias("offset"))
    )
    proposed = (
        relevant.join(session.broadcast_checked(lead, 100_000), "term")
        .select("query_id", "id", (F.col("pos") - F.col("offset")).alias("start"))
        .filter(F.col("start") >= 0)
    )
    expected = proposed.join(session.broadcast_checked(spots, 1_000_000), "query_id").select(
        "query_id", "id", "start", (F.col("start") + F.col("offset")).alias("pos"), "term"
    )
    lengths = asked.select("query_id", F.size("phrase").alias("length"))
    return (
        expected.join(relevant, ["id", "pos", "term"])
        .groupBy("query_id", "id", "start")
        .agg(F.count("*").alias("n"))
        .join(lengths, "query_id")
        .filter(F.col("n") == F.col("length"))
        .select("query_id", "id", "start")
    )
