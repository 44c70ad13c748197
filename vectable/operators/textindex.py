"""A stored inverted index: postings by term, written once and read by match and phrase search.

Layout below one folder: ``postings`` in one directory per bucket of terms, each
file sorted by term and id, so that a search reads the directories of its terms
and, within them, the row groups that can hold these; ``terms`` with the number
of rows of each term, in the same buckets; ``about`` with the number of buckets.
Rows of a term with more than ``HOT_POSTINGS`` are spread over several files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectable import session
from vectable.functions.text import one_per_row, placed_per_row, tokens
from vectable.operators.sparse import HOT_POSTINGS, MAX_BROADCAST_TERMS
from vectable.operators.textsearch import token_postings

BUCKETS = 64
#: Terms that are named in the filter of a scan; more are only joined.
LISTED_TERMS = 2000
#: Stored bytes of the postings that one task sorts.
SORTED_BYTES = 4 * 1024 * 1024


@dataclass(frozen=True)
class TextIndex:
    """``postings`` (bucket, token, id, positions) and ``terms`` (bucket, token, rows) as they are stored."""

    postings: DataFrame
    terms: DataFrame
    buckets: int


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write_index(df: DataFrame, col: str, path: str, id_col: str = "id", buckets: int = BUCKETS) -> None:
    """Store the postings of the texts in ``col``; null texts and texts without a word have none."""
    if buckets < 1:
        raise ValueError("at least one bucket")
    rows = token_postings(df, col, id_col).withColumn("bucket", bucket_of(F.col("token"), buckets))
    rows = session.stored(rows, "postings")
    wide = max(min(buckets, session.width(rows)), session.width(rows, SORTED_BYTES))
    terms = rows.groupBy("bucket", "token").agg(F.count("*").alias("rows"))
    files = min(buckets, session.width(df))
    terms.repartition(files, "bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/terms")
    counts = df.sparkSession.read.schema("bucket int, token string, rows bigint").parquet(f"{path}/terms")
    hot = counts.filter(F.col("rows") > HOT_POSTINGS)
    hot = hot.select("token", F.ceil(F.col("rows") / HOT_POSTINGS).alias("parts"))
    # Every hot term has more than HOT_POSTINGS rows, so there are few of them.
    rows = rows.join(session.broadcast_checked(hot, MAX_BROADCAST_TERMS), "token", "left")
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1).cast("bigint")))
    # A bucket goes to several tasks, by token, where one would have more than SORTED_BYTES of it.
    share = F.pmod(F.xxhash64("token", F.lit(1)), F.lit(-(-wide // buckets)))
    dealt = rows.withColumn("part", part).withColumn("share", share).drop("parts").repartition(wide, "bucket", "share", "part")
    ordered = dealt.drop("part", "share").sortWithinPartitions("bucket", "token", "id")
    ordered.select("bucket", "token", "id", "positions").write.partitionBy("bucket").parquet(f"{path}/postings")
    kind = df.schema[id_col].dataType.simpleString()
    about = df.sparkSession.range(1).select(F.lit(buckets).alias("buckets"), F.lit(kind).alias("id"))
    about.coalesce(1).write.parquet(f"{path}/about")


def read_index(spark: SparkSession, path: str) -> TextIndex:
    """The index stored at ``path``; nothing but its bucket count and the type of its ids is read yet."""
    about = spark.read.parquet(f"{path}/about").first()
    terms = spark.read.schema("bucket int, token string, rows bigint").parquet(f"{path}/terms")
    postings = spark.read.schema(f"bucket int, token string, id {about.id}, positions array<int>").parquet(f"{path}/postings")
    return TextIndex(postings, terms, about.buckets)


def _of_terms(rows: DataFrame, asked: DataFrame, index: TextIndex) -> DataFrame:
    """Rows of the index whose token is in ``asked`` (token): few buckets and few tokens as filters of the scan."""
    used = asked.select("token").distinct()
    named = [r.token for r in used.limit(LISTED_TERMS + 1).collect()]
    if len(named) <= LISTED_TERMS:
        held = used.select(bucket_of(F.col("token"), index.buckets).alias("bucket")).distinct()
        rows = rows.filter(F.col("bucket").isin([r.bucket for r in held.collect()]) & F.col("token").isin(named))
    elif index.buckets <= LISTED_TERMS:
        held = used.select(bucket_of(F.col("token"), index.buckets).alias("bucket")).distinct()
        rows = rows.filter(F.col("bucket").isin([r.bucket for r in held.collect()]))
    return rows


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, token): the distinct tokens of each query."""
    return session.cut(one_per_row(queries, F.array_distinct(tokens("text")), "query_id", name="token"))


def _with_rows(asked: DataFrame, index: TextIndex) -> DataFrame:
    """``asked`` with the stored number of rows of each token; 0 for tokens of no text."""
    found = _of_terms(index.terms, asked, index).select("token", "rows")
    return asked.join(found, "token", "left").na.fill(0, ["rows"])


def _rarest(asked: DataFrame, index: TextIndex) -> DataFrame:
    """(query_id, token): of each query the token in the fewest rows; none for queries with a token of no text."""
    per_query = Window.partitionBy("query_id")
    place = F.row_number().over(per_query.orderBy("rows", "token"))
    ranked = _with_rows(asked, index).withColumn("place", place)
    return ranked.filter((F.col("place") == 1) & (F.col("rows") > 0)).select("query_id", "token")


def _join_terms(index: TextIndex, asked: DataFrame, on: list[str]) -> DataFrame:
    """Stored postings met with rows of ``asked``; the postings stay where they are while the asked rows are few (counted)."""
    held = _of_terms(index.postings, asked, index).drop("bucket")
    return held.join(session.broadcast_checked(asked, MAX_BROADCAST_TERMS), on)


def stored_text_match(index: TextIndex, queries: DataFrame, mode: str = "any", k: int | None = None) -> DataFrame:
    """(query_id, id, matched) as ``text_match`` gives them, from the stored index alone.

    Mode "all" starts from the rarest token of each query, known from the stored counts.
    """
    asked = _asked(queries)
    if mode == "any":
        found = _join_terms(index, asked, ["token"])
        matched = found.groupBy("query_id", "id").agg(F.count("*").cast("int").alias("matched"))
    elif mode == "all":
        lead = session.cut(_rarest(asked, index))
        proposed = _join_terms(index, lead, ["token"]).select("query_id", "id", F.col("token").alias("lead"))
        others = proposed.join(session.broadcast_checked(asked, MAX_BROADCAST_TERMS), "query_id").filter(F.col("token") != F.col("lead"))
        others = session.cut(others.select("query_id", "id", "token"))
        seen = _join_terms(index, others, ["token", "id"]).groupBy("query_id", "id").agg(F.count("*").alias("n"))
        needed = asked.groupBy("query_id").agg(F.count("*").cast("int").alias("matched"))
        matched = (
            proposed.join(session.broadcast_checked(needed, MAX_BROADCAST_TERMS), "query_id")
            .join(seen, ["query_id", "id"], "left")
            .filter(F.coalesce("n", F.lit(0)) == F.col("matched") - 1)
            .select("query_id", "id", "matched")
        )
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if k is None:
        return matched
    order = Window.partitionBy("query_id").orderBy(F.col("matched").desc(), "id")
    return matched.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def stored_phrase_match(index: TextIndex, queries: DataFrame) -> DataFrame:
    """(query_id, id, start) as ``phrase_match`` gives them, from the stored index alone.

    Places are proposed by the rarest token of a phrase; of the other tokens
    only the rows that a proposed place needs are looked into.
    """
    phrases = queries.select("query_id", tokens("text").alias("phrase")).filter(F.size("phrase") > 0)
    spots = session.cut(placed_per_row(phrases, "phrase", "query_id", name="token").withColumnRenamed("pos", "offset"))
    lead = _rarest(spots.select("query_id", "token").distinct(), index)
    lead = session.cut(spots.join(lead, ["query_id", "token"]).groupBy("query_id", "token").agg(F.min("offset").alias("first")))
    proposed = (
        _join_terms(index, lead, ["token"])
        .select("query_id", "id", "token", F.explode("positions").alias("pos"), "first")
        .select("query_id", "id", F.col("token").alias("lead"), "first", (F.col("pos") - F.col("first")).alias("start"))
        .filter(F.col("start") >= 0)
    )
    proposed = session.cut(proposed)
    others = proposed.join(session.broadcast_checked(spots, MAX_BROADCAST_TERMS), "query_id")
    others = others.filter((F.col("token") != F.col("lead")) | (F.col("offset") != F.col("first")))
    places = others.groupBy("query_id", "id", "token").agg(F.collect_list(F.struct("start", "offset")).alias("places"))
    held = _join_terms(index, session.cut(places), ["token", "id"])
    seen = (
        held.select("query_id", "id", F.explode("places").alias("p"), "positions")
        .filter(F.array_contains("positions", F.col("p.start") + F.col("p.offset")))
        .groupBy("query_id", "id", F.col("p.start").alias("start"))
        .agg(F.count("*").alias("n"))
    )
    lengths = session.broadcast_checked(phrases.select("query_id", F.size("phrase").alias("length")), MAX_BROADCAST_TERMS)
    return (
        proposed.join(lengths, "query_id")
        .join(seen, ["query_id", "id", "start"], "left")
        .filter(F.coalesce("n", F.lit(0)) == F.col("length") - 1)
        .select("query_id", "id", "start")
    )
