"""Sparse vectors: postings, exact search, and the same search with upper-bound pruning."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectable import session
from vectable.functions.blockmax import Walk, entries
from vectable.functions.text import one_per_row, tokens
from vectable.operators.search import top_ranked

DROP_RATIO = 0.2  # fixed value: declared default
MAX_BROADCAST_TERMS = 1_000_000
HOT_POSTINGS = 1_000_000
CELL_ENTRIES = 4_000_000


def term_counts(df: DataFrame, id_col: str, text: str, out_id: str = "id") -> DataFrame:
    """(id, vector): sparse vector of token counts per text.

    One shuffle by id serves both groupings.
    """
    texts = session.by_key(df.select(F.col(id_col).alias(out_id), F.col(text).alias("_text")), out_id)
    words = one_per_row(texts, tokens("_text"), out_id)
    counts = words.groupBy(out_id, "term").agg(F.count("*").cast("double").alias("weight"))
    entries = F.map_from_entries(F.collect_list(F.struct("term", "weight")))
    return counts.groupBy(out_id).agg(entries.alias("vector"))


def sparse_postings(df: DataFrame, drop_ratio: float = DROP_RATIO) -> DataFrame:
    """(term, id, weight) without the smallest-magnitude share of every vector.

    floor(drop_ratio * entries) entries are dropped per vector, ties by term.
    No shuffle: the entries of one vector are sorted in the row.
    """
    if not 0.0 <= drop_ratio <= 1.0:
        raise ValueError("drop_ratio must be within 0..1")
    entries = F.transform(
        F.map_entries("vector"),
        lambda e: F.struct(F.abs(e["value"]).alias("size"), e["key"].alias("term"), e["value"].alias("weight")),
    )
    drop = F.floor(F.lit(float(drop_ratio)) * F.size("vector")).cast("int")
    kept = F.slice(F.sort_array(entries), drop + 1, F.size("vector"))
    return (
        one_per_row(df, kept, "id", name="e")
        .select(F.col("e.term").alias("term"), "id", F.col("e.weight").cast("double").alias("weight"))
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, asked): one row per entry of the query vectors."""
    return queries.select("query_id", F.explode("vector").alias("term", "asked")).withColumn(
        "asked", F.col("asked").cast("double")
    )


def term_join(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings met with the query rows of the same term.

    A checked, bounded query side is broadcast, and the postings it can reach
    are placed by id first, so that a later grouping by (query, id) needs no
    shuffle. A larger query side is joined by (term, part): postings of a hot
    term are split into parts and its query rows repeated per part.
    """
    if session.small_enough(terms, MAX_BROADCAST_TERMS):
        used = F.broadcast(terms.select("term").distinct())
        reached = session.by_key(postings.join(used, "term", "left_semi"), "id")
        return reached.join(F.broadcast(terms), "term")
    hot = (
        postings.groupBy("term").agg(F.count("*").alias("n"))
        .filter(F.col("n") > HOT_POSTINGS)
        .select("term", F.ceil(F.col("n") / HOT_POSTINGS).alias("parts"))
    )
    # Every hot term has more than HOT_POSTINGS rows, so there are few of them.
    hot = session.broadcast_checked(session.cut(hot), 1_000_000)
    parts = F.coalesce("parts", F.lit(1).cast("bigint"))
    left = postings.join(hot, "term", "left").withColumn("part", F.pmod(F.xxhash64("id"), parts))
    right = terms.join(hot, "term", "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    )
    return left.drop("parts").join(right.drop("parts"), ["term", "part"]).drop("part")


def _summed(matched: DataFrame) -> DataFrame:
    return matched.groupBy("query_id", "id").agg(F.sum(F.col("asked") * F.col("weight")).alias("total"))


def sparse_search(postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k best inner products among the rows that share a term with the query."""
    summed = _summed(term_join(postings, query_terms(queries)))
    return top_ranked(summed.withColumn("score", F.round("total", 6)), k, "IP")


def sparse_search_pruned(postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Same answer as ``sparse_search`` with fewer scored pairs.

    Postings are gathered to rows, which tasks walk in order of falling peak
    weight; a block of rows whose largest weights cannot lift it to a query's
    running k-th score is skipped for that query. Few query entries (counted)
    go to every task, and only postings of their terms are read on; more meet
    the rows in a grid of cells with bounded entries. Each task or cell
    emits k rows per query.
    """
    asked = queries.select("query_id", F.map_entries("vector").alias("e")).filter(F.size("e") > 0)
    asked = session.cut(asked.select("query_id", _hashes("e.key").alias("terms"), F.col("e.value").cast("array<double>").alias("weights")))
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("entries")).first()
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (postings, "id"))]
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    if not size.n or k < 1:
        return top_ranked(postings.sparkSession.createDataFrame([], schema), max(k, 1), "IP")
    held = postings.select("id", F.xxhash64("term").alias("term"), F.col("weight").cast("double").alias("weight"))
    few = size.entries <= MAX_BROADCAST_TERMS
    if few:
        used = asked.select(F.explode("terms").alias("term")).distinct()
        held = held.join(F.broadcast(used), "term", "left_semi")
    entry = F.struct("term", "weight")
    rows = (
        session.by_key(held, "id").groupBy("id")
        .agg(F.collect_list(entry).alias("e"), F.max(F.abs("weight")).alias("peak"))
        .select("id", F.col("e.term").alias("terms"), F.col("e.weight").alias("weights"), "peak")
    )
    if few:
        found = _walked(rows.sortWithinPartitions(F.desc("peak"), "id").drop("peak"), asked, k, schema)
    else:
        found = _walked_cells(rows, asked, k, schema, size.entries)
    return top_ranked(found, k, "IP")


def _hashes(col: str):
    return F.transform(F.col(col), lambda t: F.xxhash64(t))


def _best_of(walk: Walk, query_ids: pa.Array, id_type: pa.DataType) -> pa.RecordBatch:
    query, ids, score = walk.rows()
    return pa.RecordBatch.from_arrays([query_ids.take(pa.array(query)), pa.array(ids, id_type), pa.array(score)], names=["query_id", "id", "score"])


def _walk_of(asked: pa.Table, k: int) -> Walk:
    terms, first = entries(asked.column("terms"))
    return Walk(terms, entries(asked.column("weights"))[0], first, k)


def _walked(rows: DataFrame, asked: DataFrame, k: int, schema: str) -> DataFrame:
    """Rows walked past all queries, which every task holds."""
    block = asked.toArrow()
    query_ids = block.column("query_id").combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, id_type = _walk_of(block, k), None
        for batch in batches:
            id_type = batch.schema.field("id").type
            walk.offer(batch)
        if id_type is not None:
            yield _best_of(walk, query_ids, id_type)

    return rows.mapInArrow(run, schema)


def _walked_cells(rows: DataFrame, asked: DataFrame, k: int, schema: str, n_entries: int) -> DataFrame:
    """Parts of the rows met with parts of the queries, each of about ``CELL_ENTRIES`` entries."""
    rows = session.stored(rows, "rows")
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    row_parts, query_parts = (max(1, -(-n // CELL_ENTRIES)) for n in (total, n_entries))

    def every(parts: int):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    left = rows.withColumn("rp", F.pmod(F.xxhash64("id"), F.lit(row_parts)).cast("int")).withColumn("qp", every(query_parts))
    right = asked.withColumn("qp", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int")).withColumn("rp", every(row_parts))

    def cell(held: pa.Table, wanted: pa.Table) -> pa.Table:
        if not held.num_rows or not wanted.num_rows:
            ids = [pa.array([], t.schema.field(c).type) for t, c in ((wanted, "query_id"), (held, "id"))]
            return pa.table([*ids, pa.array([], pa.float64())], names=["query_id", "id", "score"])
        walk = _walk_of(wanted, k)
        walk.offer(held.sort_by([("peak", "descending"), ("id", "ascending")]))
        return pa.Table.from_batches([_best_of(walk, wanted.column("query_id").combine_chunks(), held.schema.field("id").type)])

    return left.groupBy("rp", "qp").cogroup(right.groupBy("rp", "qp")).applyInArrow(cell, schema)
