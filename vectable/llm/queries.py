"""Registered queries: each operator of the subpackage on its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectable.llm import bpe, decontaminate, edits, html, jaccard, langid, middle, orchard, repeats, seating, sharding, topk, warc
from vectable.llm.registry import ORACLES, QUERIES, folder, query, table, written
from vectable.session import broadcast_checked

__all__ = ["ORACLES", "QUERIES"]


@query("op10_bpe_roundtrip")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, and the text that they decode to, as digests."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(texts, decoded="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


OP4_SQL = r"""
with doc as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
item as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
short as (select distinct least(len(w), 13) as m from item where len(w) > 0),
item_window as (
  select distinct item_id, least(len(w), 13) as m, list_slice(w, i, i + least(len(w), 13) - 1) as win
  from item, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) as t(i) where len(w) > 0),
doc_window as (
  select doc_id, m, i, list_slice(w, i, i + m - 1) as win
  from doc, short, unnest(generate_series(1, len(w) - m + 1)) as t(i) where len(w) >= m),
hit as (
  select doc_id, m, i, item_id from doc_window join item_window using (m, win)),
hit_words as (
  select doc_id, count(distinct p) as n_hit from hit, unnest(generate_series(i, i + m - 1)) as t(p) group by doc_id),
hit_items as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct doc_id, item_id::varchar as item from hit) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join hit_words using (doc_id) left join hit_items using (doc_id)"""


def contaminated(found: DataFrame) -> DataFrame:
    """``found`` of ``contamination`` with n_hit and the verdict: a twentieth of the words, at least one."""
    return found.withColumn(
        "n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


@query("op4_decontaminate", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return contaminated(found).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP2_SQL = """
with page as (
  select page_id, coalesce(html, '') as payload from pages),
known as (
  select page_id, strlen(payload)::bigint as payload_bytes, sha1(payload) as payload_digest, payload from page),
chosen as (
  select payload, max(page_id) as chosen from known where payload_bytes >= 1000 group by payload)
select page_id, payload_bytes, payload_digest,
       case when chosen <> page_id then 'revisit' else 'response' end as record_type,
       case when chosen <> page_id then chosen end as refers_to
from known left join chosen using (payload)"""


@query("op2_warc", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    path = folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path).filter("reason is null")
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.nullif(page(c), F.lit("")).cast("bigint")
    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"),
    )


OP3_SQL = """
with held as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as w
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
pairs as (
  select q.vec_id as query_id, b.vec_id,
         coalesce(list_sum(list_transform(range(1, least(len(q.w), len(b.w)) + 1), lambda i: q.w[i] * b.w[i])), 0)::bigint as score
  from held q, held b where q.vec_id % 100 = 0 and q.vec_id <> b.vec_id)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
where rank <= 10"""


@query("op3_exact_top_k", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best integer inner products of every hundredth vector against all others."""
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = topk.exact_top_k(base, base.filter(F.col("id") % 100 == 0), 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op7_virtual_slots")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight shards of nearly equal bytes, by slots; version 2 of the map is in force."""
    text = F.coalesce("text", F.lit(""))
    records = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    records = written(records.withColumn("slot", sharding.slot_of(F.col("doc_id"), F.col("text_crc32"))), "records")
    totals = written(sharding.slot_totals(records), "slot-totals")
    first = written(sharding.even_map(spark, 8), "slot-map-version-1")
    second = written(sharding.rebalanced(first, totals, 8), "slot-map-version-2")
    found = sharding.placed(records, second, totals, "doc_id", "text_crc32", "size")
    return found.select(
        "doc_id", "size", "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("slot").alias("virtual_slot"),
        "version",
    )


@query("op1_html_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op8_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and copies of every document under 5-gram Jaccard similarity of 0.8."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text without strings of 100 bytes that occurred before."""
    found = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def scripted_edits() -> Column:
    """Three edits of every text, made of the row: a label for five characters, the opening said again, a shorter end."""
    size = F.length(F.coalesce("text", F.lit("")))
    edit = lambda at, removed, inserted: F.struct(
        at.cast("int").alias("at"), removed.cast("int").alias("removed"), inserted.alias("inserted")
    )
    return F.array(
        edit(F.floor(size / 3), F.lit(5), F.coalesce("lang", F.lit(""))),
        edit(F.floor(2 * size / 3), F.lit(0), F.substring(F.coalesce("text", F.lit("")), 1, 20)),
        edit(F.greatest(size - 10, F.lit(0)), size, F.coalesce("source", F.lit(""))),
    )


@query("op5_edit_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text before and after three edits, and how many pre-tokens were encoded for them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", scripted_edits().alias("edits"))
    before = edits.token_trees(docs).withColumn("n_before", F.col("n_tokens"))
    after = edits.apply_edits(before)
    return after.select(
        "doc_id", "n_before", F.col("n_tokens").alias("n_after"), F.size("leaf_chars").cast("bigint").alias("n_pretokens"), "n_encoded"
    )


OP13_SQL = """
with cut as (
  select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
drawn as (
  select doc_id, t, length(t)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
         ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from cut),
formed as (
  select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn),
parts as (
  select *, substring(t, 1, a) as prefix, substring(t, a + 1, b - a) as middle, substring(t, b + 1) as suffix from formed)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256
from parts"""


@query("op13_fill_in_middle", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its middle moved to the end, and the text rebuilt from that, as digests."""
    moved = middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), restored="restored")
    return moved.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of training as one chain of tables; vectors of 64 components as in ``embeddings``."""
    width = 64 // parts
    steps = [
        f"""point as materialized (
  select vec_id, label, p, list_transform(range(1, {width + 1}), lambda j: floor(4096 * embedding[p * {width} + j]::double)::bigint) as x
  from embeddings, unnest(range({parts})) as t(p)
  where embedding is not null and len(list_filter(embedding, lambda v: v is null or isnan(v) or isinf(v))) = 0)""",
        f"""book0 as materialized (
  select p, (row_number() over (partition by p order by vec_id) - 1)::int as e, x
  from point where vec_id in (select distinct vec_id from point order by vec_id limit {entries}))""",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""near{n} as materialized (
  select vec_id, label, p, x, min(struct_pack(d := d, e := e)) as best from (
    select q.vec_id, q.label, q.p, q.x, b.e,
           list_sum(list_transform(range(1, {width + 1}), lambda j: (q.x[j] - b.x[j]) * (q.x[j] - b.x[j])))::bigint as d
    from point q join book{n} b on q.p = b.p)
  group by all)"""
        )
        if n < rounds:
            floored = "((s - ((s % n) + n) % n) // n)::bigint"
            steps.append(
                f"""book{n + 1} as materialized (
  select b.p, b.e, coalesce(m.x, b.x) as x from book{n} b left join (
    select p, e, list({floored} order by j) as x from (
      select p, best.e as e, j, sum(x[j]) as s, count(*) as n from near{n}, unnest(range(1, {width + 1})) as t(j) group by all)
    group by p, e) m on b.p = m.p and b.e = m.e)"""
            )
    steps.append(
        f"""coded as (
  select vec_id, label, string_agg(format('{{:02x}}', best.e), '' order by p) as code, sum(best.d)::bigint as error
  from near{rounds} group by vec_id, label)"""
    )
    return (
        "with " + ",\n".join(steps) + f"""
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
       (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) from book{rounds}) as codebooks_sha256
from coded"""
    )


@query("op11_orchard_codes", op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors under codebooks trained on all of them, with their errors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = orchard.train(vectors)
    coded = written(orchard.encode(vectors, books).drop("embedding"), "codes")
    exact = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = coded.groupBy("label").agg(F.least(exact, F.lit(2**63 - 1)).cast("bigint").alias("label_error"))
    totals = broadcast_checked(totals.withColumnRenamed("label", "_label"), 1_000_000)
    joined = coded.join(totals, coded["label"].eqNullSafe(F.col("_label")))
    digest = orchard.Codebooks([], 0, 0).sha256() if books is None else books.sha256()
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


@query("op12_pitman_yor_scores")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every text under the model of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return seating.score(docs, seating.train(docs))
