"""Sparse search, near-duplicates, full text and phrases on documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import query, ranked_sql, table, workspace
from vectable.functions.text import shingles
from vectable.operators import neardup, sparse, textindex, textsearch
from vectable.session import spread

K = 10
_SPLIT = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
DOC_WORDS = _SPLIT.format("text")

# -- sparse ------------------------------------------------------------------

_COUNTS = f"""counts as (
  select doc_id as id, term, count(*)::double as weight
  from (select doc_id, unnest({DOC_WORDS}) as term from documents) group by 1, 2),
asked as (
  select item_id as query_id, term, count(*)::double as asked
  from (select item_id, unnest({DOC_WORDS}) as term from benchmark) group by 1, 2),
postings as (
  select term, id, weight from (
    select *, row_number() over (partition by id order by abs(weight), term) as place,
      count(*) over (partition by id) as n from counts)
  where place > floor(0.2::double * n))"""
_IP = """select query_id, id, round(sum(asked * weight), 6) as score
  from asked join postings using (term) group by 1, 2"""


def _postings(spark, sf_dir):
    return sparse.sparse_postings(sparse.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))


def _sparse_queries(spark, sf_dir):
    return sparse.term_counts(table(spark, sf_dir, "benchmark"), "item_id", "text", "query_id")


@query("sparse_postings", f"with {_COUNTS} select term, id, weight from postings")
def sparse_postings(spark, sf_dir):
    return _postings(spark, sf_dir)


@query("sparse_search", f"with {_COUNTS} {ranked_sql(_IP, K, False)}")
def sparse_search(spark, sf_dir):
    return sparse.sparse_search(_postings(spark, sf_dir), _sparse_queries(spark, sf_dir), K)


@query("sparse_search_pruned", f"with {_COUNTS} {ranked_sql(_IP, K, False)}")
def sparse_search_pruned(spark, sf_dir):
    return sparse.sparse_search_pruned(_postings(spark, sf_dir), _sparse_queries(spark, sf_dir), K)


# -- near-duplicates ---------------------------------------------------------

N = 3


def _grams(words):
    return f"""list_distinct(list_transform(range(1, greatest(len({words}) - {N - 1} + 1, 1)),
      lambda i: array_to_string(list_slice({words}, i, i + {N - 1}), ' ')))"""


def _sets(name, source, key, short="false"):
    """(id, g): shingles per text; texts below N words have none, or one when ``short``."""
    return f"""{name} as (
      select id, case when {short} and len(words) < {N} then [array_to_string(words, ' ')]
        else {_grams('words')} end as g
      from (select {key} as id, {DOC_WORDS} as words from {source}))"""


_PARAMS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(neardup.hash_parameters(neardup.NUM_HASH)))


def _signature(name, sets):
    return f"""{name} as (
      select id, i, min((a * h + b) % {neardup.PRIME}) as m from (
        select id, ('0x' || substr(md5(s), 1, 7))::bigint as h
        from (select id, unnest(g) as s from {sets})), (values {_PARAMS}) p(i, a, b)
      group by 1, 2)"""


_ROWS = neardup.NUM_HASH // neardup.BANDS


def _bands(name, signature):
    return f"""{name} as (
      select id, i // {_ROWS} as band, string_agg(m::varchar, '-' order by i) as key from {signature} group by 1, 2)"""


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _shingled(spark, sf_dir):
    return shingles(spread(_documents(spark, sf_dir)), "text", N).select("id", "shingles")


@query(
    "shingles",
    f"""with {_sets('sets', 'documents', 'doc_id')}
    select id, len(g)::int as n, md5(array_to_string(list_sort(g), '|')) as mark from sets""",
)
def shingle_sets(spark, sf_dir):
    joined = F.array_join(F.sort_array("shingles"), "|")
    return _shingled(spark, sf_dir).select(
        "id", F.size("shingles").alias("n"), F.md5(joined.cast("binary")).alias("mark")
    )


_SIG = f"with {_sets('sets', 'documents', 'doc_id')}, {_signature('sig', 'sets')}"


@query("minhash", f"{_SIG} select id, i as hash_no, m as value from sig")
def minhash(spark, sf_dir):
    return neardup.minhash(_shingled(spark, sf_dir)).select(
        "id", F.posexplode("signature").alias("hash_no", "value")
    )


@query(
    "lsh_candidates",
    f"""{_SIG}, {_bands('bands', 'sig')}
    select distinct b.band::int as band, f.first as first_id, b.id
    from bands b join (select band, key, min(id) as first from bands group by 1, 2) f using (band, key)
    where b.id <> f.first""",
)
def lsh_candidates(spark, sf_dir):
    return neardup.lsh_candidates(neardup.minhash(_shingled(spark, sf_dir)))


THRESHOLD = 0.7


@query(
    "near_duplicates",
    f"""with {_sets('sets', 'documents', 'doc_id', 'true')}, {_signature('sig', 'sets')}, {_bands('bands', 'sig')},
    pairs as (select distinct a.id as first_id, b.id from bands a join bands b using (band, key) where a.id < b.id),
    scored as (
      select p.first_id, p.id, round(len(list_intersect(x.g, y.g))::double
        / len(list_distinct(list_concat(x.g, y.g))), 6) as jaccard
      from pairs p join sets x on x.id = p.first_id join sets y on y.id = p.id
    where not list_contains(x.g, '') and not list_contains(y.g, ''))
    select id, min(first_id) as first_id, arg_min(jaccard, first_id) as jaccard
    from scored where jaccard >= {THRESHOLD} group by 1""",
)
def near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(_documents(spark, sf_dir), THRESHOLD, N)


_AGREEMENT = f"""select p.query_id, p.id, round((select count(*) from sig d join qsig q on d.i = q.i and d.m = q.m
  where d.id = p.id and q.id = p.query_id)::double / {neardup.NUM_HASH}, 6) as score from (
  select distinct q.id as query_id, d.id from qbands q join bands d using (band, key)) p"""


@query(
    "lsh_search",
    f"""{_SIG}, {_bands('bands', 'sig')}, qsig as (select * from sig), qbands as (select * from bands)
    {ranked_sql(_AGREEMENT, K, False)}""",
)
def lsh_search(spark, sf_dir):
    """Documents that resemble each document."""
    stored = neardup.minhash(_shingled(spark, sf_dir))
    asked = stored.select(F.col("id").alias("query_id"), "signature")
    return neardup.lsh_search(stored, asked, K)


# -- full text ---------------------------------------------------------------

_PLACES = f"""places as (
  select id, term, pos::int as pos from (
    select id, unnest(words) as term, unnest(range(len(words))) as pos
    from (select doc_id as id, {DOC_WORDS} as words from documents))),
spots as (
  select query_id, term, pos::int as pos, n from (
    select query_id, len(words) as n, unnest(words) as term, unnest(range(len(words))) as pos
    from (select item_id as query_id, {DOC_WORDS} as words from benchmark)))"""


def _benchmark(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(
    "token_postings",
    f"""with {_PLACES} select term as token, id, count(*)::int as n, min(pos) as first, max(pos) as last
    from places group by 1, 2""",
)
def token_postings(spark, sf_dir):
    postings = textsearch.token_postings(table(spark, sf_dir, "documents"), "text", "doc_id")
    return postings.select(
        "token", "id", F.size("positions").alias("n"), F.col("positions")[0].alias("first"),
        F.element_at("positions", -1).alias("last"),
    )


_MATCHED = """select s.query_id, p.id, count(distinct p.term)::int as matched
  from spots s join (select distinct id, term from places) p on p.term = s.term group by 1, 2"""


_ANY_SQL = f"""with {_PLACES} select query_id, id, matched, rank::int as rank from (
      select *, row_number() over (partition by query_id order by matched desc, id) as rank from ({_MATCHED}))
    where rank <= 20"""
_ALL_SQL = f"""with {_PLACES} select m.query_id, id, matched from ({_MATCHED}) m
    join (select query_id, count(distinct term) as needed from spots group by 1) q using (query_id)
    where matched = needed"""
_PHRASE_SQL = f"""with {_PLACES} select s.query_id, p.id, (p.pos - s.pos)::int as start
    from spots s join places p on p.term = s.term group by s.query_id, p.id, p.pos - s.pos, s.n
    having count(*) = s.n"""


@query("text_match_any", _ANY_SQL)
def text_match_any(spark, sf_dir):
    return textsearch.text_match(
        table(spark, sf_dir, "documents"), "text", _benchmark(spark, sf_dir), "any", 20, "doc_id"
    )


@query("text_match_all", _ALL_SQL)
def text_match_all(spark, sf_dir):
    return textsearch.text_match(
        table(spark, sf_dir, "documents"), "text", _benchmark(spark, sf_dir), "all", None, "doc_id"
    )


@query(
    "text_match_names",
    f"""with words as (select p_partkey as id, unnest(list_distinct({_SPLIT.format('p_name')})) as term from part),
    asked as (select query_id, unnest(list_distinct({_SPLIT.format('p_name')})) as term, query_id as q from (
      select p_name, min(p_partkey) as query_id from part group by 1)),
    needed as (select query_id, count(*) as needed from asked group by 1)
    select a.query_id, w.id, count(*)::int as matched from asked a join words w on w.term = a.term
    join needed n on n.query_id = a.query_id group by a.query_id, w.id, n.needed having count(*) = n.needed""",
)
def text_match_names(spark, sf_dir):
    """Every distinct product name as a query of all its words."""
    part = table(spark, sf_dir, "part")
    names = part.groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("query_id"))
    return textsearch.text_match(part, "p_name", names, "all", None, "p_partkey")


@query("phrase_match", _PHRASE_SQL)
def phrase_match(spark, sf_dir):
    return textsearch.phrase_match(
        table(spark, sf_dir, "documents"), "text", _benchmark(spark, sf_dir), "doc_id"
    )


# -- stored index ------------------------------------------------------------


def _index(spark, sf_dir):
    """The documents' index, written and opened again."""
    path = workspace(spark, "text-index")
    textindex.write_index(table(spark, sf_dir, "documents"), "text", path, "doc_id")
    return textindex.read_index(spark, path)


@query(
    "text_index_terms",
    f"with {_PLACES} select term as token, count(distinct id) as rows from places group by 1",
)
def text_index_terms(spark, sf_dir):
    """The stored number of rows of every term."""
    return _index(spark, sf_dir).terms.select("token", "rows")


@query("text_match_any_stored", _ANY_SQL)
def text_match_any_stored(spark, sf_dir):
    return textindex.stored_text_match(_index(spark, sf_dir), _benchmark(spark, sf_dir), "any", 20)


@query("text_match_all_stored", _ALL_SQL)
def text_match_all_stored(spark, sf_dir):
    return textindex.stored_text_match(_index(spark, sf_dir), _benchmark(spark, sf_dir), "all")


@query("phrase_match_stored", _PHRASE_SQL)
def phrase_match_stored(spark, sf_dir):
    return textindex.stored_phrase_match(_index(spark, sf_dir), _benchmark(spark, sf_dir))
