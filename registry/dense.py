"""Vector columns, exact search, inverted lists, codes and re-ranking.

Centroids and codebooks are given in most queries, as rounded label means of
the whole table, so that the search itself can be stated in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import (
    SCALED, VECTORS, as_queries, query, ranked_sql, scaled, table, vectors, workspace,
)
from vectable.functions import metrics
from vectable.operators import anisotropic, dense, ivf
from vectable.plans.auto import auto_search
from vectable.session import cut

K, NPROBE, REFINE, SUBS = 10, 3, 4, 8

SQL_SCORE = {
    "L2": "list_distance(a.v, b.v)",
    "COSINE": "list_cosine_similarity(a.v, b.v)",
    "IP": "list_dot_product(a.v, b.v)",
    "HAMMING": "bit_count(xor(a.w, b.w))::double",
    "JACCARD": "case when (a.w | b.w) = 0 then 1.0 else bit_count(a.w & b.w)::double / bit_count(a.w | b.w) end",
}

WORDS = """words as (
  select id, (case when w >= 9223372036854775808 then w - 18446744073709551616 else w end)::bigint as w
  from (select vec_id as id, sum(case when x > 0 then 1::hugeint << pos else 0::hugeint end) as w
        from (select vec_id, unnest(embedding) as x, (generate_subscripts(embedding, 1) - 1)::int as pos
              from embeddings) group by 1))"""


def _bits(spark, sf_dir):
    return vectors(spark, sf_dir).withColumn("vector", metrics.sign_bits("vector"))


def _is_bits(metric):
    return metric in ("HAMMING", "JACCARD")


# -- pairs, encodings --------------------------------------------------------


def _register_pairs(metric):
    source = WORDS if _is_bits(metric) else SCALED
    relation = "words" if _is_bits(metric) else "scaled"

    @query(
        f"score_pairs_{metric.lower()}",
        f"""with {source} select a.id, b.id as next_id, round({SQL_SCORE[metric]}, 6) as score
        from {relation} a join {relation} b on b.id = a.id + 1""",
    )
    def run(spark, sf_dir):
        """Each vector against the one of the next number."""
        rows = _bits(spark, sf_dir) if _is_bits(metric) else scaled(spark, sf_dir)
        rows = rows.select("id", "vector")
        following = rows.select(
            F.col("id").alias("next_id"), F.col("vector").alias("next_vector"),
            (F.col("id") - 1).alias("id"),
        )
        pairs = rows.join(following, "id")
        return dense.score_pairs(pairs, "vector", "next_vector", metric).select("id", "next_id", "score")


for _metric in SQL_SCORE:
    _register_pairs(_metric)


@query("binarize", f"with {WORDS} select id, 1 as words, w as word from words")
def binarize(spark, sf_dir):
    return _bits(spark, sf_dir).select(
        "id", F.size("vector").alias("words"), F.col("vector")[0].alias("word")
    )


# Round-half-even to eleven significant bits, and truncation to eight.
_HALF = "x_step * round_even(x / x_step, 0)"
_COARSE = "x_step * trunc(x / x_step)"
_ELEMENTS = """(select vec_id as id, unnest(embedding)::double as x,
  (generate_subscripts(embedding, 1) - 1)::int as pos from embeddings)"""


def _reduced_sql(kind):
    low, bits, value = (-14, 10, _HALF) if kind == "f16" else (-126, 7, _COARSE)
    return f"""select id, pos, x, {value} as y from (
      select id, pos, x, power(2.0::double, greatest(floor(log2(nullif(abs(x), 0))), {low}) - {bits}) as x_step
      from {_ELEMENTS})"""


def _register_precision(kind):
    @query(f"reduce_precision_{kind}", f"select id, pos, round(coalesce(y, 0), 9) as y from ({_reduced_sql(kind)})")
    def reduce(spark, sf_dir):
        rows = vectors(spark, sf_dir).select("id", metrics.reduced("vector", kind).alias("v"))
        return rows.select("id", F.posexplode_outer("v").alias("pos", "y")).select(
            "id", "pos", F.round(F.col("y").cast("double"), 9).alias("y")
        )

    @query(
        f"precision_report_{kind}",
        f"""select pos, round(max(abs(x - coalesce(y, 0))), 9) as max_error,
          round(avg(abs(x - coalesce(y, 0))), 9) as mean_error from ({_reduced_sql(kind)}) group by pos""",
    )
    def report(spark, sf_dir):
        return dense.precision_report(vectors(spark, sf_dir), "vector", kind)


for _kind in ("f16", "bf16"):
    _register_precision(_kind)


# -- exact search ------------------------------------------------------------


def _knn_sql(metric, where="true", both="true"):
    source = WORDS if _is_bits(metric) else SCALED
    relation = "words" if _is_bits(metric) else "scaled"
    pairs = f"""select a.id as query_id, b.id, round({SQL_SCORE[metric]}, 6) as score
      from {relation} a, {relation} b where {where} and {both}"""
    return f"with {source} " + ranked_sql(pairs, K, metric in ("L2", "HAMMING"))


def _register_knn(metric):
    @query(f"knn_{metric.lower()}", _knn_sql(metric))
    def run(spark, sf_dir):
        """Every vector against all vectors."""
        base = (_bits if _is_bits(metric) else scaled)(spark, sf_dir).select("id", "vector")
        return dense.knn(base, as_queries(base), K, metric)


for _metric in SQL_SCORE:
    _register_knn(_metric)


@query("knn_grid", _knn_sql("L2"))
def knn_grid(spark, sf_dir):
    """The form for query tables too large to ship to every task."""
    base = scaled(spark, sf_dir).select("id", "vector")
    return dense.knn(base, as_queries(base), K, "L2", broadcast_bytes=0)


@query("filtered_knn", _knn_sql("L2", "b.label in (1, 4, 6)"))
def filtered_knn(spark, sf_dir):
    base = scaled(spark, sf_dir)
    queries = as_queries(base).select("query_id", "vector")
    return dense.filtered_knn(base, queries, K, F.col("label").isin(1, 4, 6))


@query("partitioned_knn", _knn_sql("COSINE", both="a.label = b.label"))
def partitioned_knn(spark, sf_dir):
    base = scaled(spark, sf_dir)
    return dense.partitioned_knn(base, as_queries(base), K, "label", "COSINE")


@query("partitioned_knn_grid", _knn_sql("COSINE", both="a.label = b.label"))
def partitioned_knn_grid(spark, sf_dir):
    base = scaled(spark, sf_dir)
    return dense.partitioned_knn(base, as_queries(base), K, "label", "COSINE", broadcast_bytes=0)


@query("auto_search", _knn_sql("L2"))
def auto(spark, sf_dir):
    base = scaled(spark, sf_dir).select("id", "vector")
    return auto_search(base, as_queries(base), K)


# -- inverted lists ----------------------------------------------------------

CENTROIDS = """means as (
  select label as list_id, pos, round(avg(x), 6) as m from (
    select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings)
  group by 1, 2),
centroids as (select list_id, list(m order by pos) as c from means group by 1)"""

NEAREST = """near as (
  select v.id, c.list_id, row_number() over (
    partition by v.id order by round(list_distance(v.v, c.c), 6), c.list_id) as place
  from vectors v, centroids c),
lists as (select v.id, v.v, n.list_id from vectors v join near n on n.id = v.id and n.place = 1)"""


def label_means(spark, sf_dir):
    """(list_id, centroid): rounded mean vector of every label."""
    values = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = values.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    listed = means.groupBy(F.col("label").alias("list_id")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("l")
    )
    return listed.select("list_id", F.col("l.m").alias("centroid"))


def _probe_sql(relation, vector, k=K):
    return f"""select p.id as query_id, b.id, round(list_distance(p.v, b.{vector}), 6) as score
      from (select n.id, n.list_id, v.v from near n join vectors v on v.id = n.id where place <= {NPROBE}) p
      join {relation} b on b.list_id = p.list_id"""


_BASE_SQL = f"with {VECTORS}, {CENTROIDS}, {NEAREST}"


@query("assign_lists", f"{_BASE_SQL} select id, list_id from lists")
def assign_lists(spark, sf_dir):
    rows = ivf.assign_lists(vectors(spark, sf_dir), label_means(spark, sf_dir))
    return rows.select("id", "list_id")


def _lists(spark, sf_dir, metric="L2"):
    centroids = cut(label_means(spark, sf_dir))  # read for lists, probes and codebooks
    return ivf.assign_lists(vectors(spark, sf_dir).select("id", "vector"), centroids, metric), centroids


def _asked(spark, sf_dir):
    return as_queries(vectors(spark, sf_dir).select("id", "vector"))


@query("ivf_flat_search", f"{_BASE_SQL} {ranked_sql(_probe_sql('lists', 'v'), K)}")
def ivf_flat_search(spark, sf_dir):
    lists, centroids = _lists(spark, sf_dir)
    return ivf.ivf_search(lists, centroids, _asked(spark, sf_dir), K, NPROBE)


@query("ivf_flat_search_stored", f"{_BASE_SQL} {ranked_sql(_probe_sql('lists', 'v'), K)}")
def ivf_flat_search_stored(spark, sf_dir):
    """Lists written by list id first, then searched from storage."""
    lists, centroids = _lists(spark, sf_dir)
    path = workspace(spark, "lists")
    ivf.write_lists(lists, path)
    return ivf.ivf_search(spark.read.parquet(path), centroids, _asked(spark, sf_dir), K, NPROBE)


_SQ8 = f"""bounds as (select pos, min(x) as lo, max(x) as hi from {_ELEMENTS} group by 1),
codes as (
  select e.id, e.pos, b.lo, b.hi,
    greatest(0, least(255, floor((x - lo) / (case when hi > lo then hi - lo else 1.0::double end) * 255.0::double
      + 0.5::double)))::int as code
  from {_ELEMENTS} e join bounds b on b.pos = e.pos),
coded as (
  select l.id, l.list_id, d.y from lists l join (
    select id, list(lo + (code / 255.0::double) * (hi - lo) order by pos) as y from codes group by 1) d
  on d.id = l.id)"""


@query("sq8_encode", f"{_BASE_SQL}, {_SQ8} select id, pos, code from codes")
def sq8_encode(spark, sf_dir):
    base = vectors(spark, sf_dir).select("id", "vector")
    coded = ivf.sq8_encode(base, ivf.sq8_bounds(base))
    width = F.octet_length("code")
    at = coded.select("id", "code", F.explode(F.sequence(F.lit(0), width - 1)).alias("pos"))
    one = F.conv(F.hex(F.substring("code", F.col("pos") + 1, F.lit(1))), 16, 10).cast("int")
    return at.select("id", "pos", one.alias("code"))


@query("ivf_sq8_search", f"{_BASE_SQL}, {_SQ8} {ranked_sql(_probe_sql('coded', 'y'), K)}")
def ivf_sq8_search(spark, sf_dir):
    lists, centroids = _lists(spark, sf_dir)
    bounds = ivf.sq8_bounds(lists)
    coded = ivf.sq8_encode(lists, bounds)
    return ivf.ivf_sq8_search(coded, bounds, centroids, _asked(spark, sf_dir), K, NPROBE)


_WIDTH = 64 // SUBS
_PQ = f"""subs as (select unnest(range({SUBS})) as s),
pq_codes as (
  select id, s, code, word from (
    select v.id, s, c.list_id as code, list_slice(c.c, s * {_WIDTH} + 1, s * {_WIDTH} + {_WIDTH}) as word,
      row_number() over (partition by v.id, s order by round(list_distance(
        list_slice(v.v, s * {_WIDTH} + 1, s * {_WIDTH} + {_WIDTH}),
        list_slice(c.c, s * {_WIDTH} + 1, s * {_WIDTH} + {_WIDTH})), 6), c.list_id) as place
    from vectors v, subs, centroids c) where place = 1),
pq_coded as (
  select l.id, l.list_id, d.y from lists l join (
    select id, flatten(list(word order by s)) as y from pq_codes group by 1) d on d.id = l.id)"""


def _codebooks(centroids):
    """Slices of the label means: ten codewords per sub-vector."""
    subs = centroids.select("list_id", "centroid", F.explode(F.sequence(F.lit(0), F.lit(SUBS - 1))).alias("sub"))
    return subs.select(
        F.col("sub"), F.col("list_id").alias("code"),
        F.slice("centroid", F.col("sub") * _WIDTH + 1, F.lit(_WIDTH)).alias("centroid"),
    )


@query("pq_encode", f"{_BASE_SQL}, {_PQ} select id, string_agg(code::varchar, ',' order by s) as codes from pq_codes group by 1")
def pq_encode(spark, sf_dir):
    coded = ivf.pq_encode(vectors(spark, sf_dir).select("id", "vector"), _codebooks(label_means(spark, sf_dir)))
    one = [F.conv(F.hex(F.substring("code", i + 1, 1)), 16, 10) for i in range(SUBS)]
    return coded.select("id", F.concat_ws(",", *one).alias("codes"))


@query("ivf_pq_search", f"{_BASE_SQL}, {_PQ} {ranked_sql(_probe_sql('pq_coded', 'y'), K)}")
def ivf_pq_search(spark, sf_dir):
    lists, centroids = _lists(spark, sf_dir)
    codebooks = _codebooks(centroids)
    coded = ivf.pq_encode(lists, codebooks)
    return ivf.ivf_pq_search(coded, codebooks, centroids, _asked(spark, sf_dir), K, NPROBE)


_CODED_SCORE = {"COSINE": "list_cosine_similarity", "IP": "list_dot_product"}


def _register_coded(metric):
    """The coded list searches by another metric: lists are probed and rows scored by it."""
    score = _CODED_SCORE[metric]
    near = f"""asked as (select v.id, v.v, c.list_id, row_number() over (
      partition by v.id order by round({score}(v.v, c.c), 6) desc, c.list_id) as place from vectors v, centroids c)"""

    def sql(relation):
        pairs = f"""select p.id as query_id, b.id, round({score}(p.v, b.y), 6) as score
          from asked p join {relation} b on b.list_id = p.list_id where p.place <= {NPROBE}"""
        return ranked_sql(pairs, K, False)

    own = "lists as (select v.id, v.v, a.list_id from vectors v join asked a on a.id = v.id and a.place = 1)"
    base_sql = f"with {VECTORS}, {CENTROIDS}, {near}, {own}"

    @query(f"ivf_sq8_search_{metric.lower()}", f"{base_sql}, {_SQ8} {sql('coded')}")
    def sq8(spark, sf_dir):
        lists, centroids = _lists(spark, sf_dir, metric)
        bounds = ivf.sq8_bounds(lists)
        return ivf.ivf_sq8_search(ivf.sq8_encode(lists, bounds), bounds, centroids, _asked(spark, sf_dir), K, NPROBE, metric)

    @query(f"ivf_pq_search_{metric.lower()}", f"{base_sql}, {_PQ} {sql('pq_coded')}")
    def pq(spark, sf_dir):
        lists, centroids = _lists(spark, sf_dir, metric)
        codebooks = _codebooks(centroids)
        return ivf.ivf_pq_search(ivf.pq_encode(lists, codebooks), codebooks, centroids, _asked(spark, sf_dir), K, NPROBE, metric)


for _metric in _CODED_SCORE:
    _register_coded(_metric)


_RERANKED = f"""select r.query_id, r.id, round(list_distance(q.v, b.v), 6) as score
  from ({ranked_sql(_probe_sql('pq_coded', 'y'), K * REFINE)}) r
  join vectors q on q.id = r.query_id join vectors b on b.id = r.id"""


@query("scann_rerank_search", f"{_BASE_SQL}, {_PQ} {ranked_sql(_RERANKED, K)}")
def scann_rerank_search(spark, sf_dir):
    lists, centroids = _lists(spark, sf_dir)
    codebooks = _codebooks(centroids)
    coded = ivf.pq_encode(lists, codebooks)
    return ivf.rerank_search(
        coded, codebooks, centroids, _asked(spark, sf_dir), K, NPROBE, REFINE, raw=vectors(spark, sf_dir)
    )


# -- codes for inner products ------------------------------------------------


def _anisotropic_sql() -> str:
    """The codes sub-vector by sub-vector, in as many sweeps, each step one table."""
    extra = f"({anisotropic.along_weight(64)!r}::double - 1) / list_dot_product(v.v, v.v)"
    steps = ["""step0 as materialized (
  select p.id, list(p.code order by p.s) as codes, list(list_dot_product(x.x, x.x) - list_dot_product(x.x, p.word) order by p.s) as along
  from pq_codes p join parts x on x.id = p.id and x.s = p.s group by p.id)"""]
    for n in range(anisotropic.SWEEPS * SUBS):
        s = n % SUBS
        steps.append(f"""step{n + 1} as materialized (
  select id, list_transform(codes, lambda x, i: case when i = {s + 1} then code else x end) as codes,
         list_transform(along, lambda x, i: case when i = {s + 1} then a else x end) as along from (
    select *, row_number() over (partition by id order by
        round(error + extra * (list_sum(along) - along[{s + 1}] + a) * (list_sum(along) - along[{s + 1}] + a), {anisotropic.DIGITS}), code) as place
    from (select t.id, t.codes, t.along, w.code, {extra} as extra,
                 list_dot_product(x.x, x.x) - list_dot_product(x.x, w.word) as a,
                 list_dot_product(x.x, x.x) - 2 * list_dot_product(x.x, w.word) + list_dot_product(w.word, w.word) as error
          from step{n} t join parts x on x.id = t.id and x.s = {s} join vectors v on v.id = t.id join cells w on w.s = {s}))
  where place = 1)""")
    parts = f"""parts as materialized (
  select v.id, s, list_slice(v.v, s * {_WIDTH} + 1, s * {_WIDTH} + {_WIDTH}) as x from vectors v, subs),
cells as materialized (
  select s, list_id as code, list_slice(c, s * {_WIDTH} + 1, s * {_WIDTH} + {_WIDTH}) as word from centroids, subs)"""
    last = f"step{anisotropic.SWEEPS * SUBS}"
    coded = f"""weighed as (
  select l.id, l.list_id, d.y from lists l join (
    select id, flatten(list(word order by s)) as y from (
      select id, unnest(codes) as code, unnest(range({SUBS})) as s from {last}) join cells using (s, code) group by 1) d
  on d.id = l.id)"""
    return ", ".join([_PQ, parts, *steps, coded])


_WEIGHED = _anisotropic_sql()
_LAST_STEP = f"step{anisotropic.SWEEPS * SUBS}"


@query("anisotropic_encode", f"{_BASE_SQL}, {_WEIGHED} select id, array_to_string(codes, ',') as codes from {_LAST_STEP}")
def anisotropic_encode(spark, sf_dir):
    """Codes whose error along the vector weighs more, with given codebooks."""
    base = vectors(spark, sf_dir).select("id", "vector")
    coded = anisotropic.anisotropic_encode(base, _codebooks(label_means(spark, sf_dir)))
    one = [F.conv(F.hex(F.substring("code", i + 1, 1)), 16, 10) for i in range(SUBS)]
    return coded.select("id", F.concat_ws(",", *one).alias("codes"))


def _anisotropic_search_sql() -> str:
    score = "list_dot_product"
    asked = f"""asked as (select v.id, v.v, c.list_id, row_number() over (
      partition by v.id order by round({score}(v.v, c.c), 6) desc, c.list_id) as place from vectors v, centroids c)"""
    own = "lists as (select v.id, v.v, a.list_id from vectors v join asked a on a.id = v.id and a.place = 1)"
    pairs = f"""select p.id as query_id, b.id, round({score}(p.v, b.y), 6) as score
      from asked p join weighed b on b.list_id = p.list_id where p.place <= {NPROBE}"""
    again = f"""select r.query_id, r.id, round({score}(q.v, b.v), 6) as score
      from ({ranked_sql(pairs, K * REFINE, False)}) r join vectors q on q.id = r.query_id join vectors b on b.id = r.id"""
    return f"with {VECTORS}, {CENTROIDS}, {asked}, {own}, {_WEIGHED} {ranked_sql(again, K, False)}"


@query("anisotropic_search_ip", _anisotropic_search_sql())
def anisotropic_search_ip(spark, sf_dir):
    """Candidates by codes for inner products, then scored from the raw vectors."""
    lists, centroids = _lists(spark, sf_dir, "IP")
    codebooks = _codebooks(centroids)
    coded = anisotropic.anisotropic_encode(lists, codebooks)
    return ivf.rerank_search(
        coded, codebooks, centroids, _asked(spark, sf_dir), K, NPROBE, REFINE, raw=vectors(spark, sf_dir), metric="IP"
    )


@query(
    "recall_report",
    f"""{_BASE_SQL},
    found as ({ranked_sql(_probe_sql('lists', 'v'), K)}),
    truth as ({ranked_sql("select a.id as query_id, b.id, round(list_distance(a.v, b.v), 6) as score from vectors a, vectors b", K)})
    select count(*) as wanted, count(f.rank) as hits, round(count(f.rank)::double / count(*), 6) as recall,
      round(avg(abs(f.rank - t.rank)), 6) as displacement
    from truth t left join found f on f.query_id = t.query_id and f.id = t.id""",
)
def recall_report(spark, sf_dir):
    lists, centroids = _lists(spark, sf_dir)
    asked = _asked(spark, sf_dir)
    truth = dense.knn(lists.select("id", "vector"), asked, K, "L2")
    return dense.recall(ivf.ivf_search(lists, centroids, asked, K, NPROBE), truth, K)
