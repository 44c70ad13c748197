"""Metrics through the list family, training from given starts, and vectors that do not fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import SCALED, VECTORS, as_queries, query, ranked_sql, scaled, vectors
from registry.dense import CENTROIDS, K, NPROBE, SQL_SCORE, SUBS, label_means
from vectable.operators import dense, ivf
from vectable.session import cut

_WIDTH = 64 // SUBS
_SCORES = {"COSINE": "list_cosine_similarity({0}, {1})", "IP": "list_dot_product({0}, {1})"}


def _metric_sql(metric: str) -> str:
    """Lists, probes and scores by one metric, over the scaled vectors."""
    score = _SCORES[metric]
    probed = f"""select p.id as query_id, b.id, round({score.format('p.v', 'b.v')}, 6) as score
      from (select n.id, n.list_id, v.v from near n join scaled v on v.id = n.id where place <= {NPROBE}) p
      join lists b on b.list_id = p.list_id"""
    return f"""with {SCALED}, {CENTROIDS},
    near as (
      select v.id, c.list_id, row_number() over (
        partition by v.id order by round({score.format('v.v', 'c.c')}, 6) desc, c.list_id) as place
      from scaled v, centroids c),
    lists as (select v.id, v.v, n.list_id from scaled v join near n on n.id = v.id and n.place = 1)
    {ranked_sql(probed, K, False)}"""


def _register_lists(metric: str) -> None:
    @query(f"ivf_flat_search_{metric.lower()}", _metric_sql(metric))
    def run(spark, sf_dir):
        centroids = label_means(spark, sf_dir)
        base = scaled(spark, sf_dir).select("id", "vector")
        lists = ivf.assign_lists(base, centroids, metric)
        return ivf.ivf_search(lists, centroids, as_queries(base), K, NPROBE, metric)


for _metric in _SCORES:
    _register_lists(_metric)


def _lloyd_sql(start: str, width: int, rounds: int = 2) -> str:
    """Rounds of k-means of the sub-vectors of ``width`` from words0 (s, code, c); the last is words<rounds>."""
    steps = [start]
    for n in range(rounds):
        steps.append(f"""won{n} as (
          select s, code, part from (
            select p.s, w.code, p.part, row_number() over (
              partition by p.id, p.s order by round(list_distance(p.part, w.c), 6), w.code) as place
            from (select v.id, s, list_slice(v.v, s * {width} + 1, s * {width} + {width}) as part
                  from vectors v, (select distinct s from words0)) p join words{n} w on w.s = p.s) where place = 1),
        means{n} as (
          select s, code, list(m order by pos) as c from (
            select s, code, pos, round(avg(x), 9) as m from (
              select s, code, unnest(part) as x, generate_subscripts(part, 1) as pos from won{n})
            group by 1, 2, 3) group by 1, 2),
        words{n + 1} as (
          select w.s, w.code, coalesce(m.c, w.c) as c from words{n} w left join means{n} m using (s, code))""")
    return ", ".join(steps)


_WHOLE_START = "words0 as (select 0 as s, row_number() over (order by list_id) - 1 as code, c from centroids)"
_PART_START = f"""words0 as (
  select s, row_number() over (partition by s order by list_id) - 1 as code,
    list_slice(c, s * {_WIDTH} + 1, s * {_WIDTH} + {_WIDTH}) as c
  from centroids, (select unnest(range({SUBS})) as s))"""


@query(
    "train_lists",
    f"""with {VECTORS}, {CENTROIDS}, {_lloyd_sql(_WHOLE_START, 64)}
    select code::int as list_id, (pos - 1)::int as pos, round(x, 6) as x from (
      select code, unnest(c) as x, generate_subscripts(c, 1) as pos from words2)""",
)
def train_lists(spark, sf_dir):
    """Centroids after two rounds from the label means."""
    centroids = ivf.train_lists(vectors(spark, sf_dir), iterations=2, start=label_means(spark, sf_dir))
    return centroids.select("list_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(
    "pq_train",
    f"""with {VECTORS}, {CENTROIDS}, {_lloyd_sql(_PART_START, _WIDTH)}
    select s::int as sub, code::int as code, (pos - 1)::int as pos, round(x, 6) as x from (
      select s, code, unnest(c) as x, generate_subscripts(c, 1) as pos from words2)""",
)
def pq_train(spark, sf_dir):
    """Codebooks after two rounds from slices of the label means."""
    base = vectors(spark, sf_dir).select("id", "vector")
    codebooks = ivf.pq_train(base, m=SUBS, iterations=2, start=label_means(spark, sf_dir))
    rows = codebooks.select("sub", "code", F.posexplode("centroid").alias("pos", "x"))
    return rows.withColumn("x", F.round("x", 6))


@query(
    "ivf_trained_recall",
    "select nprobe, (select count(*) from embeddings) as asked, true as enough from (values (12, true), (16, true)) t(nprobe, enough)",
)
def ivf_trained_recall(spark, sf_dir):
    """Whether trained lists reach a recall of 0.9 with three quarters of the probes, and find all with all."""
    base = vectors(spark, sf_dir).select("id", "vector")
    centroids = ivf.train_lists(base, nlist=16, seed=1, iterations=10)
    lists, asked = ivf.assign_lists(base, centroids), as_queries(base)
    truth = cut(dense.knn(base, asked, K, "L2"))  # compared twice
    some = dense.recall(ivf.ivf_search(lists, centroids, asked, K, 12), truth, K)
    every = dense.recall(ivf.ivf_search(lists, centroids, asked, K, 16), truth, K)
    rows = some.withColumn("nprobe", F.lit(12)).unionByName(every.withColumn("nprobe", F.lit(16)))
    bound = F.when(F.col("nprobe") == 16, 1.0).otherwise(0.9)
    counted = base.agg(F.count("*").alias("asked"))
    return counted.crossJoin(F.broadcast(rows.select("nprobe", (F.col("recall") >= bound).alias("enough"))))


def _register_bad_rows(metric: str) -> None:
    pairs = f"select a.id as query_id, b.id, round({SQL_SCORE[metric]}, 6) as score from scaled a, scaled b"

    @query(f"knn_with_bad_rows_{metric.lower()}", f"with {SCALED} {ranked_sql(pairs, K, metric == 'L2')}")
    def run(spark, sf_dir):
        """Some rows again with elements that are null or not finite, or with too few: none asks or answers."""
        base = scaled(spark, sf_dir).select("id", "vector")
        kind, rest = F.col("id") % 4, F.slice("vector", 2, 63)
        broken = (
            F.when(kind == 0, F.transform("vector", lambda x: F.lit(float("nan"))))
            .when(kind == 1, F.concat(F.array(F.lit(None).cast("double")), rest))
            .when(kind == 2, F.concat(F.array(F.lit(float("inf"))), rest))
            .otherwise(F.slice("vector", 1, 3))
        )
        bad = base.select((F.col("id") + 1_000_000).alias("id"), broken.alias("vector"))
        both = base.unionByName(bad.filter(F.col("id") % 40 < 4))
        return dense.knn(both, as_queries(both), K, metric)


for _metric in ("L2", "COSINE", "IP"):
    _register_bad_rows(_metric)
