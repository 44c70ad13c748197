"""Headline timings: one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``.
Every query runs twice into the no-op sink; the second time counts. The first
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from registry import QUERIES
from registry.common import table, vectors
from registry.texts import N
from vectable.functions.text import shingles
from vectable.operators import dense, ivf, neardup
from vectable.session import cut, ship_package, spread

HEADLINES = [
    "knn_l2", "knn_cosine", "knn_hamming", "knn_grid", "filtered_knn", "partitioned_knn", "ivf_flat_search",
    "ivf_sq8_search", "ivf_pq_search", "scann_rerank_search", "knn_graph", "prune_graph",
    "conform_good", "assign_ids", "upsert_latest", "duplicate_keys", "table_diff", "write_then_pruned_read",
    "expire_new_york", "snapshot_session", "sparse_postings", "sparse_search", "sparse_search_pruned",
    "minhash", "lsh_candidates", "near_duplicates", "token_postings", "text_match_any", "text_match_all",
    "phrase_match", "where_equal", "where_range", "where_prefix", "facet_counts", "autocomplete",
    "value_bitmaps", "box_join", "anisotropic_search_ip", "ratio_prune", "text_match_any_stored", "phrase_match_stored",
    "within_box_stored", "first_within",
]


def baseline_runs(spark: SparkSession, sf_dir: str) -> dict:
    base = vectors(spark, sf_dir).select("id", "vector")
    asked = base.filter(F.col("id") < 200).withColumnRenamed("id", "query_id")
    centroids = cut(ivf.train_lists(base, 16, seed=1))
    lists = cut(ivf.assign_lists(base, centroids))
    texts = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    runs = {
        "baseline_knn_200_queries": lambda: dense.knn(base, asked, 10, "L2"),
        "baseline_kmeans_16": lambda: ivf.train_lists(base, 16, seed=1),
        "baseline_minhash_32": lambda: neardup.minhash(shingles(texts, "text", N), 32),
    }
    for nprobe in (1, 4, 8, 16):
        runs[f"baseline_ivf_nprobe_{nprobe}"] = lambda n=nprobe: ivf.ivf_search(lists, centroids, asked, 10, n)
    return runs


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("vectable-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    runs = baseline_runs(spark, sf_dir)
    runs |= {name: (lambda q=QUERIES[name]: q(spark, sf_dir)) for name in HEADLINES}
    times = {}
    for name, run in runs.items():
        for _ in range(2):
            at = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - at, 3)
    print(
        json.dumps(
            {
                "metric": "total_warm_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
