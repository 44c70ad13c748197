"""Search by a named method, exact by default; suggestions by the size of the base table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vectable.operators import ivf
from vectable.operators.dense import knn

EXACT_ROWS = 1_000_000
LISTED_ROWS = 10_000_000


def suggested_nlist(rows: int) -> int:
    """Documented list counts by table size (upper ends of the ranges)."""
    if rows < 1_000_000:
        return 256
    return 1024 if rows <= 10_000_000 else 4096


def method_for(rows: int) -> str:
    """A suggestion for the caller: below a million rows exact search, then inverted lists, then codes with re-ranking."""
    if rows <= EXACT_ROWS:
        return "exact"
    return "lists" if rows <= LISTED_ROWS else "codes"


def auto_search(
    base: DataFrame, queries: DataFrame, k: int, metric: str = "L2", method: str = "exact",
    nlist: int | None = None, nprobe: int | None = None,
) -> DataFrame:
    """k nearest rows: exact at every size, unless ``method`` names "lists" or "codes".

    ``method_for`` suggests one; only the number of lists follows the size by itself.
    """
    if method == "exact":
        return knn(base, queries, k, metric)
    if method not in ("lists", "codes"):
        raise ValueError(f"unknown method {method!r}")
    nlist = nlist or suggested_nlist(base.count())
    nprobe = nprobe or max(1, nlist // 16)
    centroids = ivf.train_lists(base, nlist)
    lists = ivf.assign_lists(base, centroids, metric)
    if method == "lists":
        return ivf.ivf_search(lists, centroids, queries, k, nprobe, metric)
    codebooks = ivf.pq_train(base)
    coded = ivf.pq_encode(lists, codebooks)
    return ivf.rerank_search(coded, codebooks, centroids, queries, k, nprobe, raw=base, metric=metric)
