"""Vector metrics and encodings as columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vectable.functions import topk


def _paired(a: pa.Array, b: pa.Array, metric: str) -> pa.Array:
    """Score two list columns; null for a null vector or unequal sizes."""
    bits = metric in ("HAMMING", "JACCARD")
    sizes_a, sizes_b = a.value_lengths(), b.value_lengths()
    sizes = sizes_a.fill_null(-1).to_numpy(zero_copy_only=False)
    fits = (sizes >= 0) & (sizes == sizes_b.fill_null(-2).to_numpy(zero_copy_only=False))
    out = np.full(len(a), np.nan)
    for size in np.unique(sizes[fits]):
        at = np.flatnonzero(fits & (sizes == size))
        if size == 0:
            continue
        picked = pa.array(at)
        out[at] = topk.pair_scores(
            topk.vectors(a.take(picked), bits), topk.vectors(b.take(picked), bits), metric
        )
    return pa.array(np.round(out, topk.DIGITS) + 0.0, from_pandas=True)


def score(a: Column | str, b: Column | str, metric: str) -> Column:
    """Rounded score of two vector columns; zero vectors have no cosine (null)."""
    topk.check_metric(metric)

    @F.arrow_udf("double")
    def scored(left: pa.Array, right: pa.Array) -> pa.Array:
        return _paired(left, right, metric)

    return scored(a, b)


def sign_bits(col: Column | str) -> Column:
    """Positive components as bits, 64 per long, component 0 in the lowest bit."""

    @F.arrow_udf("array<bigint>")
    def packed(column: pa.Array) -> pa.Array:
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        words = -(-sizes // 64)
        flat = column.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.cumsum(words)]
        within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        bits = np.zeros(int(starts[-1]) * 64, np.uint8)
        bits[np.repeat(starts[:-1] * 64, sizes) + within] = flat > 0
        values = np.packbits(bits, bitorder="little").view("<i8")
        missing = column.is_null().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(
            pa.array(starts, pa.int32()), pa.array(values), mask=pa.array(missing)
        )

    return packed(col)


def reduced(col: Column | str, kind: str) -> Column:
    """Vector rounded to half precision (f16) or truncated to bfloat16 (bf16)."""
    if kind not in ("f16", "bf16"):
        raise ValueError(f"unknown precision {kind!r}")

    @F.arrow_udf("array<float>")
    def rounded(column: pa.Array) -> pa.Array:
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        if kind == "f16":
            with np.errstate(over="ignore"):
                flat = flat.astype(np.float16).astype(np.float32)
        else:
            flat = (flat.view(np.uint32) & np.uint32(0xFFFF0000)).view(np.float32)
        missing = column.is_null().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(
            pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()),
            pa.array(flat),
            mask=pa.array(missing),
        )

    return rounded(col)
