"""Helpers for work on Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that a task works on at once; a longer text is a slice of its own.
SLICE_BYTES = 750_000


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose values of ``column`` hold about ``most`` bytes (or array elements)."""
    if not batch.num_rows:
        return
    values = batch.column(column)
    length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    run = np.cumsum(pc.fill_null(length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16) // most
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def with_columns(
    df: DataFrame, source: str, made: dict[str, T.DataType], function: Callable[[pa.Array], list[pa.Array]]
) -> DataFrame:
    """``df`` with the columns ``made`` of column ``source``, in slices; columns of these names are replaced."""
    df = df.drop(*(name for name in made if name != source))
    kept = [f for f in df.schema.fields if f.name not in made]
    schema = T.StructType([*kept, *(T.StructField(name, kind) for name, kind in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(source)
            for part in slices(batch, at):
                columns = {f.name: part.column(part.schema.get_field_index(f.name)) for f in kept}
                yield pa.RecordBatch.from_pydict(columns | dict(zip(made, function(part.column(at)), strict=True)))

    return df.mapInArrow(run, schema)
