"""Shared pieces of the training-data operators: intermediate tables, text buffers, fresh column names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftgraph.functions.lineage import materialize as materialize

#: Text handled at once by a Python worker; what an operator holds besides is a small multiple of it.
SLICE_BYTES = 1 << 20

#: Rows that a Python worker gets at once where they hold whole texts or sets.
BATCH_ROWS = 1000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Batches of `rows` rows at most for what is written inside, so that neither side of a worker's pipe holds ten thousand sets at once."""
    before = spark.conf.get(_BATCHES)
    given = int(before)
    spark.conf.set(_BATCHES, str(rows if given <= 0 else min(rows, given)))
    try:
        yield
    finally:
        spark.conf.set(_BATCHES, before)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and the offsets of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, size: int = SLICE_BYTES, column: str = "text"):
    """Cut record batches so that each holds about `size` bytes of `column`, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k = batch.schema.get_field_index(column)
        _, offsets = utf8(batch.column(k))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
            end = max(start + 1, min(end, batch.num_rows))
            yield batch.slice(start, end - start)
            start = end
