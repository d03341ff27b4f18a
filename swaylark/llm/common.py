"""Helpers shared by the text operators: staged tables (from the core) and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import PATHS, Scope, remove, scratch, shared_folder, staged, unstage  # noqa: F401

BATCH_BYTES = 8 << 20
BATCH_ROWS = 4000
def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds by bytes, as texts differ in length by orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def body(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts."""
    return docs.select(F.sum(F.octet_length(F.coalesce(F.col(column), F.lit(""))).cast("long")).alias("n")).first()["n"] or 0


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def binaries(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column end to end, and its offsets from the first byte."""
    column = batch.column(batch.schema.get_field_index(name))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], (offsets - offsets[0]).astype(np.int64) if len(column) else np.zeros(1, np.int64)


def blocks(batch: pa.RecordBatch, name: str, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of the batch that hold about ``most`` bytes each; a longer single text has its own."""
    _, offsets = binaries(batch, name)
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(end, n)
        start = end


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)
