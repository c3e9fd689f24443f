"""What several operators share: reading tables, and bounded views of text inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task looks at in one step; a longer text is a step of its own.
STEP_BYTES = 4 << 20

#: A key with over 1/HOT_SHARE of all rows is hot: there are fewer than HOT_SHARE of them, whatever the data, so they may be broadcast.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs run inside hand Python workers batches of about ``size`` bytes instead of the session's, on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of ``batch`` with at most ``limit`` bytes of ``column`` together, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every row; null is empty."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one array, and where each row starts (one more for the end)."""
    rows = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(rows.buffers()[1], np.int64, len(rows) + 1, rows.offset * 8)
    data = rows.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]
