"""Shared by the operators of this package: inputs, tables written to shared storage, Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stopwise.session import scratch_dir

# Bytes of text that a Python task works on at once: the arrays made of them are about 30 times that.
PIECE = 2 << 20
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, whatever else the table carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder of ``spark.checkpoint.dir`` and read back: evaluated once, lineage cut.

    While it is written, Python tasks get their rows in batches of ``BATCH_BYTES``: both sides hold a batch.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    before = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH_SETTING, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def release(*done: DataFrame) -> None:
    """Delete what :func:`staged` wrote for tables that nothing reads any more."""
    for df in done:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def row_key() -> Column:
    """Id and text of a row in one: rows that agree in both are one document."""
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64(F.col("text").cast("string")).cast("string"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if column.offset or column.buffers()[2] is None:
        column = pa.concat_arrays([column, pa.array([""], pa.large_string())]).slice(0, len(column))
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[: len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[: offsets[-1]], offsets


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes, as rows of bytes."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    first = np.frombuffer(ends, np.int64)[column.offset] if len(column) else 0
    raw = np.frombuffer(data, np.uint8) if data is not None and len(column) else np.empty(0, np.uint8)
    return raw[first : first + width * len(column)].reshape(-1, width)


def binary(rows: np.ndarray) -> pa.Array:
    """The reverse of :func:`fixed`."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])
