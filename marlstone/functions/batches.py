"""Arrow batches between Spark and Python: how large they are, and memory given back after them."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = 4 << 20
"""Bytes of an Arrow batch; texts are long, and 10,000 of them in one batch take much memory on both sides."""


def bounded_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches have ``BATCH_BYTES`` at most; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trimmed(run: Run) -> Run:
    """The same function over batches, after which the worker gives its free memory back; workers live on between tasks."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return over
