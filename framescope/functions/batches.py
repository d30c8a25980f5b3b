"""Arrow batches of bounded size for functions that run in Python."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of a record batch, where the session names no bounds of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless it has bounds: with the default of 10,000 rows, a task would hold tens of MB of texts several times over."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def give_back() -> None:
    """Returns what a worker has freed to the machine: workers outlive their tasks, and would hold their peaks while other stages run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow over bounded batches; the worker gives its memory back at the end of a task."""
    bound_batches(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)
