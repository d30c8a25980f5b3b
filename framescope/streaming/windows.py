"""Streaming forms of the fixed observation window and the step mask. Both take and return streaming DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.operators.summaries import step_mask


def observed_until(stream: DataFrame, at: str, end: str, late: str = "1 minute") -> DataFrame:
    """Rows at or before the end; later ones are dropped, and counted in the query's observed metrics (`window`: kept, dropped)."""
    inside = F.col(at) <= F.to_timestamp(F.lit(end))
    counted = stream.observe("window", F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped"))
    return counted.withWatermark(at, late).where(inside)


def stream_step_mask(stream: DataFrame, keys: Sequence[str], at: str, step: str, steps: Sequence[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """step_mask per key and tumbling window; state leaves with the watermark."""
    windowed = stream.withWatermark(at, late).withColumn("window", F.window(at, width))
    return step_mask(windowed, [*keys, "window"], step, steps)


def stamped(lines: DataFrame, receipt: str = "unix_ns") -> DataFrame:
    """Lines of a stream with the time at which their batch was taken in, in nanoseconds. One time for each micro-batch: a line is never stamped before it came."""
    return lines.withColumn(receipt, F.unix_micros(F.current_timestamp()) * 1000)
