"""Captures cut at the end of their observation window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trim_captures(records: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records to write, report): what each capture's records (path, frame, ts_ns, record, scan_error; frame 0 is the header) hold up to its end.

    ends: path, end_ns. A record stays if it was taken at the end or before; the header always does. report: path, frames, removed_frames, error. A
    capture that can't be read on, or has no end, is not written at all, and its error says why; its counts are null."""
    ended = records.join(ends.select("path", "end_ns"), "path", "left")
    inside = (F.col("frame") > 0) & (F.col("ts_ns") <= F.col("end_ns"))
    after = (F.col("frame") > 0) & (F.col("ts_ns") > F.col("end_ns"))
    counts = ended.groupBy("path").agg(F.count_if(inside).alias("frames"), F.count_if(after).alias("removed_frames"), F.max("scan_error").alias("bad"), F.max("end_ns").alias("end_ns"))
    error = F.coalesce(F.col("bad"), F.when(F.col("end_ns").isNull(), "no end"))
    report = counts.select("path", *(F.when(error.isNull(), F.col(c)).alias(c) for c in ("frames", "removed_frames")), error.alias("error"))
    whole = ended.where((F.col("frame") == 0) | inside).join(report.where("error is null").select("path"), "path", "left_semi")
    return whole.select("path", "frame", "record"), report
