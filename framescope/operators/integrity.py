"""Constraints as data: violations per row, quarantine with reasons, manifests against files, observation windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in the order given. A rule that can't be told (null) counts as broken."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())), lambda x: x.isNotNull())


def with_quarantine(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds quarantine_reasons and quarantined, which follow from the rules whatever the row claimed before."""
    return df.withColumn("quarantine_reasons", violations(rules)).withColumn("quarantined", F.size("quarantine_reasons") > 0)


def quarantine_totals(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per reason (a row counts for each of its reasons), beside the null reason for rows without any."""
    return df.select(*keys, F.explode_outer("quarantine_reasons").alias("reason")).groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def compare_manifest(listed: DataFrame, found: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """(keys, status): entries that are missing (listed only), unexpected (found only) or changed (digests differ); agreeing ones are left out."""
    a = listed.select(*keys, F.col(digest).alias("_l"), F.lit(True).alias("_in_l"))
    b = found.select(*keys, F.col(digest).alias("_f"), F.lit(True).alias("_in_f"))
    both = a.join(b, list(keys), "full_outer")
    status = F.when(F.col("_in_f").isNull(), "missing").when(F.col("_in_l").isNull(), "unexpected").when(~F.col("_l").eqNullSafe(F.col("_f")), "changed")
    return both.select(*keys, status.alias("status")).where("status is not null")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def window_faults(lines: DataFrame, keys: Sequence[str], order: str, wall: str, monotonic: str, end_wall: Column, end_monotonic: Column) -> DataFrame:
    """(keys, fault, n): receipts without a time, after either end of the window, or before the receipt that came first."""
    by = Window.partitionBy(*keys).orderBy(order)
    marked = lines.select(
        *keys,
        violations(
            {
                "receipt_missing": F.col(wall).isNotNull() & F.col(monotonic).isNotNull(),
                "after_wall_end": F.coalesce(F.col(wall) <= end_wall, F.lit(True)),
                "after_monotonic_end": F.coalesce(F.col(monotonic) <= end_monotonic, F.lit(True)),
                "goes_back": F.coalesce(F.col(monotonic) >= F.lag(monotonic).over(by), F.lit(True)),
            }
        ).alias("f"),
    )
    return marked.select(*keys, F.explode("f").alias("fault")).groupBy(*keys, "fault").agg(F.count("*").alias("n"))


#: Seconds, and a fraction of up to nine digits, at the head of a line (fixed value).
STAMP = r"^\s*(\d{9,})(?:\.(\d{1,9}))?(?=[:\s])"


def embedded_ns(text: Column) -> Column:
    """Nanoseconds of the time stamp that begins a line, exact; null if there is none. A stamp beyond the range of a long is the greatest long: it is
    after any end of a window, and ends no query."""
    seconds = F.regexp_extract(text, STAMP, 1)
    ns = F.try_add(F.try_multiply(seconds.try_cast("bigint"), F.lit(1_000_000_000).cast("bigint")), F.rpad(F.regexp_extract(text, STAMP, 2), 9, "0").cast("bigint"))
    return F.when(seconds != "", F.coalesce(ns, F.lit((1 << 63) - 1)))
