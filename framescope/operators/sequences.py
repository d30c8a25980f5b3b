"""Operators over ordered rows: budgets, echo scrubbing, line ranges, monotony, top rows of strata. All are window expressions over one sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where a text breaks into lines (fixed values): the line ends that str.splitlines knows.
LINE_BREAK = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"


def lines_of(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, line, content): the lines of each text, numbered from 1; a break at the very end starts no further line."""
    split = F.split(F.col(text), LINE_BREAK)
    whole = F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)
    return df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(whole).alias("_at", "content")).select(*keys, (F.col("_at") + 1).alias("line"), "content")


def line_range(df: DataFrame, keys: Sequence[str], text: str, first: int, last: int, most: int = 80) -> DataFrame:
    """Lines first to last of each text, with the number of all its lines. A range longer than `most` lines is an error."""
    if not 1 <= first <= last or last - first + 1 > most:
        raise ValueError(f"a range of 1 to {most} lines is needed")
    split = F.split(F.col(text), LINE_BREAK)
    whole = F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)
    rows = df.where(F.col(text).isNotNull()).select(*keys, whole.alias("_w"))
    part = rows.select(*keys, F.size("_w").alias("total_lines"), F.posexplode(F.slice("_w", first, last - first + 1)).alias("_at", "content"))
    return part.select(*keys, (F.col("_at") + first).alias("line"), "content", "total_lines")


def search_lines(df: DataFrame, keys: Sequence[str], text: str, pattern: str, most_pattern: int = 256) -> DataFrame:
    """Lines that match a pattern, whatever the case. The text is searched as a whole before it is cut, so most rows never are."""
    if not pattern or len(pattern) > most_pattern:
        raise ValueError(f"a pattern of 1 to {most_pattern} characters is needed")
    some = df.where(F.col(text).rlike(f"(?i){pattern}"))
    return lines_of(some, keys, text).where(F.col("content").rlike(f"(?i){pattern}"))


def bounded_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column, budget: int, most: int, start: int = 0) -> DataFrame:
    """The rows of each key that come before its budget is spent: running size + start at most budget, and at most `most` rows.

    Sizes are positive, so the first row over the budget is the last word."""
    by = Window.partitionBy(*keys).orderBy(*order)
    running = F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0)) + start
    return df.withColumns({"row": F.row_number().over(by), "used": running}).where((F.col("used") <= budget) & (F.col("row") <= most))


def head_tail(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column, budget: int, head_percent: int = 15) -> DataFrame:
    """Rows that a budget keeps of each key: whole rows from its front up to head_percent of the budget, then from its end with what is left.

    Adds `keep` (head, tail, none). A key that fits altogether is all head."""
    by = Window.partitionBy(*keys)
    up = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    down = by.orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    head_room = budget * head_percent // 100
    sized = df.withColumns({"_up": F.sum(size).over(up), "_down": F.sum(size).over(down), "_all": F.sum(size).over(by)})
    in_head = F.col("_up") <= head_room
    headed = sized.withColumn("_head", F.coalesce(F.max(F.when(in_head, F.col("_up"))).over(by), F.lit(0)))
    keep = F.when(F.col("_all") <= budget, "head").when(in_head, "head").when(F.col("_down") <= budget - F.col("_head"), "tail").otherwise("none")
    return headed.withColumn("keep", keep).drop("_up", "_down", "_all", "_head")


def scrub_echoes(df: DataFrame, keys: Sequence[str], order: Sequence[str], echo: Column, continuation: Column) -> DataFrame:
    """Adds `removed`: the row is an echo, or continues one (continuations follow the last row that is none)."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(echo | ~continuation, echo), ignorenulls=True).over(so_far)
    return df.withColumn("removed", F.coalesce(state, F.lit(False)))


def falls(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Per key: rows whose value is below the row's before, and the place (from 1) of the first such row (null if none)."""
    by = Window.partitionBy(*keys).orderBy(*order)
    marked = df.select(*keys, F.row_number().over(by).alias("_row"), (F.col(value) < F.lag(value).over(by)).alias("_fall"))
    return marked.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("_fall").alias("n_falls"), F.min(F.when(F.col("_fall"), F.col("_row"))).alias("first_fall"))


def stratified_top(df: DataFrame, strata: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """The first `most` rows of each stratum, with their rank."""
    by = Window.partitionBy(*strata).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
