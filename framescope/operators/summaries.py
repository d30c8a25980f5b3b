"""Grouped statistics: histograms, entity summaries, step masks, first events, joint distributions, confusion counts, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """Rows per key that occurs, as `n`."""
    return (df if where is None else df.where(where)).groupBy(*keys).agg(F.count("*").alias("n"))


def entity_summary(df: DataFrame, key: str, order: Column, last: Column, last_where: Column, value: Column) -> DataFrame:
    """Per key: rows, the last value of `last`, the last one where last_where holds (else the last of all), value's count, least, greatest and mean.

    "Last" is by `order`, so the result doesn't depend on how rows are partitioned."""
    return df.groupBy(key).agg(
        F.count("*").alias("n"),
        F.max_by(last, order).alias("last_any"),
        F.coalesce(F.max_by(F.when(last_where, last), F.when(last_where, order)), F.max_by(last, order)).alias("last_preferred"),
        F.count(value).alias("n_values"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
        F.avg(value).alias("mean"),
        F.min(order).alias("first_order"),
    )


def step_mask(df: DataFrame, keys: Sequence[str], step: str, steps: Sequence[str]) -> DataFrame:
    """Per key: a bit for each of the ordered steps seen, how often each was, and whether all were (repeats count, order doesn't)."""
    bit = F.lit(0)
    for k, s in enumerate(steps):
        bit = F.when(F.col(step) == s, 1 << k).otherwise(bit)
    counts = [F.count_if(F.col(step) == s).alias(f"n_{s}") for s in steps]
    masked = df.where(F.col(step).isin(list(steps))).groupBy(*keys).agg(F.bit_or(bit).cast("int").alias("mask"), *counts)
    return masked.withColumn("complete", F.col("mask") == (1 << len(steps)) - 1)


def first_events(df: DataFrame, entity: str, kind: str, at: Column) -> DataFrame:
    """(entity, kind, elapsed): seconds from the entity's first row to its first row of each kind."""
    start = F.min(F.min(at)).over(Window.partitionBy(entity))
    firsts = df.groupBy(entity, kind).agg(F.min(at).alias("_first"), start.alias("_start"))
    return firsts.select(entity, kind, ((F.col("_first") - F.col("_start")) / 1e6).alias("elapsed"))


def spread_summary(df: DataFrame, keys: Sequence[str], value: str, available: DataFrame, entity: str) -> DataFrame:
    """Per key: n values, how many entities could have had one, least, median (interpolated) and greatest. available: one row per entity."""
    total = F.broadcast(available.agg(F.countDistinct(entity).alias("available")))  # one row
    found = quantiles(df, keys, value, {"median": 0.5}, F.min(value).alias("least"), F.max(value).alias("greatest"))
    return found.join(total, how="cross").select(*keys, "n", "least", "median", "greatest", "available")


def joint_distribution(df: DataFrame, columns: Sequence[str], missing: str = "unknown") -> DataFrame:
    """Rows per combination; nulls are the value `missing`."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in columns)).groupBy(*columns).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows per (label, prediction) that occurs."""
    return df.groupBy(label, prediction).agg(F.count("*").alias("n"))


def class_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per class that is a label or a prediction: support, predicted, hits, recall (null without support) and f1 (0 without either)."""
    marks = df.select(F.explode(F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("s"), F.lit(0).alias("p"), (F.col(label) == F.col(prediction)).cast("int").alias("h")), F.struct(F.col(prediction).alias("class"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("m"))
    found = marks.groupBy("m.class").agg(F.sum("m.s").alias("support"), F.sum("m.p").alias("predicted"), F.sum("m.h").alias("hits"))
    return found.withColumns({"recall": F.try_divide("hits", "support"), "f1": F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0))})


def majority(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key the most frequent value, the smallest among equals."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def standardised_means(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: mean of value, its population deviation over all rows of the key (1 if that is 0), and the mean's place among all keys' rows."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.nullif(F.stddev_pop(value), F.lit(0.0)), F.lit(1.0)).alias("deviation"))


def nullable_totals(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: rows, known values, their sum, and the total, which is null unless every row has a value."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count(value).alias("known"), F.sum(value).alias("known_sum"), F.when(F.count(value) == F.count("*"), F.sum(value)).alias("total"))


def counts_with_total(df: DataFrame, key: str) -> DataFrame:
    """Rows per key, and of all keys (key null, is_total true)."""
    return df.rollup(key).agg(F.count("*").alias("n"), (F.grouping(key) == 1).alias("is_total"))


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    """Whether two aliased rows agree on the keys; nulls are a value of their own."""
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], *more: Column, parts: int = 64) -> DataFrame:
    """Per key: n non-null values, their exact interpolated quantiles (null where n is 0), and the aggregates `more`; shares: column name -> share.

    A key may hold any share of the rows: equal values are counted together first, then cut at `parts` places of all values (a mergeable sketch; that many
    numbers reach the driver), so a part has about as few distinct values as any other; only the parts that hold a wanted place are sorted.
    """
    base = df.groupBy(*keys).agg(F.count(value).alias("n"), *more)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    cuts = sorted(set(df.agg(F.percentile_approx(F.col(value).cast("double"), [k / parts for k in range(1, parts)], 10 * parts)).first()[0] or []))
    part = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col("_v"))) if cuts else F.lit(0)
    counts = counts.withColumn("_part", part)
    own, run = Window.partitionBy(*(keys or [F.lit(1)])), Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_part")
    sizes = counts.groupBy(*keys, "_part").agg(F.sum("_c").alias("_k"))  # at most `parts` rows a key
    sizes = sizes.withColumns({"_n": F.sum("_k").over(own), "_before": F.sum("_k").over(run) - F.col("_k")})
    at = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in shares.items()}
    ends = {f"{name}_{end}": turn(x) for name, x in at.items() for end, turn in (("low", F.floor), ("high", F.ceil))}
    inside = lambda x, begin, size: (x >= begin) & (x < begin + size)
    holds = F.lit(False)
    for x in ends.values():
        holds |= inside(x, F.col("_before"), F.col("_k"))
    wanted = sizes.where(holds).alias("w")
    held = counts.alias("c").join(wanted, _same([*keys, "_part"], "c", "w")).select(*(F.col(f"c.{k}").alias(k) for k in keys), "c._part", "_v", "_c", "_n", "_before")
    ordered = held.withColumn("_from", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v")) - F.col("_c"))
    found = ordered.groupBy(*keys).agg(F.first("_n").alias("_n"), *(F.max(F.when(inside(x, F.col("_from"), F.col("_c")), F.col("_v"))).alias(name) for name, x in ends.items()))
    told = {}
    for name, x in at.items():
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        told[name] = F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)
    found = found.select(*keys, *(c.alias(name) for name, c in told.items())).alias("f")
    plain = [F.col(f"b.{c}").alias(c) for c in base.columns]
    return base.alias("b").join(found, _same(keys, "b", "f"), "left").select(*plain, *(F.col(f"f.{name}").alias(name) for name in shares))
