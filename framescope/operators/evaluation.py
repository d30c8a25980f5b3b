"""Evaluation rows to metrics: rates per group, bootstrap intervals, and the contamination probe."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescope.functions.statistics import mcnemar_exact
from framescope.operators.bundles import paired_differences, paired_groups
from framescope.operators.relations import first_reason
from framescope.operators.summaries import class_scores, majority, quantiles


def exclusion_reason() -> F.Column:
    """Why an evaluation row doesn't count: its stated reason, else an outcome that never came to an answer; null if it counts."""
    stated = F.when(F.col("excluded"), F.coalesce(F.nullif("exclusion_reason", F.lit("")), F.lit("excluded")))
    return F.coalesce(stated, first_reason([(x, F.col("outcome") == x) for x in ("TRUNCATED", "CONTEXT_REJECTED")]))


def group_metrics(rows: DataFrame, classes: int, group: str = "group") -> DataFrame:
    """Per group: rows, evaluated rows, accuracy and rates over evaluated rows; error rate, latency quantiles and cost over all rows.

    rows: group, label, prediction, schema_failure, error, excluded, exclusion_reason, outcome, latency_ms, cost. The cost's total is null unless all
    rows have one. macro_f1 divides by the fixed number of classes, so absent ones count as 0.
    """
    marked = rows.withColumn("_why", exclusion_reason())
    ok = F.col("_why").isNull()
    rate = lambda x: F.try_divide(F.count_if(ok & x), F.count_if(ok))
    told = [
        F.count("*").alias("rows"),
        F.count_if(ok).alias("evaluated"),
        rate(F.col("label") == F.col("prediction")).alias("accuracy"),
        rate(F.col("prediction") == "unknown").alias("unknown_rate"),
        rate(F.col("schema_failure")).alias("schema_failure_rate"),
        F.try_divide(F.count_if(F.col("error").isNotNull()), F.count("*")).alias("execution_error_rate"),
        F.sum("cost").alias("known_cost"),
        F.when(F.count("cost") == F.count("*"), F.sum("cost")).alias("cost"),
    ]
    plain = quantiles(marked, [group], "latency_ms", {"latency_p50": 0.5, "latency_p95": 0.95}, *told).drop("n").withColumnRenamed("rows", "n")
    scored = marked.where(ok).select(F.struct(group, "label").alias("l"), F.struct(F.col(group), F.col("prediction").alias("label")).alias("p"))
    f1 = class_scores(scored, "l", "p").where(F.col("class.label") != "unknown").groupBy(F.col(f"class.{group}").alias(group)).agg((F.sum("f1") / classes).alias("macro_f1"))
    return plain.join(f1, group, "left")


#: Rows of a block that a resample's draws are split over, and distinct values up to which a block draws counts of values in place of rows.
BLOCK_ROWS, FEW_VALUES = 65_536, 256


def block_draws(sizes: Sequence[int], block: int, resamples: int, seed: int) -> np.ndarray:
    """How many of each resample's draws, one for each row of all blocks, fall into one block.

    A multinomial split down a binary tree of blocks: each half's share of its parent's draws is binomial, drawn from a generator that the half's place
    seeds. So every block finds its own counts alone, and they add up to the rows for each resample."""
    draws, low, high = np.full(resamples, sum(sizes)), 0, len(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        first = np.random.default_rng([seed, low, high]).binomial(draws, sum(sizes[low:middle]) / max(1, sum(sizes[low:high])))
        draws, low, high = (first, low, middle) if block < middle else (draws - first, middle, high)
    return draws


def block_sums(values: np.ndarray, draws: np.ndarray, seed: Sequence[int]) -> np.ndarray:
    """For each resample, the sum of so many draws with replacement from a block's values."""
    rng = np.random.default_rng(seed)
    told, counts = np.unique(values, return_counts=True)
    if told.size <= FEW_VALUES:
        return rng.multinomial(draws, counts / counts.sum()) @ told
    return np.array([values[rng.integers(0, values.size, n)].sum() for n in draws.tolist()])


def bootstrap_interval(rows: DataFrame, keys: list[str], value: str, order: str, resamples: int = 2000, seed: int = 20260926, level: float = 0.95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per key: n, mean, and the percentile interval of the means of resamples with replacement.

    Rows are dealt into blocks by a hash of `order` (unique in a key), and each block makes its own part of every resample (block_draws), so a group may
    be of any size, no row is repeated, and what is shuffled after the blocks are one partial sum for each block and resample. Null values don't count. The draws
    depend on seed, order and values alone."""
    few = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.col(order).alias("_o"))
    counts = few.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).alias("_n"))
    dealt = (few.join(counts, keys) if keys else few.join(F.broadcast(counts), how="cross")).select(*keys, "_v", "_o", F.pmod(F.xxhash64("_o"), F.col("_n")).cast("int").alias("_b"))  # one row, where there are no keys
    held = dealt.groupBy(*keys, "_b").agg(F.count("*").alias("_c")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", "_c"))).alias("_held"))  # a few bytes for each block
    sizes = held.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), F.posexplode("_held").alias("_at", "_one"), F.col("_held._c").alias("_sizes")).withColumn("_k", F.col("_one._b"))

    def run(block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        at, held = int(told["_at"].iloc[0]), [int(x) for x in told["_sizes"].iloc[0]]
        values = block.sort_values(["_o", "_v"])["_v"].to_numpy()
        sums = block_sums(values, block_draws(held, at, resamples, seed), [seed, at])
        return pd.DataFrame({**{k: block[k].iloc[:1].to_numpy() for k in keys}, "_sums": [sums.astype(float)]})

    types = ", ".join([*(f"`{k}` {few.schema[k].dataType.simpleString()}" for k in keys), "_sums array<double>"])
    parts = dealt.groupBy(*keys, "_b").cogroup(sizes.groupBy(*(f"_{i}" for i in range(len(keys))), "_k")).applyInPandas(run, types)
    sums = parts.select(*keys, F.posexplode("_sums").alias("_r", "_s")).groupBy(*keys, "_r").agg(F.sum("_s").alias("_s"))
    low, high = (1 - level) / 2, (1 + level) / 2
    limits = sums.groupBy(*keys).agg(F.expr(f"percentile(_s, {low})").alias("low"), F.expr(f"percentile(_s, {high})").alias("high"))
    plain = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    both = plain.join(limits, keys) if keys else plain.join(limits)
    return both.withColumns({c: F.col(c) / F.col("n") for c in ("low", "high")})


def paired_intervals(rows: DataFrame, group: str, key: str, label: str, prediction: str, resamples: int = 2000) -> DataFrame:
    """paired_groups of every two groups with the interval of their difference (low, high) and the exact two-sided p of their discordant pairs."""
    pairs = paired_groups(rows, group, key, label, prediction)
    limits = bootstrap_interval(paired_differences(rows, group, key, label, prediction), ["left", "right"], "difference", key, resamples)
    return pairs.join(limits.select("left", "right", "low", "high"), ["left", "right"]).withColumn("p", mcnemar_exact(F.col("only_left"), F.col("only_right")))


def leak_probe(df: DataFrame, id_col: str, vector: str, label: str, dev: F.Column, seed: int = 9173) -> DataFrame:
    """One row: n, hits, shuffled_hits, base_hits, flagged. Means, deviations, centroids and the commonest label come from dev rows only; the rows for
    which dev is false are graded, and n counts them.

    Each dimension is scaled by dev's mean and population deviation (1 if that is 0). shuffled_hits is the control: centroids of dev rows whose labels
    are permuted among them by the order of the MD5 digest of seed and id, a permutation of its own and not Python's. Ids must differ. Rows with a null id, label or
    vector do not count. flagged is null without dev rows or without graded ones. The permutation meets the rows by rank, counted within 256 ranges of the digest.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(label).alias("_l"), F.col(vector).alias("_v"), dev.alias("_dev")).dropna()
    fit, test = rows.where("_dev"), rows.where(~F.col("_dev"))
    ranked = lambda salt: _ranks(fit.select("_id", "_l"), F.md5(F.concat(F.lit(f"{seed}:{salt}:"), F.col("_id").cast("string"))))
    lots = ranked("row").select("_id", "_rank").join(ranked("label").select("_rank", F.col("_l").alias("_s")), "_rank").select("_id", "_s")
    parts = lambda x, *more: x.select("_id", *more, F.posexplode("_v").alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    scales = parts(fit).groupBy("d").agg(F.avg("x").alias("mean"), F.coalesce(F.nullif(F.stddev_pop("x"), F.lit(0.0)), F.lit(1.0)).alias("deviation"))
    scaled = lambda x: x.join(scales, "d").withColumn("x", (F.col("x") - F.col("mean")) / F.col("deviation")).drop("mean", "deviation")
    fitted = scaled(parts(fit, "_l")).join(lots, "_id")
    said = F.explode(F.array(F.struct(F.lit("own").alias("kind"), F.col("_l").alias("p")), F.struct(F.lit("shuffled").alias("kind"), F.col("_s").alias("p"))))
    centres = fitted.select("d", "x", said.alias("c")).groupBy("c.kind", "c.p", "d").agg(F.avg("x").alias("m"))
    near = scaled(parts(test, "_l")).join(centres, "d").groupBy("_id", "_l", "kind", "p").agg(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))).alias("dist"))
    told = near.groupBy("_id", "_l", "kind").agg(F.min_by("p", F.struct(F.round("dist", 9), F.col("p"))).alias("p"))
    hits = told.agg(*(F.count_if((F.col("kind") == kind) & (F.col("_l") == F.col("p"))).alias(name) for kind, name in (("own", "hits"), ("shuffled", "shuffled_hits"))))
    top = majority(fit.select(F.lit(1).alias("_one"), "_l"), ["_one"], "_l").agg(F.first("_l").alias("_top"))
    base = test.join(F.broadcast(top), how="cross").agg(F.count("*").alias("n"), F.count_if(F.col("_l") == F.col("_top")).alias("base_hits"), F.first("_top").alias("_top"))
    flagged = F.when((F.col("n") > 0) & F.col("_top").isNotNull(), (F.col("hits") - F.col("base_hits")) * 5 > F.col("n"))
    return base.join(F.broadcast(hits), how="cross").select("n", "hits", "shuffled_hits", "base_hits", flagged.alias("flagged"))


def _ranks(rows: DataFrame, order: F.Column) -> DataFrame:
    """rows with their rank by order and id, from 1; order is a digest in hex: ranks within ranges of the order, plus the sizes of the ranges before."""
    marked = rows.withColumn("_o", order).withColumn("_part", F.substring("_o", 1, 2))
    before = marked.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # 256 rows
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_o", "_id"))
    return marked.withColumn("_within", within).join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + F.col("_within")).alias("_rank"))
