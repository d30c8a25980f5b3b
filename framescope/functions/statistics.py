"""Exact small-sample statistics as column expressions: binomial tails, Clopper-Pearson intervals, McNemar's test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_choose(n: Column, k: Column) -> Column:
    """log of n over k, as a sum of logarithms over min(k, n - k) steps."""
    low = F.least(k, n - k)
    steps = F.when(low > 0, F.sequence(F.lit(1).cast("bigint"), low.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.log((n - low + i) / i))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for X binomial(n, p), 0 < p < 1, each term from the one before it."""
    first = F.exp(log_choose(n, k) + k * F.log(p) + (n - k) * F.log1p(-p))
    start = F.struct(F.lit(0.0).alias("sum"), first.alias("term"))
    steps = F.sequence(k.cast("bigint"), n.cast("bigint"))
    add = lambda acc, i: F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * ((n - i) / (i + 1)) * (p / (1 - p))).alias("term"))
    return F.when(k <= 0, F.lit(1.0)).otherwise(F.aggregate(steps, start, add, lambda acc: F.least(acc["sum"], F.lit(1.0))))


def clopper_pearson(k: Column, n: Column, alpha: float = 0.05, steps: int = 50) -> Column:
    """struct(low, high): the exact interval of a rate, by bisection on the binomial tails; null without trials."""
    half = alpha / 2
    rounds = F.sequence(F.lit(1), F.lit(steps))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))

    def bisect(above) -> Column:
        def step(acc: Column, _: Column) -> Column:
            mid = (acc["a"] + acc["b"]) / 2
            up = above(mid)
            return F.struct(F.when(up, acc["a"]).otherwise(mid).alias("a"), F.when(up, mid).otherwise(acc["b"]).alias("b"))

        return F.aggregate(rounds, start, step, lambda acc: (acc["a"] + acc["b"]) / 2)

    low = F.when(k == 0, F.lit(0.0)).otherwise(bisect(lambda p: binomial_tail(k, n, p) > half))
    high = F.when(k == n, F.lit(1.0)).otherwise(bisect(lambda p: 1 - binomial_tail(k + 1, n, p) < half))
    return F.when(n > 0, F.struct(low.alias("low"), high.alias("high")))


def mcnemar_exact(only_left: Column, only_right: Column) -> Column:
    """Two-sided exact p-value of discordant pairs: twice the binomial(n, 1/2) tail at the larger count, at most 1; 1 without any."""
    n = only_left + only_right
    tail = binomial_tail(F.greatest(only_left, only_right), n, F.lit(0.5))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))
