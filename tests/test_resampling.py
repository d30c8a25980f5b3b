"""Resamples drawn by blocks: every draw counted once, and intervals as plain resampling gives them."""

import random

import numpy as np
import pytest

from framescope.operators import evaluation


@pytest.mark.parametrize("sizes", [[7], [3, 3], [100, 1, 50, 0, 9], [65536] * 11])
def test_blocks_share_all_draws(sizes):
    parts = np.array([evaluation.block_draws(sizes, k, 200, 5) for k in range(len(sizes))])
    assert (parts.sum(axis=0) == sum(sizes)).all() and (parts >= 0).all() and (parts[np.array(sizes) == 0] == 0).all()
    for size, row in zip(sizes, parts):
        spread = (size * (1 - size / sum(sizes))) ** 0.5
        assert abs(row.mean() - size) <= 4 * spread / 200**0.5 + 1e-9 and (spread < 3 or 0.8 < row.std() / spread < 1.2)


def test_both_ways_of_drawing_agree():
    draws = np.full(4000, 300)
    many = evaluation.block_sums(np.arange(300.0), draws, [1])
    few = evaluation.block_sums(np.arange(300.0) % 2, draws, [1])
    assert abs(many.mean() - 300 * 149.5) < 4 * 86.6 * 300**0.5 / 4000**0.5 and 0.9 < many.std() / (86.6 * 300**0.5) < 1.1
    assert abs(few.mean() - 150) < 4 * 0.5 * 300**0.5 / 4000**0.5 and 0.9 < few.std() / (0.5 * 300**0.5) < 1.1
    assert evaluation.block_sums(np.array([3.0]), np.array([0, 2]), [1]).tolist() == [0.0, 6.0]


def test_intervals_are_those_of_plain_resampling(spark):
    rng = random.Random(4)
    rows = [("a", k, rng.gauss(0, 1)) for k in range(900)] + [("b", k, float(rng.random() < 0.3)) for k in range(500)] + [("b", 999, None), ("one", 1, 2.5), ("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    found = {r.g: r for r in evaluation.bootstrap_interval(df, ["g"], "v", "k", block_rows=64).collect()}
    again = {r.g: r for r in evaluation.bootstrap_interval(df.repartition(7), ["g"], "v", "k", block_rows=64).collect()}
    drawn = lambda x: {g: (r.n, r.low, r.high) for g, r in x.items()}
    assert drawn(found) == drawn(again) and set(found) == {"a", "b", "one"} and tuple(found["one"])[1:] == (1, 2.5, 2.5, 2.5)
    for g in "ab":
        values = np.array([v for h, _, v in rows if h == g and v is not None])
        means = np.sort(values[np.random.default_rng(1).integers(0, len(values), (20000, len(values)))].mean(axis=1))
        error = values.std() / len(values) ** 0.5
        assert found[g].n == len(values) and abs(found[g]["mean"] - values.mean()) < 1e-12
        assert abs(found[g].low - np.quantile(means, 0.025)) < 0.2 * error and abs(found[g].high - np.quantile(means, 0.975)) < 0.2 * error


def test_paired_intervals(spark):
    rows = [(g, k, "x" if k % 2 else "y", "x" if (k * f) % 7 < 4 else "y") for g, f in (("m1", 3), ("m2", 5), ("m3", 3)) for k in range(400)]
    out = {(r.left, r.right): r for r in evaluation.paired_intervals(spark.createDataFrame(rows, "g string, k long, label string, prediction string"), "g", "k", "label", "prediction").collect()}
    assert set(out) == {("m1", "m2"), ("m1", "m3"), ("m2", "m3")}
    assert tuple(out["m1", "m3"])[2:] == (400, 0.0, 0, 0, 0.0, 0.0, 1.0)
    r = out["m1", "m2"]
    assert r.low < r.difference < r.high and 0 < r.p <= 1 and r.only_left > 0 and r.only_right > 0
