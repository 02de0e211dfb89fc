"""Numeric kernels and the operators that use them, against tabulated values and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.functions import numeric
from gaugeframe.operators import search, stats


@pytest.mark.parametrize(("t", "df", "p"), [(2.228139, 10, 0.05), (12.7062, 1, 0.05), (2.66028, 60, 0.01), (0.0, 5, 1.0), (63.6567, 1, 0.01)])
def test_t_tail(t, df, p):
    assert abs(numeric.t_two_sided(t, df) - p) < 2e-6


@pytest.mark.parametrize(("f", "d1", "d2", "p"), [(4.964603, 1, 10, 0.05), (3.708265, 3, 6, 0.0806), (19.0, 2, 2, 0.05), (2.866081, 4, 20, 0.05)])
def test_f_tail(f, d1, d2, p):
    assert abs(numeric.f_upper(f, d1, d2) - p) < 2e-4


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (3, 3), (2, 5), (5, 2), (6, 6), (4, 7)]:
        for _ in range(20):
            cost = rng.integers(0, 12, (n, m)).astype(float)
            got = numeric.assign(cost)
            assert len(got) == min(n, m) == len({i for i, _ in got}) == len({j for _, j in got})
            a = cost if n <= m else cost.T
            best = min(sum(a[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(a.shape[1]), a.shape[0]))
            assert math.isclose(sum(cost[i, j] for i, j in got), best)


def test_nonnegative_fit_meets_the_conditions():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, y = rng.normal(size=(12, 5)), rng.normal(size=12)
        w = numeric.nonnegative_fit(a, y)
        slope = a.T @ (y - a @ w)
        assert (w >= 0).all() and (slope <= 1e-7).all() and abs(slope @ w) < 1e-7


def test_logistic_fit_finds_its_curve():
    t = np.linspace(0, 20, 60)
    p, rss = numeric.fit_logistic4(t, numeric.logistic4(t, np.array([1.0, 4.0, 0.9, 8.0])))
    assert rss < 1e-8 and abs(p[3] - 8) < 1e-3


def test_curves_and_short_series(spark):
    t = np.arange(0, 20, 0.5)
    y = numeric.logistic4(t, np.array([0.0, 2.0, 1.1, 9.0]))
    rows = [("a", float(x), float(v)) for x, v in zip(t, y)] + [("b", 1.0, 2.0)] + [("c", float(x), 3.0) for x in t] + [("a", 3.0, None)]
    got = {r.k: r for r in stats.fit_curves(spark.createDataFrame(rows, "k string, t double, y double"), ["k"], "t", "y").collect()}
    assert set(got) == {"a", "c"} and abs(got["a"].middle - 9) < 1e-3 and got["a"].curve_rss < got["a"].line_rss


def test_permutation_sees_a_difference(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, i % 2 == 0, float(rng.normal() + (i % 3) + shift * (i % 2))) for shift in (1.5,) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, s long, a boolean, v double")
    r = stats.permutation(df, ["s"], F.col("a"), "v", 300).first()
    a, b = np.mean([x[3] for x in rows if x[2]]), np.mean([x[3] for x in rows if not x[2]])
    assert abs(r.observed - (a - b)) < 1e-9 and r.p < 0.01
    null = df.withColumn("v", F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0)
    assert stats.permutation(null, ["s"], F.col("a"), "v", 300).first().p > 0.02


def test_bootstrap_brackets_the_median(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, "g", float(v)) for i, v in enumerate(rng.normal(5, 1, 200))], "id long, g string, v double")
    r = stats.bootstrap_median(df, ["g"], "v", 200).first()
    assert 4.6 < r.low < 5.1 < r.high + 0.3 < 5.8


def test_greedy_bins_and_downsampling(spark):
    df = spark.createDataFrame([("g", i, w) for i, w in enumerate([3, 1, 5, 2, 2, 1])], "g string, i long, w long")
    assert [r.merged for r in stats.greedy_merge(df, ["g"], "i", "w", 4).orderBy("i").collect()] == [0, 0, 1, 2, 2, 2]
    x = spark.createDataFrame([(r, f, 10 * f) for r in range(5) for f in range(4)], "r long, f long, v long")
    got = stats.downsample_counts(x, "r", "f", "v", 30)
    assert {s.n for s in got.groupBy("r").agg(F.sum("v").alias("n")).collect()} == {30}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stats.downsample_counts(x.repartition(3), "r", "f", "v", 30).collect()))


def test_mixture_of_two(spark):
    refs = spark.createDataFrame([("p", f, float(f)) for f in range(6)] + [("q", f, float((f * f) % 5)) for f in range(6)], "k string, f long, v double")
    mix = spark.createDataFrame([("m", f, 0.6 * f + 0.2 * ((f * f) % 5)) for f in range(6)], "k string, f long, v double")
    got = {r.part: r for r in stats.mixtures(mix, "k", "f", "v", refs).collect()}
    assert abs(got["p"].weight - 0.75) < 1e-6 and abs(got["q"].weight - 0.25) < 1e-6 and got["p"].r2 > 1 - 1e-9


def test_matching_respects_the_reach(spark):
    one = spark.createDataFrame([("f", 1, 0.0), ("f", 2, 5.0), ("g", 3, 0.0)], "k string, id long, x double")
    two = spark.createDataFrame([("f", 7, 4.0), ("f", 8, 90.0), ("h", 9, 0.0)], "k string, id long, x double")
    assert [(r.a, r.b) for r in search.match(one, two, ["k"], "id", ["x"], 3.0).collect()] == [(2, 7)]


def test_beam_finds_the_best_pair(spark):
    worth = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", -1.0), ("d", 2.0)], "item string, w double")
    score = lambda panels: panels.join(worth, "item").groupBy("panel").agg((F.sum("w") - 0.9 * F.pow(F.count("w") - 2, F.lit(2))).alias("score"))
    assert search.beam(spark, ["a", "b", "c", "d"], score, 3, 5) == (("a", "b", "d"), pytest.approx(5.1))
