"""Repeated rows, pairs without a common row, and ranks taken range by range."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import matrix, series, space, stats


def test_equal_rows_are_shuffled_apart(spark):
    df = spark.createDataFrame([("s", True, 1.0)] * 5 + [("s", False, 0.0)] * 5, "s string, a boolean, v double")
    assert stats.permutation(df, ["s"], F.col("a"), "v", 400).first().p < 0.05
    rows = spark.createDataFrame([("g", float(v)) for v in [1, 1, 1, 2, 2, 2, 3, 3, 3]], "g string, v double")
    r = stats.bootstrap_median(rows, ["g"], "v", 200).first()
    assert r.low < 2 < r.high


def test_features_that_no_row_holds_together_correlate(spark):
    x = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0), (3, "c", 1.0), (4, "a", 1.0), (4, "b", 5.0)], "r int, f string, v double")
    rows = spark.createDataFrame([(i,) for i in range(1, 7)], "r int")
    dense = np.zeros((6, 3))
    for r in x.collect():
        dense[r.r - 1, "abc".index(r.f)] = r.v
    want = np.corrcoef(dense.T)
    got = {(r.a, r.b): r.r for r in matrix.feature_correlations(x, rows, "r", "f", "v").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert all(abs(got[p] - want["abc".index(p[0]), "abc".index(p[1])]) < 1e-9 for p in got)


def test_points_that_repeat_stay(spark):
    p = spark.createDataFrame([("g", 1, 0.0, 0.0), ("g", 1, 0.0, 0.0), ("g", 2, 50.0, 0.0), ("g", 3, None, 1.0)], "g string, id int, x double, y double")
    m = spark.createDataFrame([("g", 3.0, 4.0)], "g string, x double, y double")
    got = sorted(((r.id, r.distance) for r in space.near_distance(p, m, ["g"], "x", "y", 5.0).collect()), key=repr)
    assert got == [(1, 5.0), (1, 5.0), (2, None), (3, None)]


@pytest.mark.parametrize("small", [0, 100_000])
def test_ranks_by_ranges_are_plain_ranks(spark, monkeypatch, small):
    monkeypatch.setattr(stats, "SMALL", small)
    monkeypatch.setattr(series, "SMALL", small)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 900), "i": range(900), "v": np.round(rng.exponential(1, 900), 1)})
    pdf.loc[pdf.g == "a", "v"] = np.where(rng.random((pdf.g == "a").sum()) < 0.4, 0.5, pdf.v[pdf.g == "a"])  # one very common value
    df = spark.createDataFrame(pdf)
    got = {r.i: r.k for r in stats.mid_ranks(df, ["g"], "v", "k").collect()}
    want = pdf.groupby("g", dropna=False).v.rank()
    assert all(got[i] == want[i] for i in range(900))
    share = {r.i: r.share for r in series.ecdf(df, ["g"], "v").collect()}
    upper = pdf.groupby("g", dropna=False).v.rank(method="max", pct=True)
    assert all(abs(share[i] - upper[i]) < 1e-12 for i in range(900))
    p = df.withColumn("p", F.when(F.col("i") % 10 > 0, F.col("v") / 50))
    q = {r.i: (r.q, h.q) for r, h in zip(stats.benjamini_hochberg(p, ["g"], "p", "i").orderBy("i").collect(), stats.holm(p, ["g"], "p", "i").orderBy("i").collect())}
    for _, own in pdf.assign(p=np.where(pdf.i % 10 > 0, pdf.v / 50, np.nan)).groupby("g", dropna=False):
        x = own.dropna(subset="p").sort_values(["p", "i"])
        n = len(x)
        bh = np.minimum(np.minimum.accumulate((x.p.to_numpy() * n / np.arange(1, n + 1))[::-1])[::-1], 1)
        step = np.minimum(np.maximum.accumulate((n - np.arange(n)) * x.p.to_numpy()), 1)
        assert all(abs(q[i][0] - b) < 1e-12 and abs(q[i][1] - s) < 1e-12 for i, b, s in zip(x.i, bh, step))
    assert all(q[i] == (None, None) for i in range(0, 900, 10))


@pytest.mark.parametrize("small", [0, 100_000])
def test_plans_read_their_input_twice_at_most(spark, monkeypatch, small, sf):
    monkeypatch.setattr(stats, "SMALL", small)
    monkeypatch.setattr(series, "SMALL", small)
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    plans = [
        stats.exact_quantile(li, ["l_suppkey"], "l_quantity", 0.5, "m"), stats.mid_ranks(li, ["l_suppkey"], "l_quantity", "k"), stats.rank_sum(li, ["l_suppkey"], F.col("l_linenumber") == 1, "l_quantity"),
        series.ecdf(li, ["l_suppkey"], "l_quantity"), matrix.nested_median(li, ["l_suppkey", "l_returnflag"], ["l_suppkey"], "l_quantity", 2), matrix.robust_sigma(li, ["l_suppkey"], "l_quantity", 0.1),
    ]
    for df in plans:
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("lineitem.parquet") <= 2, plan
