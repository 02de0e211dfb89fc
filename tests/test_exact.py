"""Exact statistics and resampling against enumeration and closed values."""

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import exact, filters, stats


def brute_p(rows, shift=0.0):
    """All assignments within strata, one by one; strata differences are weighted by their sizes."""
    moved = [(s, a, v - shift * a) for s, a, v in rows]
    strata = [s for s in sorted({s for s, _, _ in moved}) if len({a for t, a, _ in moved if t == s}) == 2]
    total = sum(s in strata for s, _, _ in moved)

    def difference(chosen):
        out = 0.0
        for s in strata:
            own = [i for i, r in enumerate(moved) if r[0] == s]
            x, y = ([moved[i][2] for i in own if (i in chosen) == side] for side in (True, False))
            out += len(own) / total * (np.mean(x) - np.mean(y))
        return out

    seen = abs(difference({i for i, (_, a, _) in enumerate(moved) if a}))
    ways = [set()]
    for s in strata:
        own = [i for i, r in enumerate(moved) if r[0] == s]
        k = sum(moved[i][1] for i in own)
        ways = [w | set(c) for w in ways for c in combinations(own, k)]
    return np.mean([abs(difference(w)) >= seen - 1e-9 for w in ways])


@pytest.mark.parametrize("most", [exact.MOST, 5])
def test_exact_permutation(spark, most):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(6):
        for s in "xyz"[: 1 + g % 3]:
            rows += [(g, s, bool(a), float(np.round(rng.normal(2.0 * a * (g > 2), 1), 1))) for a in rng.random(5) < 0.5]
    rows += [(7, "x", True, 1.0), (7, "y", False, 2.0), (8, "x", True, 1.0), (9, "x", True, None)] + [(10, "x", i % 2 == 0, float(i)) for i in range(60)]
    rows += [(None, s, a, v) for g, s, a, v in rows if g == 5]
    df = spark.createDataFrame(rows, "g int, s string, a boolean, v double")
    got = {r.g: r for r in exact.exact_permutation(df, ["g"], "s", F.col("a"), "v", most=most, steps=18 if most > 5 else 6).collect()}
    for g in [*range(6), None]:
        own = [(s, a, v) for k, s, a, v in rows if k == g]
        if all(len({a for t, a, _ in own if t == s}) < 2 for s, _, _ in own):
            assert g not in got
            continue
        assert got[g].p == pytest.approx(brute_p(own))
        for end in (got[g].low, got[g].high):
            if end is not None:  # P crosses the level there
                near = (1e-3 if most > 5 else 0.5) * max(1.0, abs(end))
                inner, outer = sorted((end - near, end + near), key=lambda x: abs(x - got[g].difference))
                assert brute_p(own, outer) < 0.05 <= brute_p(own, inner)
    assert not {7, 8, 9} & set(got)
    assert got[10].p is None and got[10].na == 30  # too many for sums of either side


def test_groups_of_a_shape_are_enumerated_together():
    rng = np.random.default_rng(9)
    shapes = [(("x", 3, 1), ("y", 4, 2)), (("x", 6, 3),), (("x", 3, 1), ("y", 4, 2))] * 40
    groups = [[(s, i >= n - k, float(v)) for s, n, k in shape for i, v in enumerate(np.round(rng.normal(0, 3, n), 1))] for shape in shapes]
    groups[2][0] = ("x", False, float("nan"))
    offsets = np.cumsum([0, *map(len, groups)])
    strata, sides, v = (list(c) for c in zip(*(r for g in groups for r in g)))
    found = list(exact._by_shape(pa.array(strata), np.array(sides), offsets))
    assert sorted((len(g), *n, *k) for g, n, k in found) == [(40, 6, 3), (80, 3, 4, 1, 2)]
    for at, n, k in found:
        every = exact._Assignments(n, k, np.array(v)[offsets[at][:, None] + np.arange(n.sum())])
        p, ends = every.share_as_far(np.zeros(len(at))), every.limits(0.3, 18)
        for i, g in enumerate(at.tolist()):
            if g == 2:  # nothing is nearer than what isn't a number
                assert p[i] == 1 and np.isnan(ends[:, i]).all()
                continue
            alone = exact.Relabelled(*zip(*groups[g]))
            assert (every.seen[i], every.middle[i], every.span[i]) == pytest.approx((alone.seen, alone.middle, alone.span))
            assert p[i] == pytest.approx(brute_p(groups[g]))
            for end in ends[~np.isnan(ends[:, i]), i]:
                inner, outer = sorted((end - 1e-3, end + 1e-3), key=lambda x: abs(x - alone.seen))
                assert brute_p(groups[g], outer) < 0.3 <= brute_p(groups[g], inner)
    batches = [pa.record_batch({"x": pa.array([[1, 2]] * n)}) for n in (3, 1, 2, 1)]
    assert [len(b) for b in exact._gathered(iter(batches), "x", 8)] == [4, 3]


def test_exact_permutation_of_175_thousand_million_ways(spark):
    rng = np.random.default_rng(8)
    sizes = (("x", 22, 9), ("y", 21, 10))
    rows = [(s, i < k, float(np.round(rng.normal(0.55 * (i < k), 1), 3))) for s, n, k in sizes for i in range(n)]

    def subset_sums(v, k):
        sums, count = np.zeros(1), np.zeros(1, int)
        for x in v:
            sums, count = np.concatenate([sums, sums + x]), np.concatenate([count, count + 1])
        return sums[count == k]

    def p(shift):
        parts, seen = [], 0.0
        for s, n, k in sizes:
            v = np.array([x - shift * a for t, a, x in rows if t == s])
            d = lambda a: n / 43 * (a / k - (v.sum() - a) / (n - k))  # noqa: B023, E731
            seen += d(v[:k].sum())
            parts.append(d(subset_sums(v, k)))
        x, y = np.sort(parts[0]), parts[1]
        far = abs(seen) - 1e-9
        return ((len(x) - np.searchsorted(x, far - y)).sum() + np.searchsorted(x, -far - y, "right").sum()) / (len(x) * len(y)), seen

    got = exact.exact_permutation(spark.createDataFrame(rows, "s string, a boolean, v double"), [], "s", F.col("a"), "v", steps=2).collect()[0]
    want, seen = p(0.0)
    assert (got.na, got.nb) == (19, 24)
    assert got.difference == pytest.approx(seen) and got.p == pytest.approx(want, rel=1e-9)
    span = max(r[2] for r in rows) - min(r[2] for r in rows)
    for end, side in ((got.low, -1), (got.high, 1)):
        inside, outside = seen, seen + side * 3 * span
        for _ in range(2):
            at = (inside + outside) / 2
            inside, outside = (at, outside) if p(at)[0] >= 0.05 else (inside, at)
        assert end == pytest.approx((inside + outside) / 2)


def test_exact_u(spark):
    def brute(u, na, nb):
        every = [sum(x > y for x in c for y in set(range(na + nb)) - set(c)) for c in combinations(range(na + nb), na)]
        low = min(u, na * nb - u)
        return min(1.0, 2 * np.mean([e <= low for e in every]))

    rows = [(float(u), a, b) for a in range(1, 5) for b in range(1, 5) for u in range(a * b + 1)]
    df = spark.createDataFrame(rows + [(None, 2, 2), (5.0, 0, 3), (7.0, 90, 90)], "u double, na long, nb long")
    for r in exact.exact_u(df, "u", "na", "nb").collect():
        if r.u is None or not r.na or r.na == 90:
            assert r.p is None
        else:
            assert r.p == pytest.approx(brute(r.u, r.na, r.nb))


def test_ranks_are_found_once(spark, monkeypatch):
    """They are written before the two readings of the test."""
    seen, whole = [], exact.exact_permutation
    monkeypatch.setattr(exact, "exact_permutation", lambda df, *args, **more: seen.append(df.inputFiles()) or whole(df, *args, **more))
    df = spark.createDataFrame([(g, i % 2 == 0, float(i * g % 5)) for g in (1, 2) for i in range(7)], "g int, a boolean, v double")
    got = {r.g: (r.na, r.nb, r.p) for r in exact.exact_rank_sum(df, ["g"], F.col("a"), "v").collect()}
    ranks = stats.mid_ranks(df, ["g"], "v", "r").collect()
    assert got == {g: (4, 3, pytest.approx(brute_p([("", r.a, r.r) for r in ranks if r.g == g]))) for g in (1, 2)}
    assert all(seen)


def test_welch_interval(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5)] + [("b", float(v)) for v in (2, 4, 6, 8, 10)], "g string, v double")
    r = exact.welch_interval(df, [], F.col("g") == "a", F.col("g") == "b", "v").first()
    # t = -3 / sqrt(0.5 + 2), 5.882 degrees of freedom: the 0.975 quantile is 2.4589
    assert r.t == pytest.approx(-1.8974, abs=1e-4) and r.df == pytest.approx(5.8824, abs=1e-4) and r.p == pytest.approx(0.1075, abs=2e-4)
    assert r.low == pytest.approx(-3 - 2.4589 * 2.5**0.5, abs=2e-3) and r.high == pytest.approx(-3 + 2.4589 * 2.5**0.5, abs=2e-3)


def test_ramp(spark):
    t = np.arange(0, 48.5, 0.5)
    y = np.interp(t, [16, 32], [2.0, 10.0])
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "t": t, "y": y}).reset_index(drop=True))
    r = exact.ramp_fit(df, ["g"], "t", "y").first()
    assert (r.onset, r.offset) == (16.0, 32.0) and r.sse < 1e-6 and abs(r.low - 2) < 1e-6 and abs(r.high - 10) < 1e-6
    assert exact.ramp_fit(df.where("t = 0"), ["g"], "t", "y").count() == 0


def test_bootstraps(spark):
    rng = np.random.default_rng(5)
    rows = [(u, p, float(10 * p + rng.normal())) for u in range(80) for p in range(3)]
    df = spark.createDataFrame(rows, "u int, p int, v double")
    for r in exact.cluster_bootstrap(df, "u", "p", "v", 200).collect():
        mean = np.mean([v for _, p, v in rows if p == r.p])
        assert r.low < mean < r.high and r.high - r.low < 1.0
    steady = [("up", i, float(i + rng.normal() * 0.1)) for i in range(60)] + [("flat", i, float(rng.normal())) for i in range(60)]
    p = {r.g: r.p for r in exact.block_bootstrap(spark.createDataFrame(steady, "g string, i int, v double"), ["g"], "i", "v", 5, 200).collect()}
    assert p["up"] < 0.02 and p["flat"] > 0.05


def test_lookups_take_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "A", None), (1, "A", None), (2, None, "b"), (3, None, None)], "i int, x string, y string")
    wanted = spark.createDataFrame([("a",), ("B",), ("b",), (None,)], "n string")
    assert sorted(r.i for r in filters.in_either(df, ["x", "y"], wanted, "n").collect()) == [1, 1, 2]
    names = spark.createDataFrame([("A", 1), ("C", 2), ("C", 3)], "x string, k int")
    asked = spark.createDataFrame([("A",), ("C",), ("D",), (None,)], "x string")
    assert {r.x: (r.k, r.match) for r in filters.only_match(asked, names, "x").collect()} == {"A": (1, "found"), "C": (None, "ambiguous"), "D": (None, "missing"), None: (None, "missing")}


def test_exact_rank_sum_takes_ties(spark):
    rng = np.random.default_rng(12)
    rows = [(g, bool(k < 4), float(v)) for g in range(3) for k, v in enumerate(rng.permutation(9) if g else rng.integers(0, 4, 9))] + [(0, None, 1.0), (0, True, None)]
    df = spark.createDataFrame(rows, "g int, a boolean, v double")
    got = {r.g: r for r in exact.exact_rank_sum(df, ["g"], F.col("a"), "v").collect()}
    for g in range(3):
        own = [(a, v) for k, a, v in rows if k == g and a is not None and v is not None]
        ranks = pd.Series([v for _, v in own]).rank().to_numpy()
        sums = [sum(ranks[list(c)]) for c in combinations(range(9), 4)]
        seen = sum(r for r, (a, _) in zip(ranks, own) if a)
        assert got[g].p == pytest.approx(np.mean([abs(s - 20) >= abs(seen - 20) - 1e-9 for s in sums]))
        if g:
            u = spark.createDataFrame([(float(seen) - 10.0, 4, 5)], "u double, na int, nb int")
            assert exact.exact_u(u, "u", "na", "nb").first().p == pytest.approx(got[g].p)


def test_block_bootstrap_draws_are_not_broadcast(spark, monkeypatch):
    rows = [(u, i, float((i * i * (u + 3)) % 17)) for u in range(3) for i in range(12)] + [(9, 0, 1.0), (9, 1, 2.0)]
    df = spark.createDataFrame(rows, "u long, i long, v double")
    run = lambda: exact.block_bootstrap(df, ["u"], "i", "v", 4, 50)
    short = {r["u"]: (r["observed"], r["p"]) for r in run().collect()}
    assert set(short) == {0, 1, 2}
    monkeypatch.setattr(exact, "LONG", 5)
    assert {r["u"]: (r["observed"], r["p"]) for r in run().collect()} == short
    plan = run()._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan


def test_residual_rank_sums_each_line_once(spark):
    rows = spark.createDataFrame([(1, float(i), float((i * 7) % 11)) for i in range(51)], "g long, x double, y double")
    found = filters.residual_rank(rows, ["g"], "x", "y", 0.98)
    assert found.count() == 1
    assert "regr_slope" not in found._jdf.queryExecution().executedPlan().toString()
