"""Matching set by set, connected sets and exact quantiles against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.functions import numeric
from gaugeframe.functions.numeric import assign, transport
from gaugeframe.operators import graph, search, stats


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(70)]
    low = {n: n for e in edges for n in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            least = min(low[a], low[b])
            moved |= low[a] != least or low[b] != least
            low[a] = low[b] = least
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == low
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").isEmpty()


@pytest.mark.parametrize("reach", [1.5, 6.0])
def test_match_is_the_best_of_each_group(spark, reach):
    rng = random.Random(4)
    side = lambda n, start: [(g, start + 100 * g + i, rng.uniform(-15, 15), rng.uniform(-5, 5)) for g in range(3) for i in range(n)]
    one, other = side(25, 0), side(30, 1000)
    make = lambda rows: spark.createDataFrame([*rows, (0, 9000 + rows[0][1], None, 0.0), (None, 9500, 0.0, 0.0)], "g long, id long, x double, y double")
    got = search.match(make(one), make(other), ["g"], "id", ["x", "y"], reach).collect()
    place = {r[1]: r[2:] for r in one + other}
    for r in got:
        assert r.distance == pytest.approx(np.hypot(*np.subtract(place[r.a], place[r.b]))) and r.distance <= reach
    assert len({r.a for r in got}) == len({r.b for r in got}) == len(got)
    for g in range(3):
        a, b = [r for r in one if r[0] == g], [r for r in other if r[0] == g]
        d = np.array([[np.hypot(p[2] - q[2], p[3] - q[3]) for q in b] for p in a])
        best = [d[p] for p in assign(np.where(d <= reach, d, 1e6)) if d[p] <= reach]
        own = [r.distance for r in got if r.g == g]
        assert len(own) == len(best) and sum(own) == pytest.approx(sum(best))


def test_match_of_one_table_and_of_nothing(spark):
    p = spark.createDataFrame([("f", i, float(i)) for i in range(8)], "k string, id long, x double")
    got = search.match(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ["k"], "id", ["x"], 1.0)
    assert got.count() == 4 and got.columns == ["k", "a", "b", "distance"]
    assert search.match(p.limit(0), p, ["k"], "id", ["x"], 1.0).isEmpty()


@pytest.mark.parametrize(("q", "small"), [(0.0, 0), (0.2, 0), (0.5, 5000), (0.995, 0), (1.0, 100_000)])
def test_exact_quantile(spark, monkeypatch, q, small):
    monkeypatch.setattr(stats, "SMALL", small)
    rng = np.random.default_rng(5)
    groups = {"many": rng.normal(size=3000), "ties": np.repeat([1.0, 2.0, 7.0], [400, 1, 400]), "two": np.array([3.0, 4.0]), "one": np.array([5.0]), None: np.array([1.0, 9.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("many", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.m for r in stats.exact_quantile(df, ["g"], "v", q, "m").collect()}
    assert got.pop("none") is None
    assert got == {g: pytest.approx(np.quantile(v, q)) for g, v in groups.items()}
    whole = stats.exact_quantile(df.select("v"), [], "v", q, "m").first().m
    assert whole == pytest.approx(np.quantile(np.concatenate(list(groups.values())), q))
    assert stats.exact_quantile(df.where(F.lit(False)), ["g"], "v", q, "m").isEmpty()


def test_many_points_at_few_places(spark):
    """Places are matched, not their points: 50,000 a place would be 2.5 x 10^9 pairs."""
    make = lambda start, n: spark.range(n).selectExpr("'k' as k", f"2 * id + {start} as id", "cast(id % 2 as double) * 1.5 as x")
    got = search.match(make(0, 100_000), make(1, 99_000), ["k"], "id", ["x"], 1.0)
    row = got.selectExpr("count(*) as n", "count(distinct a) as a", "count(distinct b) as b", "sum(distance) as d", "sum(a) as s").first()
    assert (row.n, row.a, row.b, row.d) == (99_000, 99_000, 99_000, 0.0)
    assert row.s == sum(2 * i for i in range(99_000))  # in order of ids


def test_transport_is_the_assignment_of_units():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, m = rng.integers(1, 8, 2)
        at, supply, demand = rng.integers(0, 12, n + m).astype(float), rng.integers(1, 5, n), rng.integers(1, 5, m)
        apart = np.abs(at[:n, None] - at[None, n:])
        i, j = np.nonzero(apart <= 3)
        units = transport(i, j, apart[i, j], supply, demand, 1e6)
        whole = np.where(apart <= 3, apart, 1e6)[np.ix_(np.repeat(np.arange(n), supply), np.repeat(np.arange(m), demand))]
        best = [whole[p] for p in assign(whole) if whole[p] < 1e6]
        assert units.sum() == len(best) and abs((units * apart[i, j]).sum() - sum(best)) < 1e-6
        assert (np.bincount(i, units, n) <= supply).all() and (np.bincount(j, units, m) <= demand).all()


@pytest.mark.parametrize("cells", [1, 30, 1_000_000])
def test_order_on_a_line_is_the_assignment(monkeypatch, cells):
    monkeypatch.setattr(numeric, "CELLS", cells)
    rng = np.random.default_rng(6)
    for k in range(150):
        n, m = rng.integers(1, 14, 2)
        x, y = (np.sort(rng.integers(0, 25, s) / 10 if k % 2 else rng.uniform(0, 9, s)) for s in (n, m))
        reach = float(rng.choice([0.1, 0.3, 0.7, 3.0]))
        i, j = numeric.in_order(x, y, reach)
        apart = np.abs(x[:, None] - y)
        best = [apart[p] for p in assign(np.where(apart <= reach, apart, 1e6)) if apart[p] <= reach]
        assert len(set(i)) == len(set(j)) == len(i) == len(best) and (apart[i, j] <= reach).all()
        assert apart[i, j].sum() == pytest.approx(sum(best))


@pytest.mark.parametrize("dense", [0, 250_000])
def test_places_on_a_line_make_no_pairs(spark, monkeypatch, dense):
    """Pairs of distinct places within the reach grow with the square of the places; a line is matched without them."""
    monkeypatch.setattr(search, "_within", None)
    monkeypatch.setattr(search, "DENSE", dense)
    rng = random.Random(8)
    side = lambda n, start: [(g, start + 100 * g + i, rng.choice([rng.uniform(0, 30), float(rng.randrange(30))])) for g in range(3) for i in range(n)]
    one, other = side(40, 0), side(35, 1000)
    make = lambda rows: spark.createDataFrame([*rows, (0, 9000, None), (None, 9500, 0.0), (1, 9600, float("inf"))], "g long, id long, x double")
    got = search.match(make(one), make([(g, i + 2**60, x) for g, i, x in other]), ["g"], "id", ["x"], 0.4).collect()
    place = {r[1]: r[2] for r in one} | {r[1] + 2**60: r[2] for r in other}
    assert len({r.a for r in got}) == len({r.b for r in got}) == len(got)
    for g in range(3):
        a, b = ([r[2] for r in rows if r[0] == g] for rows in (one, other))
        d = np.abs(np.subtract.outer(a, b))
        best = [d[p] for p in assign(np.where(d <= 0.4, d, 1e6)) if d[p] <= 0.4]
        own = [r.distance for r in got if r.g == g]
        assert len(own) == len(best) and sum(own) == pytest.approx(sum(best)) and max(own) <= 0.4
    assert all(r.distance == abs(place[r.a] - place[r.b]) for r in got)


def test_many_places_on_a_line(spark):
    """3,000 places on either side, 9 million pairs within the reach: in order of both, as all can be matched."""
    x, y = (np.sort(np.random.default_rng(k).uniform(0, 10, 3000)) for k in (1, 2))
    make = lambda v: spark.createDataFrame([("k", k, float(at)) for k, at in enumerate(v)], "k string, id long, x double")
    got = search.match(make(x), make(y), ["k"], "id", ["x"], 10.0).selectExpr("count(distinct a) as a", "count(distinct b) as b", "sum(distance) as d").first()
    assert (got.a, got.b) == (3000, 3000) and got.d == pytest.approx(np.abs(x - y).sum())


def test_set_in_a_plane_is_solved_from_its_places():
    """Rows find their columns when they are looked at: the units are those over all pairs."""
    rng = np.random.default_rng(9)
    for k in range(60):
        n, m = rng.integers(1, 8, 2)
        x, y = (rng.integers(0, 6, (s, 2)).astype(float) if k % 2 else rng.uniform(0, 6, (s, 2)) for s in (n, m))
        supply, demand = rng.integers(1, 5, n), rng.integers(1, 5, m)
        apart = np.hypot(*(x[:, None] - y).transpose(2, 0, 1))
        i, j, units = search._by_paths(x, y, supply, demand, 2.0)
        p, q = np.nonzero(apart <= 2)
        told = transport(p, q, apart[p, q], supply, demand, 1e6)
        assert units.sum() == told.sum() and (units * apart[i, j]).sum() == pytest.approx((told * apart[p, q]).sum())
        assert (apart[i, j] <= 2).all() and (np.bincount(i, units, n) <= supply).all() and (np.bincount(j, units, m) <= demand).all()


def test_sets_in_a_plane_are_told_without_pairs(spark, monkeypatch):
    """Pairs within the reach grow with the square of distinct places; links that tell the sets are as few as the places."""
    told, found = [], graph.components
    monkeypatch.setattr(search.graph, "components", lambda links, a, b: told.append(links.count()) or found(links, a, b))
    rng = random.Random(10)
    side = lambda n, start: [("k", start + i, rng.uniform(0, 3), rng.uniform(0, 200)) for i in range(n)]
    one, other = side(600, 0), side(590, 1000)
    make = lambda rows: spark.createDataFrame([*rows, ("k", 9000 + rows[0][1], float("inf"), 0.0)], "k string, id long, x double, y double")
    got = search.match(make(one), make(other), ["k"], "id", ["x", "y"], 9.0).collect()
    d = np.array([[np.hypot(p[2] - q[2], p[3] - q[3]) for q in other] for p in one])
    assert (d <= 9).sum() > 25_000 and told[0] <= 3 * (len(one) + len(other))
    assert len({r.a for r in got}) == len({r.b for r in got}) == len(got) == 590 and max(r.distance for r in got) <= 9
    best = [d[p] for p in assign(np.where(d <= 9, d, 1e6)) if d[p] <= 9]
    assert sum(r.distance for r in got) == pytest.approx(sum(best))


def test_ranges_hold_all_within_the_reach():
    rng = np.random.default_rng(11)
    for k in range(60):
        n, m, dim = *rng.integers(1, 20, 2), 1 + k % 3
        x, y = (rng.integers(-6, 6, (s, dim)) * (0.5 if k % 2 else 1e6) + rng.uniform(0, 1, (s, dim)) for s in (n, m))
        order, ranges = search._ranges(x, y, 1.5)
        for r in range(n):
            held = [order[c] for lo, hi in ranges(r) for c in range(lo, hi)]
            assert len(held) == len(set(held)) and set(np.flatnonzero(search._apart(x[r], y) <= 1.5)) <= set(held)
