"""Tracks and regions against brute force."""

import random

from pyspark.sql import functions as F

from gaugeframe.operators import space


def test_chains(spark):
    links = [(f"n{i}", f"n{i - 1}") for i in range(1, 20)] + [("b", "a")]
    got = dict(map(tuple, space.chain_roots(spark.createDataFrame(links, "node string, before string"), "node", "before").collect()))
    assert got == {**{f"n{i}": "n0" for i in range(20)}, "a": "a", "b": "a"}
    assert space.chain_roots(spark.createDataFrame([], "node string, before string"), "node", "before").count() == 0


def test_tracks_follow_moving_points(spark):
    rng = random.Random(1)
    rows = [("s", f, 100 * k + f, 20.0 * k + 1.5 * f + rng.random(), 5.0 * k) for k in range(4) for f in range(12) if not (k == 2 and f == 6)]
    got = {r.id: r.track for r in space.tracks(spark.createDataFrame(rows, "s string, f long, id long, x double, y double"), ["s"], "f", "id", ["x", "y"], 4.0).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (100 * (i // 100) if i < 207 or i >= 300 else 207) for i in got)


def test_regions(spark):
    rng = random.Random(2)
    cells = {(rng.randrange(30), rng.randrange(30)) for _ in range(450)}
    seen = {}
    for start in sorted(cells):
        todo = [start]
        while todo:
            x, y = todo.pop()
            if (x, y) in cells and (x, y) not in seen:
                seen[x, y] = start
                todo += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
    df = spark.createDataFrame([("g", x, y) for x, y in cells] + [("h", 0, 0), ("h", 0, 0)], "g string, x long, y long")
    got = space.regions(df, ["g"], "x", "y").collect()
    assert len(got) == len(cells) + 1
    assert {(r.x, r.y): r.region for r in got if r.g == "g"} == {k: (v[0] << 31) + v[1] for k, v in seen.items()}


def test_nothing_in_reach(spark):
    p = spark.createDataFrame([("g", 1, 0.0, 0.0), ("h", 2, 0.0, 0.0)], "g string, id long, x double, y double")
    m = spark.createDataFrame([("g", 3.0, 4.0), ("g", -30.0, 0.0)], "g string, x double, y double")
    got = {r.id: r.distance for r in space.near_distance(p, m, ["g"], "x", "y", 5.0).collect()}
    assert got == {1: 5.0, 2: None}
    assert space.near_distance(p, m, ["g"], "x", "y", 4.9).where(F.col("distance").isNotNull()).count() == 0
