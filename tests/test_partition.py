"""Partitions of a domain, nearest places and polylines against brute force."""

import heapq
import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from gaugeframe import table_queries
from gaugeframe.operators import partition, polyline

CELL = "g string, x long, y long, level double, seed long"


def around(x, y):
    return ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1))


def flooded(level, seeds):
    """Level by level and step by step over a grid in one place."""
    height = {p: level[p] for p in seeds if level[p] is not None}
    todo = [(h, p) for p, h in height.items()]
    heapq.heapify(todo)
    while todo:
        h, p = heapq.heappop(todo)
        if h > height[p]:
            continue
        for q in around(*p):
            if level.get(q) is not None and max(h, level[q]) < height.get(q, math.inf):
                height[q] = max(h, level[q])
                heapq.heappush(todo, (height[q], q))
    found = {p: (seeds[p], h, 0) for p, h in height.items() if p in seeds}
    for h in sorted(set(height.values())):
        step, left = 0, {p for p in height if height[p] == h and p not in found}
        while left:
            step += 1
            new = {}
            for p in left:
                owners = [found[q][0] for q in around(*p) if q in found and (found[q][1] < h and step == 1 or found[q][1] == h and found[q][2] == step - 1)]
                if owners:
                    new[p] = (min(owners), h, step)
            found |= new
            left -= set(new)
            if not new and step > 1:
                break
    return found


def test_flood_is_a_watershed(spark):
    rng = random.Random(3)
    rows = []
    want = {}
    for g, levels in (("a", 4), ("b", 1), ("c", 40)):
        level = {(x, y): float(rng.randrange(levels)) for x in range(-9, 22) for y in range(27) if rng.random() < 0.8}
        for p in list(level)[::50]:
            level[p] = None
        seeds = dict(zip(rng.sample(sorted(level), 7), (5, -3, 8, 8, 1, 2, 9)))
        rows += [(g, *p, v, seeds.get(p)) for p, v in level.items()]
        want |= {(g, *p): v for p, v in flooded(level, seeds).items()}
    df = spark.createDataFrame(rows + rows[:5] + [("a", None, 3, 0.0, 1)], CELL).withColumn("owner", F.lit("other"))
    got = partition.flood(df, ["g"], "x", "y", "seed", "level", tile=8).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.owner, r.height, r.steps) == want.get((r.g, r.x, r.y), (None, None, None)), r
    again = partition.flood(df, ["g"], "x", "y", "seed", "level").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_a_tile_is_settled_in_proportion_to_its_cells():
    """A way that winds through a whole tile is followed cell by cell, not by as many sweeps as it has steps."""
    n = 256
    inside = np.zeros((n + 2, n + 2), bool)
    inside[1 : n + 1 : 2, 1 : n + 1] = True
    inside[2 : n + 1 : 4, n] = inside[4 : n : 4, 1] = True
    inside[n, n] = False
    grid = {"inside": inside, "level": np.where(inside, 0.0, np.inf), "fixed": np.zeros_like(inside)}
    grid |= {"height": np.full(inside.shape, np.inf), "steps": np.full(inside.shape, partition.NONE), "owner": np.full(inside.shape, partition.NONE)}
    grid["fixed"][1, 1], grid["height"][1, 1], grid["steps"][1, 1], grid["owner"][1, 1] = True, 0.0, 0, 7
    began = time.perf_counter()
    partition._heights(grid)
    partition._owners(grid)
    assert time.perf_counter() - began < 5
    assert (grid["height"][inside] == 0).all() and (grid["owner"][inside] == 7).all()
    assert sorted(grid["steps"][inside].tolist()) == list(range(inside.sum()))


def test_flood_along_a_winding_way(spark):
    """Steps within the domain, over many tiles and back again."""
    way = [(x if (y // 2) % 2 == 0 else 19 - x, y) for y in range(0, 20, 2) for x in range(20)]
    joints = {(19 if (y // 2) % 2 == 0 else 0, y + 1) for y in range(0, 18, 2)}
    cells = set(way) | joints
    df = spark.createDataFrame([(None, x, y, 0.0, 7 if (x, y) == (0, 0) else None) for x, y in cells], CELL)
    got = {(r.x, r.y): r.steps for r in partition.flood(df, ["g"], "x", "y", "seed", tile=10).collect()}
    assert len(got) == len(cells) and max(got.values()) == len(cells) - 1
    assert partition.flood(spark.createDataFrame([], CELL), ["g"], "x", "y", "seed").count() == 0


def test_partition_by_distance(spark):
    rng = random.Random(4)
    cells = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(1500)})
    seeds = dict(zip(rng.sample(cells, 150), [k % 9 for k in range(150)]))
    df = spark.createDataFrame([("g", *p, 0.0, seeds.get(p)) for p in cells] + [("h", 1, 1, 0.0, None), (None, 1, 1, 0.0, 4)], CELL)
    got = partition.by_distance(df, ["g"], "x", "y", "seed").collect()
    assert len(got) == len(cells) + 2
    for r in got:
        if r.g != "g":
            assert (r.distance, r.owner) == (None, None)
            continue
        d, owner = min((math.dist((r.x, r.y), p), s) for p, s in seeds.items())
        assert r.owner == owner and abs(r.distance - d) < 1e-9


def touching(mask, seeds):
    seen, todo = set(), [p for p in seeds if p in mask]
    while todo:
        p = todo.pop()
        if p not in seen:
            seen.add(p)
            todo += [q for q in around(*p) if q in mask]
    return seen


def test_partition_by_scores(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for g, kinds in (("a", (1, 2)), ("b", (1,)), ("c", (2,)), ("d", ()), ("e", (1, 2))):
        cells = sorted({(rng.randrange(20), rng.randrange(20)) for _ in range(300)})
        score = {p: (rng.random(), rng.choice([rng.random(), float("nan"), None, float("inf")]) if rng.random() < 0.2 else rng.random()) for p in cells}
        seeds = {p: k for k in kinds for p in rng.sample(cells, 4)}
        rows += [(g, *p, *score[p], seeds.get(p)) for p in cells]
        one, two = ({p for p, k in seeds.items() if k == kind} for kind in (1, 2))
        above = {p for p, (a, b) in score.items() if b is not None and math.isfinite(b) and b > a}
        kept = touching(above | two, two)
        first = touching((set(cells) - kept) | one, one)
        for p in cells:
            want[g, *p] = (1 if p in first else 2) if one and two else 1 if one else 2 if two else None
    df = spark.createDataFrame(rows, "g string, x long, y long, a double, b double, seed long")
    got = {(r.g, r.x, r.y): r.owner for r in partition.by_scores(df, ["g"], "x", "y", "seed", "a", "b", tile=6).collect()}
    assert got == want


def nearest_on(line, p):
    best, start = None, 0.0
    for (ax, ay), (bx, by) in zip(line, line[1:]) if len(line) > 1 else [(line[0], line[0])]:
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        u = min(max(((p[0] - ax) * dx + (p[1] - ay) * dy) / n, 0), 1) if n else 0.0
        ox, oy = p[0] - (ax + u * dx), p[1] - (ay + u * dy)
        d = math.hypot(ox, oy)
        if best is None or d < best[0] - 1e-12:
            best = (d, start + u * math.sqrt(n), (dx * oy - dy * ox) / math.sqrt(n) if n else oy)
        start += math.sqrt(n)
    return best


def test_nearest_place_on_a_line(spark):
    rng = random.Random(6)
    lines = {"a": [(0.0, 0.0)], "b": [(0.0, 0.0), (0.0, 0.0), (3.0, 4.0)], "c": []}
    x = y = 0.0
    for k in range(700):  # more than FAN segments, so boxes of two levels
        lines["c"].append((x, y))
        x, y = x + rng.gauss(0.3, 1), y + rng.gauss(0, 1)
    vertices = [(g, k, *p) for g, line in lines.items() for k, p in enumerate(line)]
    rng.shuffle(vertices)
    points = [(k, rng.choice("abc"), rng.uniform(-50, 300), rng.choice([rng.uniform(-60, 60), rng.uniform(-5000, 5000)])) for k in range(300)]
    odd = [(1000, "c", None, 1.0), (1001, "c", float("nan"), 1.0), (1002, "z", 1.0, 1.0), (1003, None, 1.0, 1.0), (1004, "c", float("inf"), 0.0)]
    v = spark.createDataFrame(vertices + [("c", None, 1.0, 1.0), ("c", 3, None, 1.0)], "g string, k long, x double, y double")
    p = spark.createDataFrame(points + points[:3] + odd, "id long, g string, x double, y double")
    got = polyline.project(p, v, ["g"], "k", "x", "y").collect()
    assert len(got) == len(points) + 3 + len(odd)
    for r in got:
        if r.id >= 1000:
            assert (r.distance, r.arc, r.offset) == (None, None, None)
            continue
        d, arc, offset = nearest_on(lines[r.g], (r.x, r.y))
        assert abs(r.distance - d) < 1e-8 and abs(r.arc - arc) < 1e-6 and abs(r.offset - offset) < 1e-8, (r, d, arc, offset)
    empty = polyline.project(p, v.limit(0), ["g"], "k", "x", "y").collect()
    assert len(empty) == len(got) and all(r.distance is None for r in empty)


def test_points_at_equal_steps(spark):
    rng = random.Random(7)
    line = [(rng.random(), rng.random()) for _ in range(90)]
    line[40] = line[41]
    vertices = [("a", k, *p) for k, p in enumerate(line)] + [("b", 0, 1.0, 2.0), ("c", 0, 1.0, 1.0), ("c", 1, 1.0, 1.0)]
    v = spark.createDataFrame(vertices, "g string, k long, x double, y double").repartition(7)
    got = {(r.g, r.step): (r.x, r.y) for r in polyline.resample(v, ["g"], "k", "x", "y", 101).collect()}
    assert len(got) == 303
    assert {got[g, s] for g in "bc" for s in range(101)} == {(1.0, 2.0), (1.0, 1.0)}
    lengths = [0.0]
    for a, b in zip(line, line[1:]):
        lengths.append(lengths[-1] + math.dist(a, b))
    for s in range(101):
        t = lengths[-1] * s / 100
        i = max(k for k in range(len(line) - 1) if lengths[k] <= t + 1e-12)
        u = min((t - lengths[i]) / (lengths[i + 1] - lengths[i]), 1.0) if lengths[i + 1] > lengths[i] else 1.0
        want = [line[i][c] + u * (line[i + 1][c] - line[i][c]) for c in (0, 1)]
        assert math.dist(got["a", s], want) < 1e-9
    assert got["a", 0] == line[0] and got["a", 100] == line[-1]


def test_nearest_marks_at_any_distance(spark):
    rng = random.Random(8)
    marks = [(k % 5, rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(400)] + [(9, 1e6, 1e6), (3, 2.0, 2.0), (1, 2.0, 2.0)]
    points = [(k, rng.gauss(0, 3), rng.gauss(0, 3)) for k in range(100)] + [(100, -1e7, 5.0), (101, 2.0, 2.0), (102, None, 0.0), (103, 1e6, 1e6)]
    m = spark.createDataFrame(marks, "label long, x double, y double")
    p = spark.createDataFrame(points, "id long, x double, y double")
    for r in polyline.nearest_mark(p, m, [], "label", "x", "y").collect():
        if r.x is None:
            assert r.distance is None
            continue
        d, label = min((math.hypot(r.x - x, r.y - y), k) for k, x, y in marks)
        assert abs(r.distance - d) <= 1e-9 * max(1, d) and r.nearest == label


def test_cells_add_up_in_the_order_of_rows(spark, tmp_path):
    row = lambda d, k=0: ("A", 1, 100 * k, 1.0, d)
    names = "l_returnflag string, l_suppkey long, l_partkey long, l_quantity double, l_discount double"
    for name, rows in (("a", [row(0.1)]), ("b", [row(0.2), row(0.3), *(("R", 2, i, 1.0, i / 7) for i in range(500))])):
        spark.createDataFrame(rows, names).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet" / f"part={name}"))
    got = table_queries._cells_in_order(spark, str(tmp_path)).where("g = 'A'").collect()
    assert [(r.x, r.y, r.a, r.b) for r in got] == [(1, 0, 1.0, (0.1 + 0.2 + 0.3) / 3 * 500)]
    assert (0.1 + 0.2 + 0.3) / 3 * 500 != (0.2 + 0.3 + 0.1) / 3 * 500


def test_tiles_descend_in_place_of_points(spark, monkeypatch):
    """Points of a tile are led down the boxes together; few and many tiles give the nearest marks of brute force."""
    rng = np.random.default_rng(11)
    marks = [("g", i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(90, 2)) * 40)]
    points = [("g", float(x), float(y)) for x, y in rng.uniform(-90, 90, (700, 2))]
    monkeypatch.setattr(polyline, "FAN", 4)
    at = np.array([m[2:] for m in marks])
    for tiles in (1, 50):
        monkeypatch.setattr(polyline, "TILES", tiles)
        got = polyline.nearest_mark(spark.createDataFrame(points, "g string, x double, y double"), spark.createDataFrame(marks, "g string, id long, x double, y double"), ["g"], "id", "x", "y").collect()
        assert len(got) == 700
        for r in got:
            d = np.hypot(*(at - [r.x, r.y]).T)
            assert abs(d.min() - r.distance) < 1e-9 and r.nearest == int(d.argmin())
