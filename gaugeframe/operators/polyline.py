"""Nearest places without a reach: on polylines, among marks; arc lengths and points at equal steps.

Points, or for marks tiles of points, descend a tree of boxes, a level a join: from a box they go on only to those of
the next level that may hold something nearer than what they are sure to find. Points then look at what a tile has left. Items of a group are numbered along the line, or along a curve
through the plane, and a box holds 64 following ones of the level below.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import stats

FAN = 64
#: Boxes are told in as many copies, so that a group's points are dealt over as many tasks.
COPIES = 16
#: Tiles of places for an item, at most.
TILES = 4


def _finite(*names: str) -> Column:
    test = F.lit(True)
    for c in names:
        test = test & F.col(c).isNotNull() & (F.abs(c) < float("inf"))  # NaN is above all numbers
    return test


def _places(points: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Places of points, once each."""
    rows = points.select(*by, F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py"))
    return rows.where(_finite("_px", "_py")).distinct()


def _near_items(places: DataFrame, items: DataFrame, by: Sequence[str]) -> DataFrame:
    """(place, item) pairs that hold each place's nearest item: those left at the end of its descent.

    ``items``: ``item`` numbers those of a group from 0; ``x0 y0`` lies on it, ``x1 y1`` is its other end. The up to
    64 boxes below one are a row's array, and what a place is sure to find goes down with it, so a level neither
    sorts nor shuffles more than its join does.
    """
    last = items.agg(F.max("item")).first()[0]
    levels = 1
    while FAN**levels <= (last or 0):
        levels += 1
    held = places.withColumn("_box", F.lit(0).cast("long")).withColumn("_copy", F.pmod(F.xxhash64("_px", "_py"), F.lit(COPIES)).cast("int")).withColumn("_sure", F.lit(float("inf")))
    copies = F.explode(F.array(*(F.lit(i) for i in range(COPIES)))).alias("_copy")
    edges = [g(f"{c}0", f"{c}1").alias(f"{n}{c}") for n, g in (("lo", F.least), ("hi", F.greatest)) for c in "xy"]
    kept = [c for c in items.columns if c not in by]
    for level in reversed(range(levels)):  # the last is 0, that of the items themselves
        if level:
            ends = [f(g(f"{c}0", f"{c}1")).alias(f"{n}{c}") for n, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest)) for c in "xy"]
            rows = items.groupBy(*by, F.floor(F.col("item") / FAN**level).cast("long").alias("_next")).agg(*ends, F.min(F.struct("item", "x0", "y0")).alias("_on"))
            rows = rows.select(*by, "_next", F.struct("_next", "lox", "hix", "loy", "hiy", F.col("_on.x0").alias("x0"), F.col("_on.y0").alias("y0")).alias("_one"))
        else:
            rows = items.select(*by, F.col("item").alias("_next"), F.struct(*kept, *edges).alias("_one"))
        below = rows.groupBy(*by, F.floor(F.col("_next") / FAN).cast("long").alias("_box")).agg(F.collect_list("_one").alias("_below"))
        met = held.join(below.select("*", copies), [*by, "_box", "_copy"])
        gap = lambda o: F.hypot(*(F.greatest(o[f"lo{c}"] - F.col(f"_p{c}"), F.col(f"_p{c}") - o[f"hi{c}"], F.lit(0.0)) for c in "xy"))
        away = lambda o: F.hypot(o["x0"] - F.col("_px"), o["y0"] - F.col("_py"))
        met = met.withColumn("_sure", F.least("_sure", F.array_min(F.transform("_below", away))))
        near = met.withColumn("_one", F.explode(F.filter("_below", lambda o: gap(o) <= F.col("_sure") * (1 + 1e-9))))
        if not level:
            return near.select(*by, "_px", "_py", *(F.col(f"_one.{c}").alias(c) for c in kept))
        held = near.select(*by, "_px", "_py", F.col("_one._next").alias("_box"), "_copy", "_sure")


def _near_by_tiles(places: DataFrame, items: DataFrame, by: Sequence[str]) -> DataFrame:
    """(place, item) pairs that hold each place's nearest item: those that its own tile and then itself can't rule out.

    ``items``: ``item`` numbers those of a group from 0; ``x0 y0`` lies on it, ``x1 y1`` is its other end. Places fall
    into square tiles, about as many as there are items, and it is tiles that descend; a place then looks at the items
    that are left for its tile, which are a row's array, so it is joined once.
    """
    told = items.groupBy(*by).agg(F.max("item").alias("n")).agg(F.max("n").alias("last"), F.sum(F.col("n") + 1).alias("all")).first()
    levels = 1
    while FAN**levels <= (told["last"] or 0):
        levels += 1
    ends = places.groupBy(*by).agg(*(f(f"_p{c}").alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"), F.count(F.lit(1)).alias("n"))
    width = ends.groupBy().agg(F.sum(F.greatest(F.col("hix") - F.col("lox"), F.lit(0.0)) * F.greatest(F.col("hiy") - F.col("loy"), F.lit(0.0))).alias("area"), F.sum("n").alias("n"), F.max(F.greatest(F.abs("lox"), F.abs("hix"), F.abs("loy"), F.abs("hiy"))).alias("far")).first()
    wanted = max(1, min(TILES * (told["all"] or 1), (width["n"] or 1) // 8))
    side = max(math.sqrt((width["area"] or 0.0) / wanted), (width["far"] or 0.0) * 1e-9, 1e-300)
    tile = {c: F.floor(F.col(f"_p{c}") / F.lit(side)) for c in "xy"}
    marked = places.withColumns({f"_t{c}": tile[c] for c in "xy"})
    held = marked.groupBy(*by, "_tx", "_ty").agg(*(f(f"_p{c}").alias(f"_{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"))
    held = held.withColumn("_box", F.lit(0).cast("long")).withColumn("_copy", F.pmod(F.xxhash64("_tx", "_ty"), F.lit(COPIES)).cast("int")).withColumn("_sure", F.lit(float("inf")))
    copies = F.explode(F.array(*(F.lit(i) for i in range(COPIES)))).alias("_copy")
    edges = [g(f"{c}0", f"{c}1").alias(f"{n}{c}") for n, g in (("lo", F.least), ("hi", F.greatest)) for c in "xy"]
    kept = [c for c in items.columns if c not in by]
    for level in reversed(range(levels)):  # the last is 0, that of the items themselves
        if level:
            bounds = [f(g(f"{c}0", f"{c}1")).alias(f"{n}{c}") for n, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest)) for c in "xy"]
            rows = items.groupBy(*by, F.floor(F.col("item") / FAN**level).cast("long").alias("_next")).agg(*bounds, F.min(F.struct("item", "x0", "y0")).alias("_on"))
            rows = rows.select(*by, "_next", F.struct("_next", "lox", "hix", "loy", "hiy", F.col("_on.x0").alias("x0"), F.col("_on.y0").alias("y0")).alias("_one"))
        else:
            rows = items.select(*by, F.col("item").alias("_next"), F.struct(*kept, *edges).alias("_one"))
        below = rows.groupBy(*by, F.floor(F.col("_next") / FAN).cast("long").alias("_box")).agg(F.collect_list("_one").alias("_below"))
        met = held.join(below.select("*", copies), [*by, "_box", "_copy"])
        # no place of the tile is nearer than the gap, none is farther than the way to the tile's farthest corner
        gap = lambda o: F.hypot(*(F.greatest(o[f"lo{c}"] - F.col(f"_hi{c}"), F.col(f"_lo{c}") - o[f"hi{c}"], F.lit(0.0)) for c in "xy"))
        away = lambda o: F.hypot(*(F.greatest(F.abs(o[f"{c}0"] - F.col(f"_lo{c}")), F.abs(o[f"{c}0"] - F.col(f"_hi{c}"))) for c in "xy"))
        met = met.withColumn("_sure", F.least("_sure", F.array_min(F.transform("_below", away))))
        near = met.withColumn("_one", F.explode(F.filter("_below", lambda o: gap(o) <= F.col("_sure") * (1 + 1e-9))))
        held = near.select(*(c for c in held.columns if c not in ("_box", "_sure")), *([F.col("_one._next").alias("_box")] if level else ["_one"]), "_sure")
    # boxes of one tile are told apart until here: what one is sure of rules out items of the others
    best = held.groupBy(*by, "_tx", "_ty").agg(F.min("_sure").alias("_sure"), F.collect_list(F.struct(gap(F.col("_one")).alias("gap"), "_one")).alias("_left"))
    best = best.select(*by, "_tx", "_ty", F.transform(F.filter("_left", lambda o: o["gap"] <= F.col("_sure") * (1 + 1e-9)), lambda o: o["_one"]).alias("_left"))
    met = marked.join(best, [*by, "_tx", "_ty"])
    gap = lambda o: F.hypot(*(F.greatest(o[f"lo{c}"] - F.col(f"_p{c}"), F.col(f"_p{c}") - o[f"hi{c}"], F.lit(0.0)) for c in "xy"))
    away = lambda o: F.hypot(o["x0"] - F.col("_px"), o["y0"] - F.col("_py"))
    met = met.withColumn("_sure", F.array_min(F.transform("_left", away)))
    near = met.withColumn("_one", F.explode(F.filter("_left", lambda o: gap(o) <= F.col("_sure") * (1 + 1e-9))))
    return near.select(*by, "_px", "_py", *(F.col(f"_one.{c}").alias(c) for c in kept))


def _told(points: DataFrame, found: DataFrame, by: Sequence[str], x: str, y: str, *names: str) -> DataFrame:
    """Points, repeated ones included, with what was found for their places."""
    own = found.select(*(F.col(c).alias(f"_of_{c}") for c in by), "_px", "_py", F.struct(*names).alias("_found"))
    on = (F.col(x).cast("double") == F.col("_px")) & (F.col(y).cast("double") == F.col("_py"))
    for c in by:
        on = on & (F.col(c) == F.col(f"_of_{c}"))
    return points.join(own, on, "left").select(*points.columns, *(F.col(f"_found.{n}").alias(n) for n in names))


def segments(vertices: DataFrame, by: Sequence[str], order: str, x: str, y: str) -> DataFrame:
    """(by, item, x0, y0, x1, y1, start, end, total): segments in order, with arc lengths where they start and end.

    Vertices of equal order follow by place; those without order or place are left out. A single vertex is a
    segment without length. A long line is spread over ranges, which hand on their lengths and first vertices.
    """
    v = vertices.select(*by, F.col(order).alias("_o"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rows = stats.in_ranges(v.where(F.col("_o").isNotNull() & _finite("_x", "_y")), by, ["_o", "_x", "_y"])
    here = F.struct("_o", "_x", "_y")
    w = Window.partitionBy(*by, "_range").orderBy("_o", "_x", "_y")
    rows = stats.of_ranges(rows, by, first=F.min(here))
    following = F.coalesce(F.lead(here).over(w), F.col("_later_first"))
    rows = rows.select(*by, "_range", (F.col("_before") + F.row_number().over(w) - 1).alias("item"), "_x", "_y", following.alias("_to"), F.col("_all").alias("_n"))
    rows = rows.where(F.col("_to").isNotNull() | (F.col("_n") == 1))
    rows = rows.select(*by, "_range", "item", F.col("_x").alias("x0"), F.col("_y").alias("y0"), F.coalesce("_to._x", "_x").alias("x1"), F.coalesce("_to._y", "_y").alias("y1"))
    rows = stats.of_ranges(cut(rows.withColumn("_length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))), by, F.col("_length"))
    w = Window.partitionBy(*by, "_range").orderBy("item")
    run = F.sum("_length").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.col("_before") + F.coalesce(run, F.lit(0.0))).withColumn("total", F.col("_all").cast("double")).drop("_before", "_all", "_length")
    # the end of one is the start of the next to the last bit, in another range too
    rows = stats.of_ranges(cut(rows), by, first=F.min("start"))
    end = F.coalesce(F.lead("start").over(w), F.col("_later_first"), F.col("total"))
    return rows.withColumn("end", end).select(*by, "item", "x0", "y0", "x1", "y1", "start", "end", "total")


def project(points: DataFrame, vertices: DataFrame, by: Sequence[str], order: str, x: str, y: str) -> DataFrame:
    """Each point's nearest place on its group's polyline: ``distance``, ``arc`` up to it, and signed ``offset``.

    The offset is positive to the left of the line's direction. Of equally near places the first along the line
    counts. All are null for points without a finite place, of a null group, or of a group without a line. Each
    point meets only segments of boxes that may be nearest, at any distance, so there is no reach to choose; one
    that is equally far from a whole line (the centre of a circle) meets all of it.
    """
    lines = cut(segments(vertices, by, order, x, y))
    met = _near_items(_places(points, by, x, y), lines, by)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    squared = dx * dx + dy * dy
    u = F.when(squared > 0, ((F.col("_px") - F.col("x0")) * dx + (F.col("_py") - F.col("y0")) * dy) / squared).otherwise(F.lit(0.0))
    met = met.withColumn("_u", F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)))
    at = lambda c, d: F.when(F.col("_u") >= 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0") + F.col("_u") * d)
    met = met.withColumn("_ox", F.col("_px") - at("x", dx)).withColumn("_oy", F.col("_py") - at("y", dy))
    length = F.sqrt(squared)
    offset = F.when(squared > 0, (dx * F.col("_oy") - dy * F.col("_ox")) / length).otherwise(F.col("_oy"))
    told = F.struct(F.hypot("_ox", "_oy").alias("distance"), "item", (F.col("start") + F.col("_u") * length).alias("arc"), offset.alias("offset"))
    best = met.groupBy(*by, "_px", "_py").agg(F.min(told).alias("_b")).select(*by, "_px", "_py", "_b.distance", "_b.arc", "_b.offset")
    return _told(points, best, by, x, y, "distance", "arc", "offset")


def resample(vertices: DataFrame, by: Sequence[str], order: str, x: str, y: str, n: int) -> DataFrame:
    """(by, step, arc, x, y): ``n`` points (two at least) at equal arc lengths along each polyline, its ends among them.

    A segment gives those that lie on it, so nothing is joined. A line without length gives its place ``n`` times.
    """
    n = max(n, 2)
    rows = segments(vertices, by, order, x, y)
    ends = rows.groupBy(*by).agg(F.max("item").alias("_last"))
    own = ends.select(*(F.col(c).alias(f"_of_{c}") for c in by), "_last")
    rows = rows.join(own, stats.same(by, "_of_"), "left") if by else rows.crossJoin(own)
    last = F.col("item") == F.col("_last")
    first = lambda c: F.when(F.col("total") > 0, F.least(F.ceil(F.col(c) * (n - 1) / F.col("total")), F.lit(n - 1))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("_lo", first("start")).withColumn("_hi", F.when(last, F.lit(n - 1)).otherwise(first("end") - 1))
    rows = rows.where("_lo <= _hi").withColumn("step", F.explode(F.sequence("_lo", "_hi"))).withColumn("arc", F.col("total") * F.col("step") / (n - 1))
    part = F.coalesce(F.try_divide(F.col("arc") - F.col("start"), F.col("end") - F.col("start")), F.lit(1.0))
    rows = rows.withColumn("_u", F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)))
    return rows.select(*by, "step", "arc", *(F.when(F.col("_u") >= 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0") + F.col("_u") * (F.col(f"{c}1") - F.col(f"{c}0"))).alias(n) for c, n in (("x", x), ("y", y))))


def _along_curve(marks: DataFrame, by: Sequence[str], label: str, x: str, y: str) -> DataFrame:
    """Marks numbered along a curve through the plane (interleaved bits of their places), as items without length."""
    rows = marks.select(*by, F.col(label).alias("_label"), F.col(x).cast("double").alias("x0"), F.col(y).cast("double").alias("y0")).where(_finite("x0", "y0"))
    box = rows.agg(F.min("x0"), F.max("x0"), F.min("y0"), F.max("y0")).first()
    bits = 24

    def spread(c: str, low: float | None, high: float | None) -> Column:
        whole = F.floor((F.col(c) - F.lit(low or 0.0)) / F.lit(((high or 0.0) - (low or 0.0)) or 1.0) * (2**bits - 1)).cast("long")
        return sum((F.shiftleft(F.shiftright(whole, i).bitwiseAND(F.lit(1).cast("long")), 2 * i) for i in range(bits)), F.lit(0).cast("long"))

    code = spread("x0", box[0], box[1]) + F.shiftleft(spread("y0", box[2], box[3]), 1)
    rows = stats.of_ranges(stats.in_ranges(rows.distinct().withColumn("_code", code), by, ["_code", "x0", "y0", "_label"]), by)
    number = F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_code", "x0", "y0", "_label")) - 1
    return rows.select(*by, number.alias("item"), "_label", "x0", "y0", F.col("x0").alias("x1"), F.col("y0").alias("y1"))


def nearest_mark(points: DataFrame, marks: DataFrame, by: Sequence[str], label: str, x: str, y: str) -> DataFrame:
    """Each point's ``distance`` to the nearest mark of its group, and that mark's label as ``nearest``.

    Of equally near marks the least label counts (nulls first). Nulls where a point has no finite place, its group
    is null, or no mark is there.
    """
    items = cut(_along_curve(marks, by, label, x, y))
    met = _near_by_tiles(cut(_places(points, by, x, y)), items, by)
    told = F.struct(F.hypot(F.col("_px") - F.col("x0"), F.col("_py") - F.col("y0")).alias("distance"), F.col("_label").alias("nearest"))
    best = met.groupBy(*by, "_px", "_py").agg(F.min(told).alias("_b")).select(*by, "_px", "_py", "_b.distance", "_b.nearest")
    return _told(points, best, by, x, y, "distance", "nearest")
