"""Ordered operators for one series per entity: ``by`` names the entity, ``t`` the time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import SMALL, largest, placed, same


def _w(by: Sequence[str], t: str) -> Window:
    return Window.partitionBy(*by).orderBy(t)


def rolling_mean(df: DataFrame, by: Sequence[str], t: str, y: str, width: int) -> DataFrame:
    """Centred mean of ``width`` rows, fewer at the ends; of an even width the extra row is before."""
    return df.withColumn("smooth", F.avg(y).over(_w(by, t).rowsBetween(-(width // 2), (width - 1) // 2)))


def rolling_median(df: DataFrame, by: Sequence[str], t: str, y: str, width: int, least: int) -> DataFrame:
    """Centred median of ``width`` rows; null where fewer than ``least`` values are there."""
    values = F.array_sort(F.collect_list(y).over(_w(by, t).rowsBetween(-(width // 2), (width - 1) // 2)))
    df = df.withColumn("_v", values)
    n = F.size("_v")
    middle = (F.get("_v", F.floor((n - 1) / 2).cast("int")) + F.get("_v", F.floor(n / 2).cast("int"))) / 2
    return df.withColumn("median", F.when(n >= least, middle)).drop("_v")


def gradient(df: DataFrame, by: Sequence[str], t: str, y: str) -> DataFrame:
    """Slope at each row: second order inside for uneven steps, one-sided at the ends."""
    w = _w(by, t)
    hs, hd = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    before, after, f = F.lag(y).over(w), F.lead(y).over(w), F.col(y)
    inside = F.try_divide(hs * hs * after + (hd * hd - hs * hs) * f - hd * hd * before, hs * hd * (hs + hd))
    return df.withColumn("slope", F.when(hs.isNull(), F.try_divide(after - f, hd)).when(hd.isNull(), F.try_divide(f - before, hs)).otherwise(inside))


def velocity(df: DataFrame, by: Sequence[str], t: str, y: str) -> DataFrame:
    """Segments between neighbours: midpoint and change over time; steps of no time are left out."""
    w = _w(by, t)
    rows = df.select(*by, F.col(t).alias("t0"), F.lead(t).over(w).alias("t1"), F.col(y).alias("y0"), F.lead(y).over(w).alias("y1")).where("t1 > t0")
    return rows.select(*by, ((F.col("t0") + F.col("t1")) / 2).alias("mid"), ((F.col("y1") - F.col("y0")) / (F.col("t1") - F.col("t0"))).alias("velocity"))


def normalise(df: DataFrame, by: Sequence[str], t: str, y: str, first: int) -> DataFrame:
    """(y - baseline) / (peak - baseline): baseline is the median of the first rows; null if not above it."""
    rows = df.withColumn("_k", F.row_number().over(_w(by, t)))
    stats = rows.groupBy(*by).agg(F.median(F.when(F.col("_k") <= first, F.col(y))).alias("baseline"), F.max(y).alias("peak"))
    scaled = F.when(F.col("peak") > F.col("baseline"), (F.col(y) - F.col("baseline")) / (F.col("peak") - F.col("baseline")))
    return rows.join(stats, list(by)).withColumn("scaled", scaled).drop("_k")


def crossing(df: DataFrame, by: Sequence[str], t: str, y: str, level: float, least: int = 1) -> DataFrame:
    """First time a series reaches a level, by straight lines between rows; null if never or too short.

    At the first row it is that row's time; a flat step gives the later time.
    """
    w = _w(by, t)
    rows = df.where(F.col(y).isNotNull()).select(*by, F.col(t).alias("t1"), F.col(y).alias("y1"), F.lag(t).over(w).alias("t0"), F.lag(y).over(w).alias("y0"))
    step = F.col("y1") - F.col("y0")
    at = F.when(F.col("t0").isNull() | (F.abs(step) < 1e-12), F.col("t1")).otherwise(F.col("t0") + (level - F.col("y0")) * (F.col("t1") - F.col("t0")) / step)
    hit = rows.withColumn("_at", at)
    return hit.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= least, F.min_by(F.when(F.col("y1") >= level, F.col("_at")), F.when(F.col("y1") >= level, F.col("t1")))).alias("crossing"))


def half_max(df: DataFrame, by: Sequence[str], t: str, y: str, first: int = 3, least: int = 12) -> DataFrame:
    """When a series first reaches half of its rise above the baseline."""
    return crossing(normalise(df, by, t, y, first), by, t, "scaled", 0.5, least)


def onset(df: DataFrame, by: Sequence[str], index: str, flag: Column, run: int) -> DataFrame:
    """First index that starts ``run`` true rows with consecutive indexes; null if none."""
    w = _w(by, index)
    ok = F.min(flag.cast("int")).over(w.rowsBetween(0, run - 1))
    rows = df.withColumn("_ok", ok).withColumn("_end", F.lead(index, run - 1).over(w) if run > 1 else F.col(index))
    return rows.groupBy(*by).agg(F.min(F.when((F.col("_ok") == 1) & (F.col("_end") == F.col(index) + run - 1), F.col(index))).alias("onset"))


def longest_run(df: DataFrame, by: Sequence[str], t: str, flag: Column) -> DataFrame:
    """The longest run of true rows, the first among equals: length, start and end; groups without any have none."""
    rows = df.withColumn("_f", flag).withColumn("_all", F.row_number().over(_w(by, t)))
    rows = rows.where("_f").withColumn("_island", F.col("_all") - F.row_number().over(_w(by, t)))
    runs = rows.groupBy(*by, "_island").agg(F.count(F.lit(1)).alias("length"), F.min(t).alias("start"), F.max(t).alias("end"))
    return runs.groupBy(*by).agg(F.max(F.struct("length", (-F.col("start")).alias("_s"), "start", "end")).alias("r")).select(*by, "r.length", "r.start", "r.end")


def interpolate(df: DataFrame, by: Sequence[str], t: str, y: str, grid: DataFrame, at: str) -> DataFrame:
    """Values on each entity's grid times, by straight lines; null outside the series.

    Series and grid are laid in one window, which finds the rows before and after each grid time.
    """
    point = F.struct(F.col(t).alias("t"), F.col(y).alias("y"))
    rows = df.where(F.col(y).isNotNull()).select(*by, F.col(t).cast("double").alias("_t"), point.alias("_p"), F.lit(0).alias("_g"))
    asks = grid.select(*by, F.col(at).cast("double").alias("_t"), F.lit(None).cast(rows.schema["_p"].dataType).alias("_p"), F.lit(1).alias("_g"))
    w = Window.partitionBy(*by).orderBy("_t", "_g")
    both = rows.unionByName(asks).withColumn("_a", F.last("_p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_b", F.when(F.col("_a.t") == F.col("_t"), F.col("_a")).otherwise(F.first("_p", True).over(w.rowsBetween(0, Window.unboundedFollowing)))).where("_g = 1")
    line = F.when(F.col("_a.t") == F.col("_b.t"), F.col("_a.y")).otherwise(F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * (F.col("_t") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t")))
    return both.select(*by, F.col("_t").alias(at), line.alias(y))


def align(df: DataFrame, by: Sequence[str], t: str, y: str, events: DataFrame, event: str, low: float, high: float, step: float) -> DataFrame:
    """Series re-anchored to an event time and read off a grid; series that don't cover it are left out."""
    moved = df.join(events.where(F.col(event).isNotNull()), list(by)).withColumn("_rel", F.col(t) - F.col(event))
    covered = moved.where(F.col(y).isNotNull()).groupBy(*by).agg(F.min("_rel").alias("_lo"), F.max("_rel").alias("_hi")).where((F.col("_lo") <= low) & (F.col("_hi") >= high)).select(*by)
    steps = F.transform(F.sequence(F.lit(0), F.lit(round((high - low) / step))), lambda i: low + i * step)
    grid = covered.withColumn("at", F.explode(steps))
    return interpolate(moved.join(covered, list(by), "left_semi").drop(t).withColumnRenamed("_rel", t), by, t, y, grid, "at")


def ends_summary(df: DataFrame, by: Sequence[str], t: str, y: str, k: int) -> DataFrame:
    """Medians of the first and the last k rows, the maximum, and when it first comes."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_up", F.row_number().over(w.orderBy(t))).withColumn("_down", F.row_number().over(w.orderBy(F.desc(t))))
    return rows.groupBy(*by).agg(
        F.median(F.when(F.col("_up") <= k, F.col(y))).alias("early"), F.median(F.when(F.col("_down") <= k, F.col(y))).alias("late"),
        F.max(y).alias("peak"), F.min_by(t, F.struct(-F.col(y), F.col(t))).alias("peak_time"),
    )


def step_summary(df: DataFrame, by: Sequence[str], t: str, y: str) -> DataFrame:
    """Largest step, net change, and the share of steps in the direction of the net change."""
    w = _w(by, t)
    rows = df.withColumn("_d", F.col(y) - F.lag(y).over(w)).withColumn("_net", F.last(y).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.first(y).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.groupBy(*by).agg(F.max(F.abs("_d")).alias("max_step"), F.first("_net").alias("net"), F.avg((F.signum("_d") == F.signum("_net")).cast("double")).alias("consistency"))


def population_z(df: DataFrame, entity: Sequence[str], group: Sequence[str], y: str) -> DataFrame:
    """Robust z against the group's median and MAD at the same place."""
    middle = df.groupBy(*group).agg(F.median(y).alias("_m"))
    off = df.join(middle, list(group)).withColumn("_off", F.col(y) - F.col("_m"))
    spread = off.groupBy(*group).agg((1.4826 * F.median(F.abs("_off"))).alias("_s"))
    return off.join(spread, list(group)).select(*entity, *[g for g in group if g not in entity], F.try_divide("_off", "_s").alias("z"))


def completeness(df: DataFrame, by: Sequence[str], t: str, expected: int) -> DataFrame:
    """Distinct times seen, missing out of ``expected``, and rows that repeat a time."""
    seen = F.count_distinct(t)
    return df.groupBy(*by).agg(seen.alias("seen"), (F.lit(expected).cast("long") - seen).alias("missing"), (F.count(F.lit(1)) - seen).alias("repeated"))


def ecdf(df: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    """Each row's share of its group's values that are no larger; null values are left out."""
    rows = df.where(F.col(y).isNotNull())
    if largest(rows, by) <= SMALL:
        return rows.withColumn("share", F.cume_dist().over(Window.partitionBy(*by).orderBy(y)))
    places = placed(rows, by, y)
    share = places.select(*(F.col(c).alias(f"_of_{c}") for c in [*by, y]), ((F.col("_before") + F.col("_n")) / F.col("_all")).alias("share"))
    return rows.join(share, same([*by, y], "_of_")).select(*df.columns, "share")


def split_scan(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """The cut after which a line to the left and a constant to the right fit best (least squares).

    Running sums give both errors in closed form. Cuts leave ``least`` rows or more on either side.
    """
    up = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(x).rowsBetween(1, Window.unboundedFollowing)
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.select(
        *by, F.col(x).alias("cut"), F.count(F.lit(1)).over(up).alias("n"), F.sum(cx).over(up).alias("sx"), F.sum(cy).over(up).alias("sy"), F.sum(cx * cx).over(up).alias("sxx"), F.sum(cx * cy).over(up).alias("sxy"), F.sum(cy * cy).over(up).alias("syy"),
        F.count(F.lit(1)).over(down).alias("m"), F.sum(cy).over(down).alias("ry"), F.sum(cy * cy).over(down).alias("ryy"),
    ).where((F.col("n") >= least) & (F.col("m") >= least))
    xx, xy, yy = (F.col(s) - F.col(a) * F.col(b) / F.col("n") for s, a, b in (("sxx", "sx", "sx"), ("sxy", "sx", "sy"), ("syy", "sy", "sy")))
    slope = F.try_divide(xy, xx)
    error = F.round(yy - F.coalesce(slope * xy, F.lit(0.0)) + F.col("ryy") - F.col("ry") * F.col("ry") / F.col("m"), 3)
    best = rows.withColumn("slope", slope).withColumn("sse", error)
    return best.groupBy(*by).agg(F.min(F.struct("sse", "cut", "slope")).alias("b")).select(*by, "b.cut", "b.slope", "b.sse")


def centred_slope(df: DataFrame, by: Sequence[str], t: str, y: str, width: float) -> DataFrame:
    """(y(t + w/2) - y(t - w/2)) / w with both ends on straight lines; null where an end is outside."""
    ends = df.select(*by, F.col(t).alias("at"), F.explode(F.array(F.lit(-0.5 * width), F.lit(0.5 * width))).alias("_d"))
    grid = ends.select(*by, (F.col("at") + F.col("_d")).alias("end"), "at", "_d")
    values = interpolate(df, by, t, y, grid.select(*by, "end"), "end").groupBy(*by, "end").agg(F.max(y).alias("_y"))
    both = grid.join(values, [*by, "end"], "left")
    side = lambda s: F.max(F.when(F.col("_d") == s * 0.5 * width, F.col("_y")))
    return both.groupBy(*by, "at").agg(((side(1) - side(-1)) / width).alias("slope")).withColumnRenamed("at", t)


def blocked_error(df: DataFrame, by: Sequence[str], t: str, y: str, folds: int) -> DataFrame:
    """Root mean square error of a straight line, each contiguous fold predicted from the others.

    A fold's line comes from the whole's sums less its own, so one pass serves all folds.
    """
    w = Window.partitionBy(*by)
    rows = df.where(F.col(t).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(t).cast("double").alias("x"), F.col(y).cast("double").alias("v"))
    rows = rows.withColumn("fold", F.least(F.floor((F.row_number().over(w.orderBy("x", "v")) - 1) * folds / F.count(F.lit(1)).over(w)), F.lit(folds - 1)))
    sums = lambda c: [F.sum(F.lit(1.0)).alias(f"n{c}"), F.sum("x").alias(f"x{c}"), F.sum("v").alias(f"v{c}"), F.sum(F.col("x") * F.col("x")).alias(f"xx{c}"), F.sum(F.col("x") * F.col("v")).alias(f"xv{c}")]
    rest = rows.groupBy(*by, "fold").agg(*sums("f")).join(rows.groupBy(*by).agg(*sums("a")), list(by))
    n, x, v, xx, xv = (F.col(f"{c}a") - F.col(f"{c}f") for c in ("n", "x", "v", "xx", "xv"))
    slope = F.try_divide(n * xv - x * v, n * xx - x * x)
    lines = rest.select(*by, "fold", slope.alias("slope"), F.try_divide(v - slope * x, n).alias("start"))
    off = F.col("v") - F.col("start") - F.col("slope") * F.col("x")
    return rows.join(lines, [*by, "fold"]).groupBy(*by).agg(F.sqrt(F.avg(off * off)).alias("rmse"))
