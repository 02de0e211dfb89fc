"""Binned profiles, histograms, densities and circular summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats


def _summary(value: str) -> list[Column]:
    """Mean, sd (0 for one value), standard error and count."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return [F.avg(value).alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n")]


def binned_profile(df: DataFrame, position: Column, value: str, width: float, by: Sequence[str]) -> DataFrame:
    """Mean, sd, sem and n of a value in bins of a position, for each group."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.floor(position / width).cast("long").alias("bin")).agg(*_summary(value))


def pooled(df: DataFrame, by: Sequence[str], n: str, mean: str, sd: str) -> DataFrame:
    """Pooled mean and sd from counts, means and sds of parts."""
    total, first = F.sum(n), F.sum(F.col(n) * F.col(mean))
    square = F.sum((F.col(n) - 1) * F.col(sd) * F.col(sd) + F.col(n) * F.col(mean) * F.col(mean))
    variance = F.greatest(F.try_divide(square - first * first / total, total - 1), F.lit(0.0))
    return df.groupBy(*by).agg(total.alias("n"), (first / total).alias("mean"), F.coalesce(F.sqrt(variance), F.lit(0.0)).alias("sd"))


def equal_support(df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int, position: str, value: str) -> DataFrame:
    """Bins of ``rows`` rows in order, for each group: their span, mean and count."""
    at = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / rows).cast("long")
    return df.withColumn("bin", at).groupBy(*by, "bin").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def in_intervals(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: float, slack: float = 1e-9) -> DataFrame:
    """Points joined to every interval that holds them, both ends included.

    Both sides are dealt by cells of ``width``: an interval goes to each cell it reaches, so the join
    is an equi-join and neither side needs to be small.
    """
    cell = lambda c: F.floor(c / width).cast("long")
    spread = intervals.withColumn("_cell", F.explode(F.sequence(cell(F.col(low) - slack), cell(F.col(high) + slack))))
    return points.withColumn("_cell", cell(F.col(at))).join(spread, "_cell").where((F.col(at) >= F.col(low) - slack) & (F.col(at) <= F.col(high) + slack)).drop("_cell")


def expand_ranges(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """A row for each whole number from start to end."""
    return df.withColumn(name, F.explode(F.sequence(F.col(start), F.col(end))))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins; the last holds its upper end, values outside are left out."""
    x = F.col(value)
    at = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return df.where((x >= low) & (x <= high)).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def otsu(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """The bin after which a histogram is best cut in two: the largest variance between classes."""
    up = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    n, s, total, sums = F.sum("n").over(up), F.sum(F.col("n") * F.col("bin")).over(up), F.sum("n").over(whole), F.sum(F.col("n") * F.col("bin")).over(whole)
    rows = hist.select(*by, "bin", n.alias("w0"), (total - n).alias("w1"), s.alias("s0"), (sums - s).alias("s1")).where("w1 > 0")
    gap = F.col("s0") / F.col("w0") - F.col("s1") / F.col("w1")
    rows = rows.withColumn("score", F.round(F.col("w0") * F.col("w1") * gap * gap, 3))
    return rows.groupBy(*by).agg(F.max_by("bin", F.struct("score", -F.col("bin"))).alias("cut"))


def histogram_quantile(hist: DataFrame, by: Sequence[str], q: float) -> DataFrame:
    """The first bin at which the running count reaches the share ``q``."""
    running = F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))
    rows = hist.withColumn("running", running).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    return rows.where(F.col("running") >= q * F.col("total")).groupBy(*by).agg(F.min("bin").alias("bin"))


def density_2d(df: DataFrame, x: Column, y: Column, by: Sequence[str], stack: str) -> DataFrame:
    """Counts and shares on a grid, pooled and with every stack weighing the same.

    ``balanced``: the mean over all stacks of a group of the cell's share in each; a stack without
    the cell counts as 0.
    """
    cells = df.groupBy(*by, stack, x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy(*by, stack).agg(F.sum("n").alias("size"))
    totals = sizes.groupBy(*by).agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("stacks"))
    grid = cells.join(sizes, [*by, stack]).groupBy(*by, "x", "y").agg(F.sum("n").alias("n"), F.sum(F.col("n") / F.col("size")).alias("shares"), F.count(F.lit(1)).alias("present"))
    return grid.join(totals, list(by)).select(*by, "x", "y", "n", "present", (F.col("n") / F.col("total")).alias("pooled"), (F.col("shares") / F.col("stacks")).alias("balanced"))


def quadrants(df: DataFrame, a: Column, b: Column, by: Sequence[str]) -> DataFrame:
    """Counts of the four outcomes of two tests, Jaccard index and conditional shares."""
    both, left, right, none = F.count_if(a & b), F.count_if(a & ~b), F.count_if(~a & b), F.count_if(~a & ~b)
    return df.groupBy(*by).agg(
        both.alias("both"), left.alias("only_a"), right.alias("only_b"), none.alias("neither"),
        F.try_divide(both, both + left + right).alias("jaccard"), F.try_divide(both, both + left).alias("b_given_a"), F.try_divide(both, both + right).alias("a_given_b"),
    )


def first_moment(df: DataFrame, degrees: Column, weight: Column, by: Sequence[str]) -> DataFrame:
    """Direction and strength of a weighted circular mean; weights under 0 count as 0."""
    w = F.greatest(weight, F.lit(0.0))
    s, c = F.sum(w * F.sin(F.radians(degrees))), F.sum(w * F.cos(F.radians(degrees)))
    return df.groupBy(*by).agg(F.degrees(F.atan2(s, c)).alias("direction"), F.try_divide(F.hypot(s, c), F.sum(w)).alias("strength"))


def bilaterality(df: DataFrame, side: Column, by: Sequence[str], dead: float = 0.5) -> DataFrame:
    """1 - abs(R - L) / (R + L) over rows outside the dead band."""
    r, left = F.count_if(side > dead), F.count_if(side < -dead)
    return df.groupBy(*by).agg(r.alias("right"), left.alias("left"), (1 - F.try_divide(F.abs(r - left), r + left)).alias("bilaterality"))


def trim_edges(df: DataFrame, by: Sequence[str], order: str, support: Column) -> DataFrame:
    """Rows from the first to the last that has support; poor rows between stay. Without any, all stay."""
    w = Window.partitionBy(*by).orderBy(order)
    ok = F.coalesce(support, F.lit(False)).cast("int")
    rows = df.withColumn("_from", F.max(ok).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_to", F.max(ok).over(w.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("_any", F.max(ok).over(Window.partitionBy(*by)))
    return rows.where("_any = 0 or (_from = 1 and _to = 1)").drop("_from", "_to", "_any")


def top_fraction(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, fraction: float) -> DataFrame:
    """Mean of the first ceil(n * fraction) rows of each group, at least one."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = df.withColumn("_rank", rank).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return rows.where(F.col("_rank") <= F.greatest(F.ceil(F.col("_n") * fraction), F.lit(1))).groupBy(*by).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def background(hist: DataFrame, by: Sequence[str], smooth: int, z: float, floor: float = 1.0) -> DataFrame:
    """Background level and spread of a histogram, and the threshold ``level + z * spread``.

    Counts are smoothed by a centred mean; the level is the fullest bin (the first among equals), and
    the spread comes from the bins at or left of it, as half of a Gaussian; it is at least ``floor``.
    """
    w = Window.partitionBy(*by).orderBy("bin")
    rows = hist.withColumn("_s", F.round(F.avg("n").over(w.rowsBetween(-smooth, smooth)), 6))
    mode = rows.groupBy(*by).agg(F.min_by("bin", F.struct(-F.col("_s"), F.col("bin"))).alias("level"))
    left = rows.join(mode, list(by)).where("bin <= level")
    second = F.sum(F.col("n") * (F.col("bin") - F.col("level")) * (F.col("bin") - F.col("level"))) / F.sum("n")
    spread = F.greatest(F.sqrt(second), F.lit(floor))
    return left.groupBy(*by, "level").agg(spread.alias("spread")).withColumn("threshold", F.col("level") + z * F.col("spread"))


def region_table(pixels: DataFrame, by: Sequence[str], label: str, x: str, y: str, value: str) -> DataFrame:
    """Area, centroid, mean and maximum of each labelled region of pixel rows; label 0 is background."""
    return pixels.where(F.col(label) != 0).groupBy(*by, label).agg(F.count(F.lit(1)).alias("area"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def illumination(pixels: DataFrame, frame: str, x: str, y: str, value: str) -> DataFrame:
    """The field of a stack: per frame over its median, then the median over frames at each pixel."""
    middle = stats.exact_quantile(pixels, [frame], value, 0.5, "_m")
    flat = pixels.join(middle, frame).select(x, y, F.try_divide(value, "_m").alias("_flat"))
    return stats.exact_quantile(flat, [x, y], "_flat", 0.5, "field")


def mask_overlap(pixels: DataFrame, by: Sequence[str], time: str, pixel: str) -> DataFrame:
    """Jaccard index and relative change of area between the masks of neighbouring times.

    A mask is one row per pixel it holds. Shared pixels come from each pixel's own next time, so no two
    masks are paired.
    """
    nxt = F.lead(time).over(Window.partitionBy(*by, pixel).orderBy(time))
    areas = pixels.groupBy(*by, time).agg(F.count(F.lit(1)).alias("area")).withColumn("next", F.lead(time).over(Window.partitionBy(*by).orderBy(time))).withColumn("next_area", F.lead("area").over(Window.partitionBy(*by).orderBy(time)))
    shared = pixels.withColumn("next", nxt).where("next is not null").groupBy(*by, time, "next").agg(F.count(F.lit(1)).alias("shared"))
    both = areas.where("next is not null").join(shared, [*by, time, "next"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return both.select(*by, time, "next", (F.col("shared") / (F.col("area") + F.col("next_area") - F.col("shared"))).alias("jaccard"), (F.col("next_area") / F.col("area") - 1).alias("growth"))
