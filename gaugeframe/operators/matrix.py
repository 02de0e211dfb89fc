"""Sparse matrices in long form: (row, feature, value) triples in which zeros are left out.

Counts of rows come from the table of rows, never from the triples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import stats


def row_metrics(x: DataFrame, row: str, value: str, flags: dict[str, Column]) -> DataFrame:
    """Total, features above 0, and for each flag the percentage of the total in flagged features."""
    total = F.sum(value)
    shares = [F.try_divide(100.0 * F.sum(F.when(flag, F.col(value)).otherwise(0.0)), total).alias(name) for name, flag in flags.items()]
    return x.groupBy(row).agg(total.alias("total"), F.count_if(F.col(value) > 0).alias("n_features"), *shares)


def audit(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """How many rows fail each test (a row may fail several), and how many pass all."""
    every = None
    for test in tests.values():
        every = test if every is None else every & test
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(every).alias("passed"), *(F.count_if(~test).alias(f"failed_{name}") for name, test in tests.items()))


def feature_moments(x: DataFrame, rows: DataFrame, feature: str, value: str) -> DataFrame:
    """For each feature: values that aren't 0, mean and population sd over all rows."""
    n = rows.agg(F.count(F.lit(1)).alias("rows"))
    sums = x.groupBy(feature).agg(F.count_if(F.col(value) != 0).alias("nnz"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    mean = F.col("s") / F.col("rows")
    sd = F.sqrt(F.greatest(F.col("ss") / F.col("rows") - mean * mean, F.lit(0.0)))
    return sums.crossJoin(F.broadcast(n)).select(feature, "nnz", mean.alias("mean"), sd.alias("sd"))  # one row on the right


def feature_filter(x: DataFrame, rows: DataFrame, feature: str, value: str, mean_cut: float, sd_cut: float, any_value: bool = True) -> DataFrame:
    """Features with any value (unless that isn't asked), and mean and sd strictly above the cuts."""
    held = (F.col("nnz") > 0) if any_value else F.lit(True)
    return feature_moments(x, rows, feature, value).where(held & (F.col("mean") > mean_cut) & (F.col("sd") > sd_cut))


def unit_variance(x: DataFrame, rows: DataFrame, feature: str, value: str) -> DataFrame:
    """Values over their feature's population sd, not centred; a feature of sd 0 stays as it is."""
    sd = feature_moments(x, rows, feature, value).select(feature, F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")).alias("_sd"))
    return x.join(sd, feature).withColumn(value, F.col(value) / F.col("_sd")).drop("_sd")


def normalize_total(x: DataFrame, row: str, value: str) -> DataFrame:
    """Each row scaled to the median of the row totals."""
    totals = x.groupBy(row).agg(F.sum(value).alias("_total"))
    target = stats.exact_quantile(totals, [], "_total", 0.5, "_target")
    scale = totals.crossJoin(F.broadcast(target)).select(row, F.try_divide("_target", "_total").alias("_scale"))  # one row on the right
    return x.join(scale, row).withColumn(value, F.col(value) * F.col("_scale")).drop("_scale")


def group_means(x: DataFrame, labels: DataFrame, row: str, feature: str, value: str, label: str) -> DataFrame:
    """Mean of each feature over all rows of a label, absent values being 0, and the share above 0.

    Every label meets every feature; rows without a label are left out.
    """
    labels = labels.where(F.col(label).isNotNull())
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    sums = x.join(labels.select(row, label), row).groupBy(label, feature).agg(F.sum(value).alias("_s"), F.count_if(F.col(value) > 0).alias("_p"))
    grid = sizes.crossJoin(x.select(feature).distinct())  # the result's own size: labels times features
    full = grid.join(sums, [label, feature], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return full.select(label, feature, (zero("_s") / F.col("_n")).alias("mean"), (zero("_p") / F.col("_n")).alias("fraction"))


def feature_correlations(x: DataFrame, rows: DataFrame, row: str, feature: str, value: str) -> DataFrame:
    """Pearson correlation of each two features over all rows, absent values being 0.

    Products come from rows that hold both, each row giving the pairs of its own features; for a pair
    that no row holds they are 0. Meant for a chosen set of features: the result has all their pairs.
    """
    m = feature_moments(x, rows, feature, value).where("sd > 0").select(feature, "mean", "sd")
    own = x.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(F.col(feature).alias("f"), F.col(value).cast("double").alias("v")))).alias("_held"))
    pairs = F.flatten(F.transform("_held", lambda p, i: F.transform(F.slice("_held", i + 2, F.size("_held")), lambda q: F.struct(p["f"].alias("a"), q["f"].alias("b"), (p["v"] * q["v"]).alias("s")))))
    products = own.select(F.inline(pairs)).groupBy("a", "b").agg(F.sum("s").alias("s"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    side = lambda name: m.select(F.col(feature).alias(name), F.col("mean").alias(f"m{name}"), F.col("sd").alias(f"s{name}"))
    grid = side("a").join(side("b"), F.col("a") < F.col("b"))  # the result's own size
    full = grid.join(products, ["a", "b"], "left").crossJoin(F.broadcast(n))  # one row on the right
    return full.select("a", "b", ((F.coalesce("s", F.lit(0.0)) / F.col("n") - F.col("ma") * F.col("mb")) / (F.col("sa") * F.col("sb"))).alias("r"))


def profile_correlations(one: DataFrame, other: DataFrame, label: str, feature: str, value: str) -> DataFrame:
    """Pearson correlation of each profile of one table with each of another over shared features."""
    a = one.select(F.col(label).alias("a"), feature, F.col(value).alias("va"))
    b = other.select(F.col(label).alias("b"), feature, F.col(value).alias("vb"))
    return a.join(b, feature).groupBy("a", "b").agg(F.corr("va", "vb").alias("r"), F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of label pairs in long form, with each pair's share of its row and of its column."""
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    share = lambda by: F.col("n") / F.sum("n").over(Window.partitionBy(by))
    return counts.select(a, b, "n", share(a).alias("row_share"), share(b).alias("column_share"))


def mode_share(df: DataFrame, by: str, label: str) -> DataFrame:
    """The most frequent label of each group and its share; ties go to the first label."""
    counts = df.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("mode"), (F.max("n") / F.sum("n")).alias("share"))


def rollup_levels(df: DataFrame, levels: Sequence[str], counts: Sequence[str], ratio: tuple[str, str]) -> DataFrame:
    """Sums at every level of a hierarchy in one table, the ratio being taken from the sums.

    ``level`` is the number of leading columns that are set; 0 is the total.
    """
    sums = df.rollup(*levels).agg(F.grouping_id().alias("_g"), *(F.sum(c).alias(c) for c in counts))
    level = sum(((F.shiftright(F.col("_g"), i).bitwiseAND(F.lit(1)) == 0).cast("int") for i in range(len(levels))), F.lit(0)).cast("long")
    return sums.select(level.alias("level"), *levels, *counts, F.try_divide(ratio[0], ratio[1]).alias("ratio"))


def nested_median(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str, least: int) -> DataFrame:
    """Median over inner groups of their medians; groups of fewer than ``least`` values are left out."""
    held = df.where(F.col(value).isNotNull())
    if (most := stats.largest(held, inner)) <= stats.SMALL:
        one = held.groupBy(*inner).agg(F.percentile(F.col(value).cast("double"), 0.5).alias("m"), F.count(F.lit(1)).alias("n"))
    else:
        sizes = held.groupBy(*(F.col(c).alias(f"_of_{c}") for c in inner)).agg(F.count(F.lit(1)).alias("n"))
        one = stats.exact_quantile(held, inner, value, 0.5, "m", most).join(sizes, stats.same(inner, "_of_")).select(*inner, "m", "n")
    one = cut(one.where(F.col("n") >= least))
    sizes = one.groupBy(*(F.col(c).alias(f"_of_{c}") for c in outer)).agg(F.count(F.lit(1)).alias("n_groups"))
    return stats.exact_quantile(one, outer, "m", 0.5, "median").join(sizes, stats.same(outer, "_of_")).select(*outer, "median", "n_groups")


def robust_sigma(df: DataFrame, by: Sequence[str], value: str, floor: float) -> DataFrame:
    """Median and 1.4826 times the median absolute deviation, at least ``floor``."""
    most = stats.largest(df, by)
    middle = cut(stats.exact_quantile(df, by, value, 0.5, "median", most))
    off = df.join(middle, list(by)).withColumn("_off", F.abs(F.col(value) - F.col("median")))
    spread = stats.exact_quantile(off, by, "_off", 0.5, "_mad", most)
    return middle.join(spread, list(by)).select(*by, "median", F.greatest(1.4826 * F.col("_mad"), F.lit(floor)).alias("sigma"))


def set_scores(x: DataFrame, members: DataFrame, row: str, feature: str, value: str) -> DataFrame:
    """Mean z-score (population sd over the rows that hold the feature) of each row over each set."""
    w = Window.partitionBy(feature)
    z = F.coalesce(F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w)), F.lit(0.0))
    return x.withColumn("_z", z).join(members, feature).groupBy(row, "set").agg(F.avg("_z").alias("score"))


def row_zscores(x: DataFrame, row: str, value: str) -> DataFrame:
    """z-scores within each row (sample sd); a constant row gives 0."""
    w = Window.partitionBy(row)
    return x.withColumn("z", F.coalesce(F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w)), F.lit(0.0)))
