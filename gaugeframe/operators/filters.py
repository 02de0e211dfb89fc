"""Row filters, ordering, keyed lookups and summaries of plain tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def spread_filter(moments: DataFrame, least_cv: float) -> DataFrame:
    """Features whose sd over mean is above a cut; a mean of 0 or less fails."""
    return moments.withColumn("cv", F.when(F.col("mean") > 0, F.col("sd") / F.col("mean"))).where(F.col("cv") > least_cv)


def expressed(means: DataFrame, feature: str, mean: str, least: float) -> DataFrame:
    """Features without those whose mean is under ``least`` in every group."""
    return means.groupBy(feature).agg(F.max(mean).alias("highest")).where(F.col("highest") >= least)


def in_either(df: DataFrame, keys: Sequence[str], wanted: DataFrame, name: str) -> DataFrame:
    """Rows of which any key is a wanted name, whatever the case."""
    names = wanted.select(F.lower(name).alias("_name")).where("_name is not null").distinct()
    hit, found = F.lit(False), df
    for k in keys:
        found = found.join(names.select(F.col("_name").alias(f"_is_{k}")), F.lower(F.col(k)) == F.col(f"_is_{k}"), "left")
        hit = hit | F.col(f"_is_{k}").isNotNull()
    return found.where(hit).select(*df.columns)


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in order; over a whole table, Spark's own top-n."""
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the first in order: a grouped minimum, no sort of groups."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return best.select(*keys, *(F.col(f"_first.{c}").alias(c) for c in rest)).select(*df.columns)


def display_rank(label: Column, published: Sequence[str]) -> Column:
    """Sort key: published labels in their order, then others by name."""
    place = F.array_position(F.array(*map(F.lit, published)), label)
    return F.struct(F.when(place > 0, place).otherwise(len(published) + 1).alias("place"), label.alias("name"))


def star_join(fact: DataFrame, dimensions: Sequence[tuple[DataFrame, Mapping[str, str], Sequence[str]]]) -> DataFrame:
    """Left joins of a fact table to dimensions in turn: (dimension, {its key: the fact's key}, columns to take)."""
    for dimension, keys, columns in dimensions:
        other = dimension.select(*(F.col(own).alias(theirs) for own, theirs in keys.items()), *columns)
        fact = fact.join(other, list(keys.values()), "left")
    return fact


def only_match(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows joined to the one row of ``names`` with their key; a key found twice or not at all is flagged, not joined."""
    once = names.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[c for c in names.columns if c != key])).alias("_row"))
    found = df.join(once, key, "left")
    one = F.col("_n") == 1
    columns = [F.when(one, F.col(f"_row.{c}")).alias(c) for c in names.columns if c != key]
    return found.select(*df.columns, *columns, F.when(F.col("_n").isNull(), "missing").when(one, "found").otherwise("ambiguous").alias("match"))


def reindexed(df: DataFrame, key: str, wanted: DataFrame, place: str) -> DataFrame:
    """Rows of ``df`` at the places of the wanted keys; a key that isn't there gives a row with ``absent`` set."""
    own = df.withColumn("_here", F.lit(True))
    return wanted.select(place, key).join(own, key, "left").withColumn("absent", F.col("_here").isNull()).drop("_here")


def end_points(df: DataFrame, by: Sequence[str], time: str, start: float, end: float, value: str) -> DataFrame:
    """Values at two times of each entity side by side, and their difference; both must be there."""
    at = lambda t: F.max(F.when(F.col(time) == t, F.col(value)))
    both = df.where(F.col(time).isin(start, end)).groupBy(*by).agg(at(start).alias("start"), at(end).alias("end"))
    return both.where("start is not null and end is not null").withColumn("change", F.col("end") - F.col("start"))


def pairs_by_name(df: DataFrame, by: Sequence[str], name: str, value: str) -> DataFrame:
    """Differences between each two named values of a group; names are few, so pairs come from one array."""
    held = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(value).alias("v")))).alias("_held"))
    pairs = F.flatten(F.transform("_held", lambda p, i: F.transform(F.slice("_held", i + 2, F.size("_held")), lambda q: F.struct(p["n"].alias("one"), q["n"].alias("other"), (q["v"] - p["v"]).alias("difference")))))
    return held.select(*by, F.inline(pairs))


def summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, median, sd, standard error, quartiles and count of the finite values."""
    x = F.when(F.abs(value) < float("inf"), F.col(value))
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), q.alias("_q"), F.count(x).alias("n"))
    return rows.select(*by, "mean", F.col("_q")[1].alias("median"), "sd", (F.col("sd") / F.sqrt("n")).alias("sem"), F.col("_q")[0].alias("q25"), F.col("_q")[2].alias("q75"), "n")


def rates(df: DataFrame, by: Sequence[str], unit: str, hit: Column) -> DataFrame:
    """The rate over all rows (micro) and the mean of the units' own rates (macro)."""
    units = df.groupBy(*by, unit).agg(F.count_if(hit).alias("_h"), F.count(F.lit(1)).alias("_n"))
    return units.groupBy(*by).agg((F.sum("_h") / F.sum("_n")).alias("micro"), F.avg(F.col("_h") / F.col("_n")).alias("macro"), F.count(F.lit(1)).alias("units"))


def item_counts(df: DataFrame, id_col: str, items: Column, name: str = "item") -> DataFrame:
    """How often each item occurs over all lists, and in how many; a list is what one id has."""
    own = df.select(F.col(id_col).alias("_id"), F.explode(items).alias(name)).groupBy("_id", name).agg(F.count(F.lit(1)).alias("_k"))
    return own.groupBy(name).agg(F.sum("_k").alias("times"), F.count(F.lit(1)).alias("lists"))


def above_own_quantile(df: DataFrame, by: Sequence[str], value: str, q: float) -> DataFrame:
    """Each row with its group's quantile of the value, and whether it lies above."""
    cut = df.groupBy(*by).agg(F.percentile(value, q).alias("threshold"))
    return df.join(cut, list(by), "left").withColumn("above", F.col(value) > F.col("threshold"))


def residual_rank(df: DataFrame, by: Sequence[str], x: str, y: str, q: float) -> DataFrame:
    """Rows whose distance from their group's line is beyond the group's quantile of distances."""
    # written once: summed again in another order it could put the row at the quantile above it
    fit = cut(df.groupBy(*by).agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i")))
    off = df.join(fit, list(by)).withColumn("residual", F.col(y) - F.col("_i") - F.col("_s") * F.col(x)).drop("_s", "_i")
    return above_own_quantile(off.withColumn("_d", F.abs("residual")), by, "_d", q).where("above").drop("_d", "threshold", "above")


def time_sample(df: DataFrame, by: Sequence[str], stratum: Column, id_col: str, n: int, seed: int = 7) -> DataFrame:
    """n rows from each stretch of time of each group, by a seeded hash of the id."""
    w = Window.partitionBy(*by, "stratum").orderBy(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), id_col)
    return df.withColumn("stratum", stratum).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def cut_at_events(df: DataFrame, cuts: DataFrame, key: str, time: str, cut: str) -> DataFrame:
    """Rows before their key's cut; keys without one stay whole."""
    rows = df.join(cuts.select(key, F.col(cut).alias("_cut")), key, "left")
    return rows.where(F.col("_cut").isNull() | (F.col(time) < F.col("_cut"))).drop("_cut")


def supported(profile: DataFrame, n: str, least: int, low: Column, high: Column) -> DataFrame:
    """Bins with enough support; edge bins, outside low to high, are left to ``trim_edges``."""
    return profile.where((F.col(n) >= least) | ~F.col("bin").between(low, high))


def relative_change(df: DataFrame, by: Sequence[str], t: str, y: str, k: int) -> DataFrame:
    """(y - baseline) / baseline with the median of each entity's first k rows; null for a baseline of 0."""
    rows = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(t)))
    base = rows.where(F.col("_k") <= k).groupBy(*by).agg(F.median(y).alias("baseline"))
    return rows.drop("_k").join(base, list(by)).withColumn("relative", F.try_divide(F.col(y) - F.col("baseline"), F.col("baseline")))
