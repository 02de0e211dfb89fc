"""Statistics: closed forms from moments, adjustments, ranks and resampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import f_upper, fit_logistic4, nonnegative_fit, t_two_sided
from ..session import cut


def welch(df: DataFrame, by: Sequence[str], in_a: Column, in_b: Column, value: str) -> DataFrame:
    """Welch's t, its degrees of freedom and the difference of means, from one pass of moments."""
    a, b = F.when(in_a, F.col(value)), F.when(in_b, F.col(value))
    m = df.groupBy(*by).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    ea, eb = F.try_divide("va", "na"), F.try_divide("vb", "nb")
    df_ = F.try_divide((ea + eb) * (ea + eb), F.try_divide(ea * ea, F.col("na") - 1) + F.try_divide(eb * eb, F.col("nb") - 1))
    return m.select(*by, (F.col("ma") - F.col("mb")).alias("difference"), F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(ea + eb)).alias("t"), df_.alias("df"))


def anova(df: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """One-way F and both degrees of freedom from group moments."""
    g = df.groupBy(*by, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v")).where("n > 0")
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - grand * grand * F.sum("n")
    within, k, n = F.sum((F.col("n") - 1) * F.col("v")), F.count(F.lit(1)), F.sum("n")
    return g.groupBy(*by).agg(F.try_divide(F.try_divide(between, k - 1), F.try_divide(within, n - k)).alias("f"), (k - 1).alias("df1"), (n - k).alias("df2"))


def with_p(df: DataFrame, statistic: str, dfs: Sequence[str], kind: str) -> DataFrame:
    """A column ``p``: two-sided for ``t`` with one df, upper tail for ``f`` with two."""
    @F.pandas_udf("double")
    def p(s: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        tail = (lambda x, a, b: t_two_sided(x, a)) if kind == "t" else f_upper
        return pd.Series([tail(x, a, b) if np.isfinite([x, a, b]).all() else None for x, a, b in zip(s.astype(float), d1.astype(float), d2.astype(float))], dtype="float64")

    return df.withColumn("p", p(F.col(statistic).cast("double"), F.col(dfs[0]).cast("double"), F.col(dfs[-1]).cast("double")))


#: Groups of up to as many rows are ordered in one task each.
SMALL = 100_000
#: Groups of up to as many rows have a quantile aggregated: a task holds the values of up to 128 of them, boxed.
HELD = 10_000


def largest(df: DataFrame, by: Sequence[str]) -> int:
    """How many rows the largest group has: one aggregation, of which a number reaches the driver."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows")).first()[0] or 0


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` written in ranges of group and order, with a column ``_range`` that grows with the order.

    A large group is spread over many ranges, and what lies in earlier ones is added from figures of ranges
    (``of_ranges``). Rows of equal order are in one range. It is read back as often as needed: ``df`` itself is read
    for the sample that the ranges are drawn from, and once more to be written.
    """
    return cut(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))


def same(by: Sequence[str], prefix: str) -> Column:
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(prefix + c))
    return on


def of_ranges(df: DataFrame, by: Sequence[str], weight: Column | None = None, **totals: Column) -> DataFrame:
    """``df`` with a group's range-level figures joined on: one row a range, windows over these only.

    ``_before`` and ``_all``: rows, or sums of ``weight``, in earlier ranges and in all.
    """
    w = Window.partitionBy(*by).orderBy("_range")
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    rows = df.groupBy(*by, "_range").agg(size.alias("_size"), *(c.alias(f"_{name}") for name, c in totals.items()))
    earlier, later = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    figures = [F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(*by)).alias("_all")]
    figures += [F.min(f"_{n}").over(later).alias(f"_later_{n}") for n in totals] + [F.max(f"_{n}").over(earlier).alias(f"_earlier_{n}") for n in totals]
    small = rows.select(*(F.col(c).alias(f"_of_{c}") for c in [*by, "_range"]), *figures)
    return df.join(small, same([*by, "_range"], "_of_"), "left").drop(*(f"_of_{c}" for c in [*by, "_range"]))


def in_tied_order(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """``_upto`` and ``_all``: how many rows with the flag a group has up to a row without it, and in all."""
    rows = of_ranges(in_ranges(df.withColumn("_flag", flag.cast("long")), by, order), by, F.col("_flag"))
    return rows.withColumn("_upto", F.col("_before") + F.sum("_flag").over(Window.partitionBy(*by, "_range").orderBy(*order))).drop("_flag", "_before", "_range")


def placed(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row for each value of a group: its rows ``_n``, those with smaller values ``_before``, and ``_all``.

    Equal values are counted together before they are ordered, so a common one is a single row.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    rows = of_ranges(in_ranges(counts, by, [value]), by, F.col("_n"))
    own = F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy(value)) - F.col("_n")
    return rows.withColumn("_before", F.col("_before") + own).drop("_range")


def exact_quantile(df: DataFrame, by: Sequence[str], value: str, q: float, name: str, most: int | None = None) -> DataFrame:
    """Each group's quantile, between the two nearest values in proportion; null for a group without values.

    ``most``: rows of the largest group, if known. Groups of up to ``HELD`` rows are aggregated; larger ones are put
    in order range by range, equal values counted together, so that no task holds a group's values whole.
    """
    if (largest(df, by) if most is None else most) <= min(HELD, SMALL):
        return df.groupBy(*by).agg(F.percentile(F.col(value).cast("double"), q).alias(name))
    rows = placed(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")), by, "_v")
    at = q * (F.col("_all") - 1)
    near = rows.withColumn("_at", at).where((F.col("_before") <= F.ceil("_at")) & (F.col("_before") + F.col("_n") > F.floor("_at")))
    found = near.groupBy(*by).agg((F.min("_v") + (F.max("_v") - F.min("_v")) * (F.max("_at") - F.floor(F.max("_at")))).alias(name))
    if not by:
        return found
    own = found.select(*(F.col(c).alias(f"_of_{c}") for c in by), name)
    return df.select(*by).distinct().join(own, same(by, "_of_"), "left").select(*by, name)


def mid_ranks(df: DataFrame, by: Sequence[str], value: str, name: str, most: int | None = None) -> DataFrame:
    """Ranks from 1 within each group; equal values share the mean of their ranks."""
    if (largest(df, by) if most is None else most) <= SMALL:
        w = Window.partitionBy(*by)
        return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0)
    places = placed(df, by, value)
    rank = places.select(*(F.col(c).alias(f"_of_{c}") for c in [*by, value]), (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(rank, same([*by, value], "_of_")).select(*df.columns, name)


def rank_sum(df: DataFrame, by: Sequence[str], in_a: Column, value: str) -> DataFrame:
    """Mann-Whitney U of the rows in a against the others of the group."""
    ranked = mid_ranks(df.where(F.col(value).isNotNull()), by, value, "_r").withColumn("_a", in_a)
    na, nb = F.count_if("_a"), F.count_if(~F.col("_a"))
    return ranked.groupBy(*by).agg(na.alias("na"), nb.alias("nb"), (F.coalesce(F.sum(F.when(F.col("_a"), F.col("_r"))), F.lit(0.0)) - na * (na + 1) / 2.0).alias("u"))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    most = largest(rows, by)
    ranked = mid_ranks(mid_ranks(rows, by, x, "_x", most), by, y, "_y", most)
    return ranked.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"), F.count(F.lit(1)).alias("n"))


def line_fit(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def pearson2_from_sums(df: DataFrame, by: Sequence[str], x: Column, y: Column) -> DataFrame:
    """Squared correlation from the six sums, which merge across parts."""
    n, sx, sy, sxx, syy, sxy = F.count(F.lit(1)), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)
    top = n * sxy - sx * sy
    return df.groupBy(*by).agg(F.try_divide(top * top, (n * sxx - sx * sx) * (n * syy - sy * sy)).alias("r2"))


def _adjusted(df: DataFrame, family: Sequence[str], p: str, id_col: str, raw, upwards: bool) -> DataFrame:
    """P values times a factor of rank and count, made monotone over the ranks; nulls stay null."""
    known, unknown = df.where(F.col(p).isNotNull()), df.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double"))
    if largest(known, family) <= SMALL:
        w = Window.partitionBy(*family)
        rows = known.withColumn("_r", F.row_number().over(w.orderBy(p, id_col))).withColumn("_raw", raw(F.col(p), F.count(F.lit(1)).over(w), F.col("_r")))
        best = F.max("_raw").over(w.orderBy("_r")) if upwards else F.min("_raw").over(w.orderBy(F.desc("_r")))
        return rows.withColumn("q", F.least(best, F.lit(1.0))).select(*df.columns, "q").unionByName(unknown)
    rows = of_ranges(in_ranges(known, family, [p, id_col]), family)
    own = Window.partitionBy(*family, "_range")
    rows = rows.withColumn("_r", F.col("_before") + F.row_number().over(own.orderBy(p, id_col)))
    rows = rows.withColumn("_raw", raw(F.col(p), F.col("_all"), F.col("_r"))).drop("_before", "_all")
    rows = of_ranges(rows, family, raw=F.max("_raw") if upwards else F.min("_raw"))
    if upwards:
        best = F.greatest(F.max("_raw").over(own.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)), F.col("_earlier_raw"))
    else:
        best = F.least(F.min("_raw").over(own.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)), F.col("_later_raw"))
    return rows.withColumn("q", F.least(best, F.lit(1.0))).select(*df.columns, "q").unionByName(unknown)


def benjamini_hochberg(df: DataFrame, family: Sequence[str], p: str, id_col: str) -> DataFrame:
    """P values of each family times n over rank, made monotone from the largest down; nulls stay null."""
    return _adjusted(df, family, p, id_col, lambda x, n, r: x * n / r, upwards=False)


def holm(df: DataFrame, family: Sequence[str], p: str, id_col: str) -> DataFrame:
    """Holm's step-down adjustment within each family; nulls stay null."""
    return _adjusted(df, family, p, id_col, lambda x, n, r: (n - r + 1) * x, upwards=True)


def _row_keys(df: DataFrame) -> Column:
    """A hash for each row that repeats on any partitioning; equal rows are numbered and get keys of their own."""
    again = F.row_number().over(Window.partitionBy(*df.columns).orderBy(F.lit(0)))
    return F.xxhash64(*df.columns, again)


def permutation(df: DataFrame, strata: Sequence[str], in_a: Column, value: str, repeats: int, seed: int = 7) -> DataFrame:
    """Stratified Monte-Carlo permutation of the strata's differences of means, weighted by their sizes, with the +1 correction.

    In each repeat every row draws a hash-seeded key, and the smallest keys of a stratum become group a, as many as
    it has: labels are shuffled by sorting, on Spark. A stratum with one side only tells nothing and is left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(*strata, in_a.alias("_a"), F.col(value).cast("double").alias("_v"), _row_keys(df).alias("_id"))
    sizes = rows.groupBy(*strata).agg(F.count_if("_a").alias("_k"), F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_t")).where("_k > 0 and _k < _n")
    sizes = sizes.select(*(F.col(c).alias(f"_of_{c}") for c in strata), "_k", "_n", "_t")
    rows = rows.join(sizes, same(strata, "_of_")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats))))
    place = F.row_number().over(Window.partitionBy("rep", *strata).orderBy(F.when(F.col("rep") == 0, F.when(F.col("_a"), 0).otherwise(1)).otherwise(F.xxhash64("_id", "rep", F.lit(seed))), "_id"))
    chosen = rows.withColumn("_in", place <= F.col("_k")).where("_in").groupBy("rep", *strata).agg(F.sum("_v").alias("_s"), F.first("_k").alias("_k"), F.first("_n").alias("_n"), F.first("_t").alias("_t"))
    difference = F.col("_s") / F.col("_k") - (F.col("_t") - F.col("_s")) / (F.col("_n") - F.col("_k"))
    stat = chosen.groupBy("rep").agg((F.sum(F.col("_n") * difference) / F.sum("_n")).alias("d"))
    seen = stat.where("rep = 0").select(F.col("d").alias("observed"))
    both = stat.where("rep > 0").crossJoin(F.broadcast(seen))  # one row on the right
    return both.groupBy("observed").agg(((F.count_if(F.abs("d") >= F.abs("observed") - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def bootstrap_median(df: DataFrame, by: Sequence[str], value: str, repeats: int, seed: int = 7) -> DataFrame:
    """Percentile interval of each group's median: rows get hash-seeded Poisson weights in every repeat."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), _row_keys(df).alias("_id"))
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    u = F.pmod(F.xxhash64("_id", "rep", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    cuts = np.cumsum([np.exp(-1.0) / np.prod(range(1, k + 1)) for k in range(8)])
    weight = sum(((u >= float(c)).cast("int") for c in cuts), F.lit(0))
    drawn = rows.withColumn("_w", weight).where("_w > 0").groupBy(*by, "rep").agg(F.expr("percentile(_v, 0.5, _w)").alias("m"))
    return drawn.groupBy(*by).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def fit_curves(df: DataFrame, by: Sequence[str], t: str, y: str, least: int = 8) -> DataFrame:
    """A straight line and a four-parameter logistic curve for each series, with both errors.

    ``rise``: time from 10 to 90 %. One series is one group; short ones are left out.
    """
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in by)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        x, v = pdf[t].to_numpy(float), pdf[y].to_numpy(float)
        line = np.polyval(np.polyfit(x, v, 1), x) if np.ptp(x) else np.full_like(v, v.mean())
        p, rss = fit_logistic4(x, v)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, "line_rss": float(((v - line) ** 2).sum()), "curve_rss": rss, "middle": p[3], "rise": 4.394 / abs(p[2]) if p[2] else None}])

    rows = df.select(*by, t, y).where(F.col(t).isNotNull() & F.col(y).isNotNull())
    long = rows.groupBy(*by).count().where(F.col("count") >= least).select(*by)
    return rows.join(long, list(by), "left_semi").groupBy(*by).applyInPandas(fit, f"{keys}, line_rss double, curve_rss double, middle double, rise double")


def mixtures(profiles: DataFrame, label: str, feature: str, value: str, references: DataFrame) -> DataFrame:
    """Each profile as a non-negative mixture of reference profiles: weights that add to 1, and R squared.

    References are few (labels times chosen features) and are joined to every profile's features; one
    group holds one profile beside them.
    """
    refs = references.select(F.col(label).alias("part"), feature, F.col(value).alias("_rv"))
    both = profiles.select(label, feature, F.col(value).alias("_pv")).join(refs, feature)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.pivot_table(index=feature, columns="part", values="_rv", fill_value=0.0).sort_index()
        y = pdf.drop_duplicates(feature).set_index(feature)["_pv"].reindex(a.index).to_numpy(float)
        w = nonnegative_fit(a.to_numpy(float), y)
        left = ((y - a.to_numpy(float) @ w) ** 2).sum()
        spread = ((y - y.mean()) ** 2).sum()
        return pd.DataFrame({label: pdf[label].iloc[0], "part": a.columns, "weight": w / w.sum() if w.sum() else w, "r2": 1 - left / spread if spread else None})

    kind = profiles.schema[label].dataType.simpleString()
    part = references.schema[label].dataType.simpleString()
    return both.groupBy(label).applyInPandas(fit, f"{label} {kind}, part {part}, weight double, r2 double")


def greedy_merge(df: DataFrame, by: Sequence[str], order: str, weight: str, target: float) -> DataFrame:
    """Neighbouring bins joined until each reaches a target weight; a poor last one joins the one before."""
    schema = df.withColumn("merged", F.lit(0).cast("long")).schema

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, held, at, out = pdf.sort_values(order), 0.0, 0, []
        for w in pdf[weight]:
            out.append(at)
            held += w
            if held >= target:
                held, at = 0.0, at + 1
        if 0 < held < target and at:
            out = [min(k, at - 1) for k in out]
        return pdf.assign(merged=out)

    return df.groupBy(*by).applyInPandas(merge, schema)


def downsample_counts(x: DataFrame, row: str, feature: str, value: str, depth: int, seed: int = 7) -> DataFrame:
    """Each row's counts drawn anew to a fixed depth; the draw depends on the row's id and the seed alone."""
    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(feature)
        p = pdf[value].to_numpy(float)
        rng = np.random.default_rng([seed, int(pdf["_h"].iloc[0]) & 0x7FFFFFFF])
        return pdf.assign(**{value: rng.multinomial(depth, p / p.sum()) if p.sum() > 0 else 0}).drop(columns="_h")

    kinds = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    return x.select(row, feature, F.col(value).cast("long").alias(value), F.xxhash64(row).alias("_h")).groupBy(row).applyInPandas(draw, f"{row} {kinds[row]}, {feature} {kinds[feature]}, {value} long").where(F.col(value) > 0)


def block_folds(n: Column, folds: int, rank: Column) -> Column:
    """The contiguous fold of a row by its rank from 0."""
    return F.least(F.floor(rank * folds / n), F.lit(folds - 1)).cast("long")
