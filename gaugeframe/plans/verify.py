"""Verification of a computed table against a published one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import stats


def decimals(df: DataFrame, column: str, most: int = 12) -> int | None:
    """The decimals a column carries: the least at which rounding changes nothing; None if more than ``most``."""
    c = F.col(column).cast("double")
    slack = F.greatest(F.abs(c) * 2.0**-23, F.lit(1e-15))
    fits = df.agg(*(F.coalesce(F.bool_and(F.abs(F.bround(c, d) - c) <= slack), F.lit(True)).alias(str(d)) for d in range(most + 1))).first()
    return next((d for d in range(most + 1) if fits[str(d)]), None)


def tolerance(df: DataFrame, column: str) -> float:
    """Half a unit of the last decimal carried, but no less than rounding noise."""
    d, top = decimals(df, column), df.agg(F.coalesce(F.max(F.abs(F.col(column).cast("double"))), F.lit(0.0))).first()[0]
    return max(0.5 * 10.0**-d if d is not None else 0.0, 1e-12 * top, 1e-15)


@dataclass(frozen=True)
class Difference:
    """What a comparison found."""

    matched: int
    only_left: int
    only_right: int
    largest: float
    over: int

    @property
    def ok(self) -> bool:
        return not (self.only_left or self.only_right or self.over) and self.matched > 0


def keyed_difference(mine: DataFrame, published: DataFrame, keys: Sequence[str], value: str, allowed: float | None = None, key_decimals: int | None = None) -> Difference:
    """Compare by key in both directions: extra rows on either side fail.

    Two nulls agree, one null differs by infinity. Numeric keys can be rounded on both sides first.
    """
    allowed = tolerance(published, value) if allowed is None else allowed
    kinds = dict(published.dtypes)
    key = lambda c: F.bround(F.col(c), key_decimals).alias(c) if key_decimals is not None and kinds[c] in ("double", "float") else F.col(c)
    a = mine.select(*map(key, keys), F.col(value).cast("double").alias("_a"), F.lit(1).alias("_l"))
    b = published.select(*map(key, keys), F.col(value).cast("double").alias("_b"), F.lit(1).alias("_r"))
    gap = F.when(F.col("_a").isNull() & F.col("_b").isNull(), 0.0).when(F.col("_a").isNull() | F.col("_b").isNull(), float("inf")).otherwise(F.abs(F.col("_a") - F.col("_b")))
    both = a.join(b, list(keys), "full").withColumn("_both", F.col("_l").isNotNull() & F.col("_r").isNotNull()).withColumn("_gap", F.when(F.col("_both"), gap))
    r = both.agg(F.count_if("_both"), F.count_if(F.col("_r").isNull()), F.count_if(F.col("_l").isNull()), F.coalesce(F.max("_gap"), F.lit(0.0)), F.count_if(F.col("_gap") > allowed)).first()
    return Difference(*r)


def sorted_difference(mine: DataFrame, published: DataFrame, by: Sequence[str], value: str, allowed: float | None = None) -> Difference:
    """Compare tables without a key: values of each group in order, against each other.

    Equal values are counted together and take a stretch of places; both sides' stretches are cut where either has an
    end, so no task orders a group. Rows of a null group have no counterpart.
    """
    allowed = tolerance(published, value) if allowed is None else allowed
    held = lambda df: df.select(*by, F.col(value).cast("double").alias("_v"))
    no_group = lambda df: df.where(~F.coalesce(*(F.when(F.col(c).isNull(), False) for c in by), F.lit(True))).count() if by else 0
    ends = None
    for df, side, other in ((mine, "_a", "_b"), (published, "_b", "_a")):
        rows = stats.placed(held(df).dropna(subset=list(by)) if by else held(df), by, "_v")
        one = F.struct(F.col("_before").alias("at"), F.lit(True).alias("there"), F.col("_v").alias("v"))
        last = F.struct(F.col("_all").alias("at"), F.lit(False).alias("there"), F.lit(None).cast("double").alias("v"))
        starts = rows.select(*by, F.explode(F.when(F.col("_before") + F.col("_n") == F.col("_all"), F.array(one, last)).otherwise(F.array(one))).alias(side))
        starts = starts.withColumn("_at", F.col(f"{side}.at")).withColumn(other, F.lit(None).cast(starts.schema[side].dataType))
        ends = starts if ends is None else ends.unionByName(starts)
    ends = stats.in_ranges(ends.groupBy(*by, "_at").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")), by, ["_at"])
    ends = stats.of_ranges(ends, by, at=F.min("_at"), a=F.max("_a"), b=F.max("_b"))
    w = Window.partitionBy(*by, "_range").orderBy("_at")
    now = lambda side: F.coalesce(F.max(f"_{side}").over(w), F.col(f"_earlier_{side}"))
    pieces = ends.select((F.coalesce(F.lead("_at").over(w), F.col("_later_at")) - F.col("_at")).alias("n"), now("a").alias("a"), now("b").alias("b")).where("n is not null")
    l, r, x, y = F.coalesce("a.there", F.lit(False)), F.coalesce("b.there", F.lit(False)), F.col("a.v"), F.col("b.v")
    gap = F.when(x.isNull() & y.isNull(), 0.0).when(x.isNull() | y.isNull(), float("inf")).otherwise(F.abs(x - y))
    pieces = pieces.withColumns({"_l": l, "_r": r}).withColumn("_gap", F.when(F.col("_l") & F.col("_r"), gap))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    found = pieces.agg(total(F.col("_l") & F.col("_r")), total(F.col("_l") & ~F.col("_r")), total(~F.col("_l") & F.col("_r")), F.coalesce(F.max("_gap"), F.lit(0.0)), total(F.col("_gap") > allowed)).first()
    return Difference(found[0], found[1] + no_group(mine), found[2] + no_group(published), found[3], found[4])


def agreement(one: DataFrame, other: DataFrame, key: str, label: str) -> DataFrame:
    """The share of keys to which both tables give the same label, of those in both."""
    both = one.select(key, F.col(label).alias("_a")).join(other.select(key, F.col(label).alias("_b")), key)
    return both.agg(F.avg(F.col("_a").eqNullSafe(F.col("_b")).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n"))


def reappearing(result: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Excluded keys that a result still has; an empty table is what should be."""
    return excluded.join(result, list(keys), "left_semi")
