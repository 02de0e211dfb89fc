"""Between wide, long and dense shapes, and several tables as one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """A row for each key and column; null values stay."""
    return df.unpivot(list(keys), list(columns), name, value)


def to_wide(df: DataFrame, keys: Sequence[str], name: str, names: Sequence[str], value: str) -> DataFrame:
    """A column for each stated name; of several values the largest."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.max(value))


def dense_grid(hist: DataFrame, by: Sequence[str], x: str, y: str, n: str, width: int, height: int) -> DataFrame:
    """Every cell of a width times height grid for each group, absent counts being 0."""
    cells = hist.select(*by).distinct().withColumn(x, F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn(y, F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    own = hist.select(*by, F.col(x).cast("int").alias(x), F.col(y).cast("int").alias(y), n)
    return cells.join(own, [*by, x, y], "left").withColumn(n, F.coalesce(n, F.lit(0)))


def display_scale(grid: DataFrame, by: Sequence[str], n: str, q: float) -> DataFrame:
    """Counts over the group's maximum, and clipped at a quantile of the counts above 0."""
    top = grid.groupBy(*by).agg(F.max(n).alias("_max"), F.percentile(F.when(F.col(n) > 0, F.col(n)), q).alias("_clip"))
    rows = grid.join(top, list(by))
    return rows.withColumn("scaled", F.coalesce(F.try_divide(n, "_max"), F.lit(0.0))).withColumn("clipped", F.least(F.coalesce(F.try_divide(n, "_clip"), F.lit(0.0)), F.lit(1.0))).drop("_max", "_clip")


def axis_top(df: DataFrame, by: Sequence[str], value: str, q: float = 0.995, fallback: float = 1.0) -> DataFrame:
    """An axis limit: a high quantile of values of 0 or more; the maximum if that is 0, else the fallback."""
    x = F.when(F.col(value) >= 0, F.col(value))
    rows = df.groupBy(*by).agg(F.percentile(x, q).alias("_q"), F.max(x).alias("_m"))
    return rows.select(*by, F.when(F.col("_q") > 0, F.col("_q")).when(F.col("_m") > 0, F.col("_m")).otherwise(fallback).alias("top"))


def transposed_differences(one: DataFrame, other: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Cells of a long matrix that differ from the other's transpose, absent cells being 0."""
    flipped = other.select(F.col(col).alias(row), F.col(row).alias(col), F.col(value).alias("_v"))
    both = one.join(flipped, [row, col], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select(row, col, (zero(value) - zero("_v")).alias("difference")).where("difference != 0")


def stacked(tables: dict[str, DataFrame], name: str = "source") -> DataFrame:
    """All rows of several tables with the name of their own; absent columns are null."""
    every = None
    for label, df in tables.items():
        one = df.withColumn(name, F.lit(label))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    return every


def joined_matrices(one: DataFrame, other: DataFrame, row: str, feature: str, value: str, names: tuple[str, str], inner: bool) -> DataFrame:
    """Two long matrices under each other, over the features of both (inner) or of either; rows are named by their table."""
    if inner:
        shared = one.select(feature).distinct().join(other.select(feature).distinct(), feature, "left_semi")
        one, other = one.join(shared, feature, "left_semi"), other.join(shared, feature, "left_semi")
    named = lambda df, name: df.select(F.concat_ws("-", F.col(row).cast("string"), F.lit(name)).alias(row), feature, value)
    return named(one, names[0]).unionByName(named(other, names[1]))


def ordered_distinct(df: DataFrame, by: Sequence[str], order: str, item: str) -> DataFrame:
    """Each group's distinct items in the order in which they first come."""
    first = df.where(F.col(item).isNotNull()).groupBy(*by, item).agg(F.min(order).alias("_o"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", item))), lambda x: x[item]).alias("items"))
