"""Declared panels: a table, what to prepare and keep, and the key and value to verify."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from .verify import Difference, keyed_difference

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Panel:
    """One published panel. ``prepare`` and ``subset`` stay lazy; Spark plans them as one query."""

    name: str
    table: str
    keys: tuple[str, ...]
    value: str
    prepare: tuple[Step, ...] = ()
    subset: Column | None = None
    renamed: Mapping[str, str] = field(default_factory=dict)

    def rows(self, spark: SparkSession, root: str) -> DataFrame:
        """The rows that the panel shows."""
        df = spark.read.parquet(f"{root}/{self.table}.parquet")
        for step in self.prepare:
            df = df.transform(step)
        if self.subset is not None:
            df = df.where(self.subset)
        return df.withColumnsRenamed(dict(self.renamed)).select(*self.keys, self.value)

    def verify(self, spark: SparkSession, root: str, published: DataFrame, **how) -> Difference:
        return keyed_difference(self.rows(spark, root), published, self.keys, self.value, **how)
