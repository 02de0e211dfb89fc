"""Delimited and Parquet scans, contracts, upserts and manifests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in any float column becomes null, so that aggregates skip it."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns))


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV or TSV file (by its ending) with a header and a stated schema; ids declared as strings keep their zeros."""
    return nan_to_null(spark.read.schema(schema).csv(path, sep="\t" if path.endswith((".tsv", ".tsv.gz", ".txt")) else ",", header=True, nanValue="NaN"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def key_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """A long (key, value) table as one row with a map column ``values``."""
    return df.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("values"))


def file_index(spark: SparkSession, root: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """A row for each file below ``root``: path, size and the groups of ``pattern`` in its path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("bytes"), *(F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(names)))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Path, bytes and SHA-256 of each file below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@dataclass(frozen=True)
class Contract:
    """What a table must be: columns present, a unique key, a row count, values allowed."""

    required: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    rows: int | None = None
    allowed: dict[str, tuple] = field(default_factory=dict)


def broken(df: DataFrame, contract: Contract) -> list[str]:
    """The contract's terms that a table breaks; one pass over it and one over its keys."""
    out = [f"column {c} is missing" for c in contract.required if c not in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(~F.col(c).isin(*v)).alias(c) for c, v in contract.allowed.items() if c in df.columns)).first()
    if contract.rows is not None and counts["n"] != contract.rows:
        out.append(f"{counts['n']} rows instead of {contract.rows}")
    out += [f"column {c} has other values" for c in contract.allowed if c in df.columns and counts[c]]
    if contract.key and not df.groupBy(*contract.key).count().where("count > 1").isEmpty():
        out.append(f"key {', '.join(contract.key)} repeats")
    return out


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def fill_defaults(existing: DataFrame, defaults: DataFrame, key: Sequence[str]) -> DataFrame:
    """A row for each default; values that exist already and aren't null win."""
    values = [c for c in defaults.columns if c not in key]
    have = existing.select(*key, *(F.col(c).alias(f"_have_{c}") for c in values))
    return defaults.join(have, list(key), "left").select(*key, *(F.coalesce(f"_have_{c}", c).alias(c) for c in values))


def write_matrix(x: DataFrame, row: str, col: str, value: str, path: str) -> None:
    """Coordinate triples with dense ids from 1, beside the two id tables, as Parquet."""
    for name in (row, col):
        ids = x.select(name).distinct().repartitionByRange(F.col(name)).sortWithinPartitions(name)
        part = ids.withColumn("part", F.spark_partition_id())
        ids = numbered(part, "part", name)
        ids.write.parquet(f"{path}/{name}")
    spark = x.sparkSession
    for name in (row, col):
        x = x.join(spark.read.parquet(f"{path}/{name}").withColumnRenamed("number", f"{name}_number"), name)
    x.select(f"{row}_number", f"{col}_number", value).write.parquet(f"{path}/triples")


def numbered(df: DataFrame, part: str, order: str) -> DataFrame:
    """Numbers from 1 in ``order`` over range parts: numbers within a part plus the sizes of parts before."""
    from pyspark.sql import Window as W

    sizes = df.groupBy(part).count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(W.partitionBy(part).orderBy(order))
    return df.withColumn("own", own).join(F.broadcast(sizes.select(part, "before")), part).select(order, (F.col("own") + F.col("before")).alias("number"))
