"""A session with the settings that the operators are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "gaugeframe", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; what the cluster already sets stays as it is."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, so that a loop's plan doesn't grow.

    The folder is the one that ``spark.checkpoint.dir`` names. Where none is named, a local session gets
    a temporary folder; on a cluster that would not be shared, so it is an error there. A table is read
    back with nothing known of how it was made, where checkpoints keep constraints that grow in a loop.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def forget(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for this table, once nothing reads it any more; other tables stay as they are."""
    path = vars(df).get("_cut_path")
    if path:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
