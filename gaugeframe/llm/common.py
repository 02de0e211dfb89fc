"""Small helpers that the text operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession, name: str, outside: bool = False) -> str:
    """A new path under the folder that driver and executors share.

    The cluster names the folder in ``spark.checkpoint.dir``. Where that is unset, a local session
    gets a temporary folder; on a cluster that would not be shared, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return "/".join([base.rstrip("/"), *([] if outside else _INSIDE), f"{name}-{uuid.uuid4().hex}"])


#: Folders below the shared one that new paths lie in, on the driver.
_INSIDE: list[str] = []


@contextmanager
def passing_folder(spark: SparkSession, name: str) -> Iterator[None]:
    """What is written meanwhile lies in a folder of its own, which is deleted at the end."""
    path = scratch_dir(spark, name)
    _INSIDE.append(path.rsplit("/", 1)[1])
    try:
        yield
    finally:
        _INSIDE.pop()
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder and all below it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives a lost executor."""
    return Scratch(df.sparkSession).write(df, name)


class Scratch:
    """Tables in the shared folder that are deleted when their last reader is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str, outside: bool = False) -> DataFrame:
        """Write a table and read it back; ``outside`` of any folder that is going to be deleted."""
        path = scratch_dir(self.spark, name, outside)
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete every table written under these names."""
        for name in names:
            for path in self.paths.pop(name, []):
                delete(self.spark, path)


_HELD: dict[object, object] = {}


def resident(key: object, make: Callable[[], object]):
    """What a Python worker keeps from task to task: one thing at a time.

    Workers outlive a stage, so an operator's tables and memos make way for the next one's.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


#: Rows of an Arrow batch, at most: texts are long, and buffers of many rows stay with the executors.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows where they are longer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names; every other column is left behind."""
    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def small_batches(batches: Iterator[pa.RecordBatch], max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``max_bytes`` at most, or one row.

    Bounds a task's memory when the rows of a batch are very long.
    """
    for batch in batches:
        todo = [batch]
        while todo:
            b = todo.pop()
            # nbytes of a slice counts the slice only
            if b.num_rows > 1 and b.nbytes > max_bytes:
                half = b.num_rows // 2
                todo += [b.slice(half), b.slice(0, half)]
            elif b.num_rows:
                yield b
