"""The corpus pipeline: stages in order, each a function of (spark, docs, sf_dir).

A stage's result is written as Parquet and read again as the next one's documents. Every stage works
on all rows that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import decontam, line_dedup, near_dups, piece_fst, quality
from gaugeframe.llm.common import Scratch, passing_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents and drop those that score below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take cross-site boilerplate lines out of the texts; a document of nothing else goes."""
    return line_dedup.drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    return near_dups.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold enough of a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, decoded again: ``doc_id``, ``ids``, ``round_trip`` and ``n_ids``."""
    encoded = piece_fst.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), checked=True)
    return encoded.withColumn("n_ids", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("encoding", encode),
]
#: SQL has no compression classifier; tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    A stage's own tables are deleted when its result is written, and that when the next one's is; what the
    last stage reads stays.
    """
    docs, kept, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), None
    for name, stage in STAGES[:-1]:
        name = name.replace(" ", "-")
        with passing_folder(spark, f"tables-of-{name}"):
            rows = stage(spark, docs, sf_dir)
            # the result lies beside the folder of the stage's tables
            docs = kept.write(rows, name, outside=True)
        if before:
            kept.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
