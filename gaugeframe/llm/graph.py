"""Connected components of an edge list, by joins and grouped minima."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Each round a node takes the smallest label among its neighbours and itself, then the label of its
    label, so chains shorten by half. Rounds end when no label changes. Labels are written to the
    shared folder each round; nothing but a count reaches the driver. Self-loops are harmless; edges
    with a null end are left out.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    tables = Scratch(edges.sparkSession)
    both = tables.write(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = tables.write(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels-0")
    for step in itertools.count(1):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("label"), F.col("component").alias("before"))
        lower = tables.write(lower, "lower")
        jump = lower.select(F.col("node").alias("at"), F.col("label").alias("next"))
        moved = lower.join(jump, lower["label"] == jump["at"], "left").select("node", F.coalesce("next", "label").alias("component"), "before")
        moved = tables.write(moved, f"labels-{step}")
        tables.drop("lower", f"labels-{step - 1}")
        labels = moved.select("node", "component")
        if moved.where("component != before").isEmpty():
            tables.drop("edges")
            return labels
