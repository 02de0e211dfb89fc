"""Connected sets of nodes by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that each node can reach over the edges, in either direction.

    In every round each node points to the smallest node around it, and to where that one points; then
    edges are drawn between the places pointed to, so what is left shrinks by a factor a round. It ends
    when no edge is left. Minima are taken over nodes; no pairs within a set are made, and no table is broadcast.
    """
    ends = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a))).distinct())
    at = ends.select("node").distinct().withColumn("root", F.col("node"))
    ends = ends.where("node != other")
    while not ends.isEmpty():
        least = ends.groupBy("node").agg(F.least("node", F.min("other")).alias("_to"))
        step = cut(least.join(least.select(F.col("node").alias("_to"), F.col("_to").alias("_next")).hint("merge"), "_to").select(F.col("node").alias("_from"), "_next")).hint("merge")
        at = cut(at.join(step, F.col("root") == F.col("_from"), "left").select("node", F.coalesce("_next", "root").alias("root")))
        moved = ends.join(step, F.col("node") == F.col("_from")).select(F.col("_next").alias("node"), "other")
        moved = moved.join(step, F.col("other") == F.col("_from")).select("node", F.col("_next").alias("other"))
        ends = cut(moved.where("node != other").distinct())
    return at
