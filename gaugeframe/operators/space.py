"""Points, tracks and regions: nearest distances within a reach, linking over frames, connected cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import search


def near_distance(points: DataFrame, marks: DataFrame, by: Sequence[str], x: str, y: str, reach: float) -> DataFrame:
    """Each point's distance to the nearest mark of its group, null if none lies within ``reach``.

    Marks go to the nine cells around theirs, cells being as wide as the reach, and meet points by an
    equi-join; no point is compared with marks farther than two cells away.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    step = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = marks.select(*by, F.col(x).alias("_mx"), F.col(y).alias("_my"), F.explode(step).alias("_s"), cell(x).alias("_cx"), cell(y).alias("_cy"))
    spread = spread.select(*by, "_mx", "_my", (F.col("_cx") + F.col("_s.i")).alias("_i"), (F.col("_cy") + F.col("_s.j")).alias("_j"))
    # by place, so that points that repeat stay as many as they are
    places = points.select(*by, x, y).distinct()
    met = places.withColumn("_i", cell(x)).withColumn("_j", cell(y)).join(spread, [*by, "_i", "_j"])
    d = F.hypot(F.col(x) - F.col("_mx"), F.col(y) - F.col("_my"))
    near = met.where(d <= reach).groupBy(*by, x, y).agg(F.min(d).alias("distance"))
    return points.join(near, [*by, x, y], "left").select(*points.columns, "distance")


def shell_of(distance: str, width: float):
    """The number of the shell that a distance lies in, from 0."""
    return F.floor(F.col(distance) / width).cast("long")


def chain_roots(links: DataFrame, node: str, before: str) -> DataFrame:
    """(node, root): the start of the chain that each node ends, by doubling of pointers.

    ``links`` gives each node at most one node before it; chains of n links take log2(n) joins. Tables of nodes are
    never broadcast: they pack into few bytes, but their rows would lie in the driver's memory.
    """
    at = links.select(F.col(node).alias("node"), F.col(before).alias("root"))
    starts = links.select(F.col(before).alias("node")).join(links.select(F.col(node).alias("node")), "node", "left_anti").distinct().withColumn("root", F.col("node"))
    at = at.unionByName(starts)
    while True:
        jump = at.select(F.col("node").alias("root"), F.col("root").alias("_next")).hint("merge")
        moved = at.join(jump, "root").select("node", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved"))
        moved = cut(moved)
        at = moved.select("node", "root")
        if moved.where("_moved").isEmpty():
            return at


def tracks(detections: DataFrame, by: Sequence[str], frame: str, id_col: str, at: Sequence[str], reach: float) -> DataFrame:
    """A track id for each detection: one-to-one links of least distance between neighbouring frames, chained.

    Each pair of frames is solved by itself, side by side, and in it each set of detections that chain within
    the reach; the id is that of the track's first detection.
    """
    here = detections.select(*by, F.col(frame).alias("_f"), id_col, *at)
    following = here.withColumn("_f", F.col("_f") - 1)
    links = cut(search.match(here, following, [*by, "_f"], id_col, at, reach).select(F.col("b").alias("node"), F.col("a").alias("before")))
    roots = chain_roots(links, "node", "before")
    found = detections.join(roots.withColumnRenamed("node", id_col).hint("merge"), id_col, "left").withColumn("track", F.coalesce("root", F.col(id_col)))
    return found.select(*detections.columns, "track")


def track_lengths(found: DataFrame, frame: str) -> DataFrame:
    return found.groupBy("track").agg(F.count(F.lit(1)).alias("length"), F.min(frame).alias("first"), F.max(frame).alias("last"))


def regions(cells: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Connected cells (four neighbours) of each group under one number: the smallest place among them.

    Every round a cell takes the smallest label around it and then that label's own, until none changes.
    """
    place = F.col(x).cast("long") * (1 << 31) + F.col(y).cast("long")
    rows = cells.select(*by, F.col(x).cast("long").alias(x), F.col(y).cast("long").alias(y)).distinct().withColumn("place", place).withColumn("region", place)
    while True:
        around = F.array(F.lit(0), F.lit(1 << 31), F.lit(-(1 << 31)), F.lit(1), F.lit(-1))
        told = rows.select(*by, "place", "region", F.explode(around).alias("_d")).withColumn("place", F.col("place") + F.col("_d")).groupBy(*by, "place").agg(F.min("region").alias("_near"))
        near = rows.join(told, [*by, "place"])
        root = rows.select(*by, F.col("place").alias("_near"), F.col("region").alias("_root"))
        moved = near.join(root, [*by, "_near"]).select(*by, x, y, "place", F.col("_root").alias("_new"), (F.col("_root") < F.col("region")).alias("_moved"))
        moved = cut(moved)
        rows = moved.select(*by, x, y, "place", F.col("_new").alias("region"))
        if moved.where("_moved").isEmpty():
            return rows.select(*by, x, y, "region")


def title_blocks(rows: DataFrame, by: Sequence[str], order: str, title) -> DataFrame:
    """Rows of a sheet numbered by block: a block starts at each title row."""
    number = F.sum(F.coalesce(title, F.lit(False)).cast("int")).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("block", number.cast("long"))
