"""Communities of largest modularity over a grid of resolutions: local moves and contraction, all runs side by side.

A run is one resolution with one order of moves. Every table has a column ``run``, so a round of joins moves the
nodes of all runs at once. In a round a node may go to the neighbouring community that raises modularity most, if that
comes later in an order of communities that is drawn by hash, or in the next round earlier; moves at the same time can
still undo each other, so the best labels of each run are kept, and rounds end when they bring no more. Then communities become the nodes of a
smaller graph, and it starts again, until nothing rises. Only figures of runs reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Rounds in a row without a rise after which a level ends, and what counts as a rise.
PATIENCE, LEAST_RISE = 3, 1e-9


def _moved(nodes: DataFrame, edges: DataFrame, labels: DataFrame, seed: int) -> tuple[DataFrame, dict]:
    """Local moves from ``labels`` (run, node, label): the best labels of each run, and their modularity.

    ``nodes``: (run, node, k, own, m2, gamma), with strength, weight inside, twice the run's weight, resolution.
    """
    best, seen, quiet, step = labels, {}, 0, 0
    while quiet < PATIENCE:
        here = nodes.join(labels, ["run", "node"])
        total = here.groupBy("run", "label").agg(F.sum("k").alias("total"))
        toward = edges.join(labels.select("run", F.col("node").alias("other"), "label"), ["run", "other"]).groupBy("run", "node", "label").agg(F.sum("w").alias("w"))
        # staying, and standing alone under one's own name where nobody else is
        stay = here.select("run", "node", F.explode(F.array_distinct(F.array("label", "node"))).alias("label"), F.lit(0.0).alias("w"))
        ways = toward.unionByName(stay).groupBy("run", "node", "label").agg(F.sum("w").alias("w"))
        ways = ways.join(total, ["run", "label"], "left").join(here.withColumnRenamed("label", "now"), ["run", "node"])
        others = F.coalesce("total", F.lit(0.0)) - F.when(F.col("label") == F.col("now"), F.col("k")).otherwise(0.0)
        ways = ways.withColumn("score", F.col("w") - F.col("gamma") * F.col("k") * others / F.col("m2"))
        # one's own name may be taken by others: then it is a community like any other
        own = F.col("label") == F.col("now")
        choice = ways.groupBy("run", "node").agg(
            F.first("now").alias("now"), F.first("own").alias("own"), F.first("k").alias("k"), F.first("m2").alias("m2"), F.first("gamma").alias("gamma"),
            F.max(F.when(own, F.col("w"))).alias("inside"), F.max(F.when(own, F.col("score"))).alias("stays"),
            F.max(F.struct(F.round("score", 12).alias("score"), (-F.xxhash64("run", "label", F.lit(seed))).alias("tie"), "label")).alias("best"),
        )
        choice = cut(choice)
        wants = F.col("best.score") > F.col("stays") + LEAST_RISE
        inside = choice.groupBy("run").agg((F.sum(F.col("inside") + F.col("own")) / F.first("m2")).alias("in"), F.count_if(wants).alias("wants"))
        spread = choice.groupBy("run", F.col("now").alias("label")).agg(F.sum("k").alias("t"), F.first("m2").alias("m2"), F.first("gamma").alias("gamma")).groupBy("run").agg(F.sum(F.col("gamma") * F.col("t") * F.col("t") / (F.col("m2") * F.col("m2"))).alias("out"))
        told = inside.join(spread, "run").collect()  # one row a run
        figures = {r["run"]: r["in"] - r["out"] for r in told}
        risen = [run for run, q in figures.items() if run not in seen or q > seen[run] + LEAST_RISE]
        if risen:
            seen |= {run: figures[run] for run in risen}
            now = choice.select("run", "node", F.col("now").alias("label"))
            best = now if len(risen) == len(figures) else now.where(F.col("run").isin(risen)).unionByName(best.where(~F.col("run").isin(risen)))
        quiet = 0 if risen else quiet + 1
        if not any(r["wants"] for r in told):
            break
        # of two rounds a move has its turn in one; two communities never swap nodes in the same round
        rank = lambda c: F.xxhash64("run", c, F.lit(step // 2), F.lit(seed))  # noqa: B023, E731
        turn = (rank("now") < rank("best.label")) == (step % 2 == 0)
        goes = turn & wants
        labels = choice.select("run", "node", F.when(goes, F.col("best.label")).otherwise(F.col("now")).alias("label"))
        step += 1
    return cut(best), seen


def _contracted(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Communities as nodes; what lies inside them is their own weight."""
    at = labels.select("run", "node", "label")
    ends = edges.join(at, ["run", "node"]).withColumnRenamed("label", "one").join(at.select("run", F.col("node").alias("other"), F.col("label").alias("two")), ["run", "other"])
    ends = cut(ends.groupBy("run", "one", "two").agg(F.sum("w").alias("w")))
    inside = ends.where("one = two").select("run", F.col("one").alias("label"), F.col("w").alias("inner"))
    grouped = nodes.join(at, ["run", "node"]).groupBy("run", "label").agg(F.sum("k").alias("k"), F.sum("own").alias("own"), F.first("m2").alias("m2"), F.first("gamma").alias("gamma"))
    whole = grouped.join(inside, ["run", "label"], "left").select("run", F.col("label").alias("node"), "k", (F.col("own") + F.coalesce("inner", F.lit(0.0))).alias("own"), "m2", "gamma")
    return cut(whole), ends.where("one != two").select("run", F.col("one").alias("node"), F.col("two").alias("other"), "w")


def communities(edges: DataFrame, a: str, b: str, weight: str, resolutions: Sequence[float] = (1.0,), orders: int = 1, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Labels (resolution, node, community) and figures (resolution, modularity, communities, largest) of a graph.

    Edges are undirected: both directions and repeats add up; loops weigh within their node; weights of 0 or less and
    null ends are left out. Each resolution takes the best of ``orders`` runs, ties to the first. A community bears
    the name of its smallest node. An empty graph gives empty tables.
    """
    spark = edges.sparkSession
    grid = [(i * orders + k, float(g)) for i, g in enumerate(resolutions) for k in range(orders)]
    runs = F.broadcast(spark.createDataFrame(grid, "run int, gamma double"))  # one row a run
    rows = edges.select(F.col(a).alias("node"), F.col(b).alias("other"), F.col(weight).cast("double").alias("w")).where("node is not null and other is not null and w > 0")
    both = cut(rows.unionByName(rows.select(F.col("other").alias("node"), F.col("node").alias("other"), "w")).groupBy("node", "other").agg(F.sum("w").alias("w")))
    held = both.groupBy("node").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("node") == F.col("other"), F.col("w")).otherwise(0.0)).alias("own"))
    weight2 = held.agg(F.sum("k").alias("m2"))
    nodes = first_nodes = cut(held.crossJoin(F.broadcast(weight2)).crossJoin(runs))  # a row, and a row a run, on the right
    arcs = first_arcs = cut(both.where("node != other").crossJoin(runs.select("run")))
    place = nodes.select("run", "node", F.col("node").alias("label"))  # each first node's node at this level
    known: dict[int, float] = {}
    named = place
    while True:
        before = known
        # from single nodes at first; later from the communities found so far, on the first graph
        start = place if not before else named.select("run", "node", "label")
        nodes, arcs = first_nodes, first_arcs
        found, at_level = place, None
        while True:
            labels, figures = _moved(nodes, arcs, start if at_level is None else nodes.select("run", "node", F.col("node").alias("label")), seed)
            # the communities of all levels before are what the first graph is refined from, and what a level must beat
            beaten = at_level if at_level is not None else before
            if not any(q > beaten.get(run, float("-inf")) + LEAST_RISE for run, q in figures.items()):
                break
            found = cut(found.select("run", "node", F.col("label").alias("_l")).join(labels.select("run", F.col("node").alias("_l"), "label"), ["run", "_l"]).select("run", "node", "label"))
            at_level = figures
            nodes, arcs = _contracted(nodes, arcs, labels)
        if at_level is None:
            break
        known, named = at_level, found
    chosen = [(max(range(i * orders, (i + 1) * orders), key=lambda run: (round(known[run], 9), -run)), float(g)) for i, g in enumerate(resolutions)] if known else []
    picked = F.broadcast(spark.createDataFrame([(run, g, known[run]) for run, g in chosen], "run int, resolution double, modularity double"))
    smallest = named.groupBy("run", "label").agg(F.min("node").alias("community"), F.count(F.lit(1)).alias("n"))
    labels = named.join(smallest, ["run", "label"]).join(picked, "run").select("resolution", "node", "community")
    figures = smallest.join(picked, "run").groupBy("resolution", "modularity").agg(F.count(F.lit(1)).alias("communities"), F.max("n").alias("largest"))
    return labels, figures


def best_communities(labels: DataFrame, scores: DataFrame, node: str, score: str) -> DataFrame:
    """The community of highest mean score at each resolution, its mean and its size; ties go to the first name."""
    per = labels.join(scores.select(F.col(node).alias("node"), F.col(score).alias("_s")), "node").groupBy("resolution", "community").agg(F.avg("_s").alias("score"), F.count(F.lit(1)).alias("size"))
    best = per.groupBy("resolution").agg(F.max_by(F.struct("community", "score", "size"), F.struct("score", (-F.col("community")).alias("_c"))).alias("_b"))
    return best.select("resolution", "_b.*")
