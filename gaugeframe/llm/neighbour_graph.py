"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph, queries search it greedily.

Equal vectors are one node of the graph. First guesses come from blocks of rows that lie together in the order of
random sign codes. Then each round joins neighbours of neighbours: every node gathers the nodes around it, and any
two of them of which one is new become each other's neighbours if that is nearer than what they have. A query keeps
a beam of its nearest nodes so far and looks round the nearest of them that it hasn't yet, until all are seen.

Everything between is written to the shared folder and read back. No group in a task grows with the table: blocks
have a size, a node keeps ``k`` neighbours and gathers at most ``k + reverse`` nodes. The nodes that are not
gathered round a very popular one still have it among their own neighbours, so every link is used from its other end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of a block of first guesses, orders of random codes, and guesses kept from each.
BLOCK, ORDERS, GUESSES, BITS = 1024, 8, 10, 20


@dataclass
class Graph:
    """``nodes``: (node, raw, unit, members), one row for each different vector; ``links``: (node, around)."""

    nodes: DataFrame
    links: DataFrame
    dims: int
    tables: Scratch


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _floats(column: pa.Array, kind, dims: int) -> np.ndarray:
    """Packed vectors of a batch as rows of an array; all have the same length."""
    width = np.dtype(kind).itemsize * dims
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[start : start + width * len(column)].view(kind).reshape(len(column), dims)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def packed(df: DataFrame, id_col: str, vector: str, dims: int) -> DataFrame:
    """(id, raw, unit): usable vectors as doubles, and of length 1 in single precision; one row an id, the least vector."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims) + 0.0  # no negative zeros
                w = np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])  # so that no square overflows
                unit = (w / np.sqrt((w * w).sum(1))[:, None]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch["id"], _binary(v), _binary(unit)], ["id", "raw", "unit"])

    v = F.col(vector).cast("array<double>")
    good = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & _valid(F.col("v")) & (F.size("v") == dims))
    return good.groupBy("id").agg(F.min("v").alias("v")).mapInArrow(rows, "id long, raw binary, unit binary")


def usual_length(df: DataFrame, vector: str) -> int:
    """The length that most usable vectors have (ties: the least); others can't be compared with them."""
    v = F.col(vector).cast("array<double>")
    best = df.where(_valid(v)).groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return best["n"] if best else 0


def _guesses(dims: int, seed: int):
    """For each order of random codes: the order, the node's code, and its vector."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).normal(size=(dims, ORDERS * BITS)).astype(np.float32)
        for batch in batches:
            unit = _floats(batch["unit"], np.float32, dims).astype(np.float32)
            signs = (unit @ planes > 0).reshape(-1, ORDERS, BITS)
            # neighbours in Gray order differ in one sign
            gray = np.logical_xor.accumulate(signs, axis=2)
            codes = gray @ (1 << np.arange(BITS - 1, -1, -1))
            for t in range(ORDERS):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), t)), pa.array(codes[:, t]), batch["node"], batch["unit"]], ["turn", "code", "node", "unit"])

    return rows


def _edges(a: list, b: list, s: list) -> pa.RecordBatch:
    cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return pa.RecordBatch.from_arrays([pa.array(cat(a, np.int64)), pa.array(cat(b, np.int64)), pa.array(cat(s, np.float32))], ["a", "b", "s"])


def _in_blocks(dims: int):
    """Rows in order, ``BLOCK`` at a time: each with its nearest of the block."""

    def solve(nodes: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
        keep = min(GUESSES, len(nodes) - 1)
        if keep < 1:
            return _edges([], [], [])
        s = unit @ unit.T
        np.fill_diagonal(s, -2)
        near = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
        return _edges([np.repeat(nodes, keep)], [nodes[near].ravel()], [np.take_along_axis(s, near, 1).ravel()])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, unit = np.empty(0, np.int64), np.empty((0, dims), np.float32)
        for batch in batches:
            nodes = np.concatenate([nodes, batch["node"].to_numpy()])
            unit = np.concatenate([unit, _floats(batch["unit"], np.float32, dims).astype(np.float32)])
            while len(nodes) >= 2 * BLOCK:  # so that the last block is no short one
                yield solve(nodes[:BLOCK], unit[:BLOCK])
                nodes, unit = nodes[BLOCK:], unit[BLOCK:]
        yield solve(nodes, unit)

    return rows


def _around(dims: int):
    """Nodes gathered round each hub, hub after hub: pairs that are nearer than the worst that one of them has."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = (batch["hub"].to_numpy(), batch["node"].to_numpy(), batch["fresh"].to_numpy(zero_copy_only=False), batch["worst"].to_numpy(), _floats(batch["unit"], np.float32, dims).astype(np.float32))
            part = part if held is None else tuple(np.concatenate(x) for x in zip(held, part))
            starts = np.flatnonzero(np.r_[True, part[0][1:] != part[0][:-1]])
            yield _pairs(*(x[: starts[-1]] for x in part[1:]), np.r_[starts])
            held = tuple(x[starts[-1] :] for x in part)
        if held is not None:
            yield _pairs(*held[1:], np.array([0, len(held[0])]))

    return rows


def _pairs(nodes: np.ndarray, fresh: np.ndarray, worst: np.ndarray, unit: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    a, b, s = [], [], []
    for i, j in zip(starts[:-1], starts[1:]):
        if not fresh[i:j].any():
            continue
        names, near = nodes[i:j], unit[i:j] @ unit[i:j].T
        better = near > worst[i:j, None]
        better &= fresh[i:j, None] | fresh[None, i:j]
        better &= names[:, None] != names[None, :]
        x, y = np.nonzero(better)
        a.append(names[x])
        b.append(names[y])
        s.append(near[x, y])
    return _edges(a, b, s)


def _nearest(candidates: DataFrame, k: int) -> DataFrame:
    """(node, near): each node's ``k`` nearest candidates; one that was there before isn't new."""
    once = candidates.repartition("a").groupBy("a", "b").agg((-F.max("s")).alias("minus"), F.bool_and("fresh").alias("fresh"))
    near = F.slice(F.sort_array(F.collect_list(F.struct("minus", "b", "fresh"))), 1, k)
    return once.groupBy(F.col("a").alias("node")).agg(near.alias("near"))


def _both_ways(near: DataFrame, reverse: int) -> DataFrame:
    """(hub, node, fresh): each node with its neighbours, and with up to ``reverse`` that have it as theirs, new ones first."""
    ahead = near.select(F.col("node").alias("hub"), F.explode("near").alias("x")).select("hub", F.col("x.b").alias("node"), F.col("x.fresh").alias("fresh"), F.col("x.minus").alias("minus"))
    w = Window.partitionBy("hub").orderBy(F.desc("fresh"), "minus", "node")
    back = ahead.select(F.col("node").alias("hub"), F.col("hub").alias("node"), "fresh", "minus").withColumn("place", F.row_number().over(w)).where(F.col("place") <= reverse)
    return ahead.select("hub", "node", "fresh").unionByName(back.select("hub", "node", "fresh"))


def build(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 24, reverse: int = 24, settled: float = 0.05, members: int = 6, seed: int = 7) -> Graph:
    """The neighbour graph of all usable vectors.

    Rounds end when less than a share of ``settled`` of all links are new. ``members``: how many ids of equal vectors
    are kept, the least ones; a search returns at most one fewer of them.
    """
    tables, dims = Scratch(df.sparkSession), usual_length(df, vector)
    rows = packed(df, id_col, vector, dims)
    w = Window.partitionBy("raw").orderBy("id")
    least = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= members)
    nodes = least.groupBy("raw").agg(F.min("id").alias("node"), F.first("unit").alias("unit"), F.sort_array(F.collect_list("id")).alias("members"))
    nodes = tables.write(nodes.select("node", "raw", "unit", "members"), "nodes")
    units = nodes.select("node", "unit")
    codes = units.mapInArrow(_guesses(dims, seed), "turn long, code long, node long, unit binary")
    blocks = codes.repartitionByRange("turn", "code", "node").sortWithinPartitions("turn", "code", "node").select("node", "unit")
    edge = "a long, b long, s float"
    near = tables.write(_nearest(blocks.mapInArrow(_in_blocks(dims), edge).withColumn("fresh", F.lit(True)), k), "near-0")
    step = 0
    while True:
        worst = near.select("node", F.when(F.size("near") < k, F.lit(-2.0)).otherwise(-F.element_at("near", -1)["minus"]).cast("float").alias("worst"))
        held = units.join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0).cast("float")))
        gathered = _both_ways(near, reverse).join(held, "node").repartition("hub").sortWithinPartitions("hub").select("hub", "node", "fresh", "worst", "unit")
        found = gathered.mapInArrow(_around(dims), edge).withColumn("fresh", F.lit(True))
        old = near.select(F.col("node").alias("a"), F.explode("near").alias("x")).select("a", F.col("x.b").alias("b"), (-F.col("x.minus")).alias("s"), F.lit(False).alias("fresh"))
        step += 1
        near = tables.write(_nearest(old.unionByName(found), k), f"near-{step}")
        tables.drop(f"near-{step - 1}")
        new = near.agg(F.sum(F.size(F.filter("near", lambda x: x["fresh"]))).alias("new"), F.sum(F.size("near")).alias("all")).first()
        if (new["new"] or 0) <= settled * (new["all"] or 0):
            break
    near = near.withColumn("near", F.transform("near", lambda x: x.withField("fresh", F.lit(False))))
    links = _both_ways(near, reverse).groupBy(F.col("hub").alias("node")).agg(F.collect_set("node").alias("around"))
    return Graph(nodes, tables.write(links, "links"), dims, tables)


_STATE = pa.schema([("q", pa.int64()), ("unit", pa.binary()), ("beam", pa.list_(pa.int64())), ("near", pa.list_(pa.float32())), ("open", pa.list_(pa.bool_())), ("seen", pa.list_(pa.int64())), ("front", pa.list_(pa.int64()))])
_STATE_SQL = "q long, unit binary, beam array<long>, near array<float>, open array<boolean>, seen array<long>, front array<long>"


def _step(dims: int, beam: int, width: int):
    """A query's state and the nodes it sees now: the beam's nearest that are still closed are looked round next."""

    def update(state: pa.Table, seen: pa.Table) -> pa.Table:
        row = state.to_pylist()[0]
        own = np.frombuffer(row["unit"], np.float32).astype(np.float32)
        there = seen.combine_chunks().to_batches()[0] if seen.num_rows else None
        names = there["node"].to_numpy() if there else np.empty(0, np.int64)
        near = _floats(there["unit"], np.float32, dims).astype(np.float32) @ own if there else np.empty(0, np.float32)
        ids, score, closed = np.concatenate([row["beam"], names]).astype(np.int64), np.concatenate([row["near"], near]).astype(np.float32), np.concatenate([row["open"], np.ones(len(names), bool)]).astype(bool)
        top = np.lexsort((ids, -score))[:beam]
        ids, score, closed = ids[top], score[top], closed[top]
        front = np.flatnonzero(closed)[:width]
        closed[front] = False
        out = {"q": row["q"], "unit": row["unit"], "beam": ids.tolist(), "near": score.tolist(), "open": closed.tolist(), "seen": row["seen"] + names.tolist(), "front": ids[front].tolist()}
        return pa.Table.from_pylist([out], _STATE)

    return update


def _cosines(dims: int):
    """The cosine of two vectors in double precision."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_floats(batch[c], np.float64, dims) for c in ("own", "raw"))
            a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if len(x) else x for x in (a, b))
            score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
            yield pa.RecordBatch.from_arrays([batch["q"], pa.array(score), batch["members"]], ["q", "score", "members"])

    return rows


def search(graph: Graph, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", n: int = 5, beam: int = 200, width: int = 64, seeds: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``n`` nearest rows found for each query, but for rows of its own id.

    A query whose vector is in the graph starts at its node; any other at ``seeds`` nodes drawn by hash. Equal vectors
    are searched once. At the end the whole beam is measured again on the original vectors in double precision; ties
    go to the smaller id. ``n`` is below the number of members that the graph was built with.
    """
    dims, tables = graph.dims, graph.tables
    wanted = packed(queries, id_col, vector, dims).withColumnRenamed("id", "query_id")
    one = wanted.groupBy("raw").agg(F.min("query_id").alias("q"), F.first("unit").alias("unit"))
    starts = [r["node"] for r in graph.nodes.select("node").orderBy(F.xxhash64("node")).limit(seeds).collect()]
    entry = F.when(F.col("node").isNotNull(), F.array("node")).otherwise(F.array(*map(F.lit, starts)).cast("array<long>"))
    one = tables.write(one.join(graph.nodes.select("raw", "node"), "raw", "left").select("q", "raw", "unit", entry.alias("front")), "queries")
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    units = graph.nodes.select("node", "unit")
    # the entries themselves are seen first; the query's own node among them is measured like any other
    state = one.select("q", "unit", empty("long").alias("beam"), empty("float").alias("near"), empty("boolean").alias("open"), empty("long").alias("seen"), "front")
    step, fresh = 0, state.select("q", F.explode("front").alias("node"))
    while True:
        now = state.groupBy("q").cogroup(fresh.join(units, "node").select(F.col("q").alias("to"), "node", "unit").groupBy("to")).applyInArrow(_step(dims, beam, width), _STATE_SQL)
        state = tables.write(now, f"beam-{step}")
        tables.drop(f"beam-{step - 1}")
        if state.where(F.size("front") > 0).isEmpty():
            break
        step += 1
        around = state.select("q", F.explode("front").alias("node")).join(graph.links, "node").groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("around"))).alias("around"))
        fresh = around.join(state.select("q", "seen"), "q").select("q", F.explode(F.array_except("around", "seen")).alias("node"))
    pairs = state.select("q", F.explode("beam").alias("node")).join(one.select("q", F.col("raw").alias("own")), "q").join(graph.nodes.select("node", "raw", "members"), "node")
    scored = pairs.select("q", "own", "raw", "members").mapInArrow(_cosines(dims), "q long, score double, members array<long>")
    rows = scored.select("q", (-F.col("score")).alias("minus"), F.explode("members").alias("vec_id"))
    best = rows.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("minus", "vec_id"))), 1, n + 1).alias("best"))
    found = wanted.select("query_id", "raw").join(one.select("raw", "q"), "raw").join(best, "q")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, n)
    return found.select("query_id", F.posexplode(others).alias("place", "x")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))


def nearest_rows(df: DataFrame, queries: Column | str, id_col: str = "vec_id", vector: str = "embedding", n: int = 5) -> DataFrame:
    """Build the graph of ``df`` and search it for its rows where ``queries`` holds: (query_id, rank, vec_id, score).

    Vectors that are null, zero, of another length than most, or that hold a null or a number that isn't finite take
    no part, neither do rows without an id. Rows that repeat count once; an id with several vectors has the least of
    them. A query has fewer than ``n`` rows where fewer rows are found; an empty table gives an empty result. Further
    columns are ignored.
    """
    graph = build(df, id_col, vector, members=n + 1)
    return search(graph, df.where(queries), id_col, vector, n)
