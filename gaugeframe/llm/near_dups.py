"""Near-duplicates by min-max hashing.

A document is its set of distinct word shingles. One pass over the text hashes the set under
``permutations`` maps and keeps the minimum and the maximum of each, which gives two signature values
for one evaluation. Values are banded; documents that share a band are candidates, and candidates are
confirmed on the full sets. With 120 maps, 240 values in 40 bands of 6, a pair at similarity 0.8 is
missed with probability (1 - 0.8^6)^40 < 6e-6.

Groups never become all their pairs. Documents with equal sets are one class. In each band bucket every
member is compared with the bucket's lead, and members linked to the lead are one component. What a
member and its lead do not have in common is kept as the member's difference; of two members with
differences D and E, the sets differ in |D| + |E| - 2 |D and E| shingles, whatever the lead. So members of
different components can only be alike if their differences overlap enough, and such pairs are found by
an exact prefix filter over the differences, rarest shingles first (see ``_across``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, id_and_text, resident, small_batches, written
from .graph import components

PERMUTATIONS, ROWS = 120, 6
#: Ids are broadcast up to this many (16 MB), and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Members of a lead that one task takes at a time.
PART_MEMBERS = 1000
MOST_WORDS = 150_000
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class _Words(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MOST_WORDS:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; with fewer words, of all its words as one."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(resident("words", _Words).__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = _mixed(out) + h[j : len(h) - k + 1 + j]
    return np.unique(_mixed(out + np.uint64(k)))


def signatures(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """Minima, then maxima, under each map: one row a set, none of which may be empty."""
    rng = np.random.default_rng(1)
    factor = rng.integers(0, 1 << 31, permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 1 << 32, permutations, dtype=np.uint32)
    sizes = np.array([len(s) for s in sets])
    begins = np.cumsum(sizes) - sizes
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((2 * permutations, len(sets)), np.uint32)
    for p in range(permutations):
        x = (low ^ shift[p]) * factor[p]
        out[p] = np.minimum.reduceat(x, begins)
        out[permutations + p] = np.maximum.reduceat(x, begins)
    return out.T


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for every ``rows`` signature values, different for each band."""
    n, width = signature.shape
    bands = width // rows
    parts = signature[:, : bands * rows].reshape(n, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, bands))
    for r in range(rows):
        key = _mixed(key + parts[:, :, r])
    return key


def _signed(size: int, permutations: int, rows_in_band: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in small_batches(batches, 2 << 20):
            sets = [shingle_set(t, size) for t in batch["text"].to_pylist()]
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(signatures(full, permutations), rows_in_band).view(np.int64) if full else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["text_key"],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "text_key", "n_shingles", "set_key", "bands"],
            )

    return rows


def _full_sets(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in small_batches(batches, 2 << 20):
            sets = [s for s in (shingle_set(t, size) for t in batch["text"].to_pylist()) if len(s)]
            keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["set_key", "shingles"])

    return rows


def _among(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose key is among the distinct ids, broadcast only below a checked bound."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, on, "left_semi")


def _member_sets(rows: DataFrame, classes: DataFrame, members: DataFrame, size: int, tables: Scratch) -> DataFrame:
    """(node, shingles) of each class that shares a bucket: once, however often its row is repeated."""
    nodes = tables.write(_among(classes.select("node", "rep", "set_key"), members.select("node").distinct(), "node"), "nodes")
    texts = _among(rows, nodes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id")
    sets = tables.write(texts.mapInArrow(_full_sets(size), "set_key binary, shingles array<long>"), "sets")
    if sets.count() > nodes.count():  # repeated rows, or an id with several texts
        sets = tables.write(sets.dropDuplicates(["set_key"]), "sets")
    return nodes.select("node", "set_key").join(sets, "set_key").select("node", "shingles")


def _in_parts(rows: DataFrame, tables: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows (a, b, ...) with a ``part`` of their lead a, and (a, parts) of the leads that have several.

    A lead of many members would be one task; its members are dealt over parts by hash. Leads with
    several parts are at most one in ``PART_MEMBERS`` rows.
    """
    sizes = rows.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART_MEMBERS)
    hot = tables.write(sizes.select("a", F.ceil(F.col("n") / PART_MEMBERS).cast("int").alias("parts")), name)
    few = hot.count() <= BROADCAST_IDS
    dealt = rows.join(F.broadcast(hot) if few else hot, "a", "left")
    return dealt.withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts"), hot


def _for_parts(leads: DataFrame, hot: DataFrame) -> DataFrame:
    """One row of each lead for each of its parts."""
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    return leads.join(hot, "a", "left").withColumn("part", F.explode(parts)).drop("parts")


def _star_tests(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each lead a and member b: sizes, the shingles in one set but not the other, and whether they are linked."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    apart = F.concat(F.array_except("of_a", "of_b"), F.array_except("of_b", "of_a"))
    size = lambda x: F.size(x).cast("long")
    # both joins read one shuffle of the sets; Spark splits a lead whose members are too many for a task
    rows = stars.join(one, "a").join(other, "b").select("a", "b", size("of_a").alias("n_a"), size("of_b").alias("n_b"), apart.alias("apart"))
    # 100 * shared >= percent * union, written with the number of shingles apart
    return rows.withColumn("linked", (100 - percent) * (F.col("n_a") + F.col("n_b")) >= (100 + percent) * size("apart"))


def _across(cells: DataFrame, percent: int, tables: Scratch) -> DataFrame:
    """Pairs (a: the lead, x, c, needed) of different components whose differences may overlap enough.

    ``cells``: (a, b: a member, excess, apart, component, inside: whether it's the lead's component).
    With excess = (100 + percent) |difference| - (100 - percent) |set|, two members are linked just where
    their differences share at least (excess + excess) / (2 (100 + percent)) shingles. For one that
    isn't linked to the lead that is always more than none.

    Shingles are ordered by how many differences hold them. Those that only one component's members
    hold can't be shared and go. Of r that are left, a pair that needs t in common has one of them
    among the first r - t + 1 of both.
    """
    per = 2.0 * (100 + percent)
    needed = lambda total: F.ceil(total / per).cast("long")
    low = cells.groupBy("a").agg(F.min("excess").alias("least"), F.min(F.when(~F.col("inside"), F.col("excess"))).alias("least_outside"))
    # the fewest that any pair of a member can need; one of a pair is outside
    fewest = F.greatest(F.lit(1), needed(F.col("excess") + F.when(F.col("inside"), F.col("least_outside")).otherwise(F.col("least"))))
    dealt, hot = _in_parts(cells, tables, "hot-cells")
    members = dealt.join(_for_parts(low, hot), ["a", "part"]).select("a", "b", "component", "excess", "inside", fewest.alias("fewest"), "apart")
    held = members.where(F.size("apart") >= F.col("fewest")).select("a", "b", "component", "excess", "inside", "fewest", F.explode("apart").alias("shingle"))
    known = held.groupBy("a", "shingle").agg(F.count(F.lit(1)).alias("holders"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    own = Window.partitionBy("a", "b")
    place = F.row_number().over(own.orderBy("holders", "shingle"))
    ranked = held.join(known.select("a", "shingle", "holders"), ["a", "shingle"]).withColumn("r", F.count(F.lit(1)).over(own)).withColumn("q", place).where("q <= r - fewest + 1")
    ranked = ranked.select("a", "shingle", "b", "component", "excess", "inside", "r", "q")
    x = ranked.where("not inside").select("a", "shingle", *(F.col(name).alias(f"{name}_x") for name in ("b", "component", "excess", "r", "q")))
    c = ranked.select("a", "shingle", *(F.col(name).alias(f"{name}_c") for name in ("b", "component", "excess", "inside", "r", "q")))
    t = needed(F.col("excess_x") + F.col("excess_c"))
    once = F.col("inside_c") | (F.col("b_x") < F.col("b_c"))
    # what both can still share, before and after this shingle
    room = F.least("q_x", "q_c") + F.least(F.col("r_x") - F.col("q_x"), F.col("r_c") - F.col("q_c"))
    fits = (F.col("q_x") <= F.col("r_x") - t + 1) & (F.col("q_c") <= F.col("r_c") - t + 1) & (room >= t)
    pairs = x.join(c, ["a", "shingle"]).where((F.col("component_x") != F.col("component_c")) & once & fits)
    return pairs.select("a", F.col("b_x").alias("x"), F.col("b_c").alias("c"), t.alias("needed")).distinct()


def _linked_across(cells: DataFrame, percent: int, tables: Scratch) -> DataFrame:
    """Links (a, b) between the components that ``cells`` still have, as pairs of components."""
    side = lambda name: cells.select("a", F.col("b").alias(name), F.col("apart").alias(f"apart_{name}"), F.col("component").alias(f"of_{name}"))
    pairs = _across(cells, percent, tables).join(side("x"), ["a", "x"]).join(side("c"), ["a", "c"])
    alike = pairs.where(F.size(F.array_intersect("apart_x", "apart_c")) >= F.col("needed"))
    return alike.select(F.col("of_x").alias("a"), F.col("of_c").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    permutations: int = PERMUTATIONS,
    rows_in_band: int = ROWS,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    Texts whose sets share at least ``percent`` % of their union are linked; ``component_id`` is the
    smallest id reachable by links, and ``kept`` marks the document that has it.

    Null, empty and wordless texts have 0 shingles and stand alone, and so do rows with a null id
    (``component_id`` null, kept). Repeated rows get the same answer. Rows that share an id but not a
    text follow their own text's component. Further columns are ignored.
    """
    return _classified(docs, id_col, text_col, shingle_words, percent, permutations, rows_in_band).drop("text_key")


def _classified(docs: DataFrame, id_col: str, text_col: str, shingle_words: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows_in_band: int = ROWS) -> DataFrame:
    """``near_duplicates`` with a hash of each row's text."""
    rows = id_and_text(docs, id_col, text_col)
    tables = Scratch(rows.sparkSession)
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    signed = written(keyed.mapInArrow(_signed(shingle_words, permutations, rows_in_band), "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>"), "signed")
    # equal sets: one class, whose node is its smallest id; where ids repeat, another class may have taken that
    full = signed.where("doc_id is not null and n_shingles > 0")
    classes = tables.write(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    taken = tables.write(classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.min("set_key").alias("first")).where("n > 1"), "taken")
    if taken.isEmpty():
        classes = classes.withColumn("node", F.col("rep"))
    else:
        classes = classes.join(taken, "rep", "left").withColumn("node", F.when(F.col("set_key") != F.col("first"), F.xxhash64("set_key", "rep")).otherwise(F.col("rep")))
    buckets = classes.select(F.explode("bands").alias("bucket"), "node")
    shared = tables.write(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = tables.write(buckets.join(shared, "bucket"), "members")
    # a bucket's lead is the member that meets most others over all its buckets: the middle of its group
    middle = members.groupBy("node").agg(F.sum("size").alias("meets"))
    leads = members.join(middle, "node").groupBy("bucket").agg(F.max(F.struct("meets", (-F.col("node")).alias("minus"))).alias("lead")).select("bucket", (-F.col("lead.minus")).alias("lead"))
    stars = members.join(leads, "bucket").where(F.col("lead") != F.col("node")).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    sets = _member_sets(rows, classes, members, shingle_words, tables)
    tested = tables.write(_star_tests(tables.write(stars, "stars"), sets, percent), "tested")
    tables.drop("buckets", "members", "nodes", "sets", "stars")
    linked = components(tested.where("linked").select("a", "b"))
    # cells whose members are of several components: look for links across them
    at = linked.withColumnRenamed("node", "at")
    placed = tested.select("a", "b", "n_b", F.size("apart").cast("long").alias("d"))
    for end in ("a", "b"):
        placed = placed.join(at.select(F.col("at").alias(end), F.col("component").alias(f"of_{end}")), end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    excess = (100 + percent) * F.col("d") - (100 - percent) * F.col("n_b")
    placed = placed.select("a", "b", excess.alias("excess"), F.col("of_b").alias("component"), (F.col("of_a") == F.col("of_b")).alias("inside"))
    placed = tables.write(placed, "placed")
    mixed = placed.where("not inside").select("a").distinct()
    cells = tables.write(placed.join(mixed, "a", "left_semi").join(tested.select("a", "b", "apart"), ["a", "b"]), "cells")
    tables.drop("tested", "placed")
    more = tables.write(_linked_across(cells, percent, tables), "links")
    tables.drop("cells", "hot-cells")
    if not more.isEmpty():
        joined = components(more).select(F.col("node").alias("component"), F.col("component").alias("into"))
        linked = linked.join(joined, "component", "left").select("node", F.coalesce("into", "component").alias("component")).unionByName(
            # classes that had no link before
            joined.join(linked.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("into").alias("component"))
        )
    known = classes.select("set_key", "node", "rep")
    placed = linked.join(known, "node").select("set_key", "rep", "component")
    smallest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = written(known.join(placed.join(smallest, "component").select("set_key", "component_id"), "set_key", "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id")), "named")
    tables.drop("classes", "taken", "links")
    found = signed.drop("bands").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_key")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each component, all columns kept.

    Rows that repeat both id and text become one; rows with a null id are kept as they are. Where an
    id has several texts, each is judged by itself.
    """
    found = written(_classified(docs, id_col, text_col, **how), "near")
    here = [F.col(id_col).cast("long") == F.col("_gf_id"), F.xxhash64(F.col(text_col).cast("string")) == F.col("_gf_text")]
    key = [F.col("doc_id").alias("_gf_id"), F.col("text_key").alias("_gf_text")]
    kept = docs.join(found.where("not kept").select(*key).distinct(), here, "left_anti")
    again = found.where("doc_id is not null").groupBy("doc_id", "text_key").count().where("count > 1").select(*key)
    again = written(again, "again")
    if again.isEmpty():
        return kept
    same = Window.partitionBy(id_col, text_col).orderBy(F.lit(0))
    once = kept.join(again, here, "left_semi").withColumn("_gf_row", F.row_number().over(same)).where("_gf_row = 1").drop("_gf_row")
    return kept.join(again, here, "left_anti").unionByName(once)
