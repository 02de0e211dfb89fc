"""Repair of conversation structure by cheapest edits, found by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows taken, place in the pattern ``(s?(ua)+)?`` of role initials); edits are its arcs.
A forward and a reverse heap meet; both go on until no crossing as cheap as the best can be left, and among equal
costs the crossing with the least concatenated audit wins. At one node audits of equal cost never are each other's
prefixes (they differ in inserts, which cost), so least parts make least wholes.

Rows are dealt by ranges of conversation and turn, so a conversation of any length is spread over tasks. Each task
takes its rows in order. A conversation that lies in one task is solved there; of one that is cut by a range's
edge or is longer than ``CHUNK`` rows, each chunk gives the least audit from every place to every place, and these
are put together chunk by chunk.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, short_batches

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: Places in the pattern: nothing yet, after s, after u, after a; the conversation may end at the first and the last.
PLACES, START, ENDS = 4, 0, (0, 3)
STEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
NAMES = {"u": "user", "a": "assistant"}
#: Rows that are solved at once, at most; a chunk also ends when its texts have so many characters.
CHUNK, CHUNK_CHARS = 512, 4 << 20

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


class Row(NamedTuple):
    """A row of a conversation, and how many copies of it follow each other."""

    initial: str
    fault: int
    copies: int


def _arcs(row: Row) -> list[list[tuple[int, int, str]]]:
    """The edits of a row by the place before it: (place after, cost, audit). All copies but one are deleted."""
    more = row.copies - 1
    tail, price = DELETE * more, COST[DELETE] * more
    out = []
    for place in range(PLACES):
        arcs = [(place, COST[DELETE] + price, DELETE + tail)]
        if row.fault not in (BLANK, DUPLICATE):
            late = int(row.fault == TRUNCATED) + price
            for initial, to in STEP[place].items():
                if initial == row.initial:
                    arcs.append((to, COST[KEEP] + late, KEEP + tail))
                elif initial in NAMES:
                    arcs.append((to, COST[REROLE] + late, REROLE + tail))
        out.append(arcs)
    return out


_INSERTS = [[(to, COST[INSERT], INSERT) for initial, to in STEP[place].items() if initial in NAMES] for place in range(PLACES)]
_BEFORE = [[(p, c, a) for p in range(PLACES) for to, c, a in _INSERTS[p] if to == place] for place in range(PLACES)]

Label = tuple[int, str]


def cheapest(rows: list[Row], start: int, ends: tuple[int, ...]) -> Label | None:
    """The least cost from a place before the rows to one of the places after them, and its least audit."""
    n = len(rows)
    arcs = [_arcs(r) for r in rows]
    into = [[[(p, c, a) for p in range(PLACES) for to, c, a in row[p] if to == place] for place in range(PLACES)] for row in arcs]
    # labels that may still fall, settled ones, and heaps of (cost, rows on the way, place):
    # at equal cost the node with fewer rows on its side is settled first, as only free edits lie between
    open_f: dict[tuple[int, int], Label] = {(0, start): (0, "")}
    open_b: dict[tuple[int, int], Label] = {(n, e): (0, "") for e in ends}
    done_f: dict[tuple[int, int], Label] = {}
    done_b: dict[tuple[int, int], Label] = {}
    heap_f, heap_b = [(0, 0, start)], [(0, 0, e) for e in ends]
    best: Label | None = None

    def forward(i: int, place: int):
        yield from ((i, *arc) for arc in _INSERTS[place])
        if i < n:
            yield from ((i + 1, *arc) for arc in arcs[i][place])

    def backward(i: int, place: int):
        yield from ((i, *arc) for arc in _BEFORE[place])
        if i:
            yield from ((i - 1, *arc) for arc in into[i - 1][place])

    while heap_f and heap_b:
        if best is not None and heap_f[0][0] + heap_b[0][0] > best[0]:
            break
        ahead = heap_f[0][0] <= heap_b[0][0]
        heap = heap_f if ahead else heap_b
        mine, other, pending = (done_f, done_b, open_f) if ahead else (done_b, done_f, open_b)
        cost, way, place = heapq.heappop(heap)
        node = (way if ahead else n - way, place)
        if node in mine:
            continue
        label = mine[node] = pending.pop(node)
        for i, to, price, letter in (forward if ahead else backward)(*node):
            there = (i, to)
            if there in other:
                far = other[there]
                both = (label[0] + price + far[0], label[1] + letter + far[1] if ahead else far[1] + letter + label[1])
                if best is None or both < best:
                    best = both
            if there in mine:
                continue
            new = (label[0] + price, label[1] + letter if ahead else letter + label[1])
            if there not in pending or new < pending[there]:
                pending[there] = new
                heapq.heappush(heap, (new[0], i if ahead else n - i, to))
        if node in other:
            far = other[node]
            both = (label[0] + far[0], label[1] + far[1] if ahead else far[1] + label[1])
            if best is None or both < best:
                best = both
    return best


class Repaired:
    """Repaired rows as bytes, fed to a hash as they come."""

    def __init__(self) -> None:
        self.hash, self.place, self.first = hashlib.sha256(), START, True

    def _add(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False

    def feed(self, audit: str, rows: list[tuple[str, str, int]]) -> None:
        """Apply an audit to (role, text, copies) rows."""
        letters = iter(audit)
        for role, text, copies in rows:
            left = copies
            while left:
                edit = next(letters)
                if edit == INSERT:
                    self.insert()
                    continue
                left -= 1
                if edit == KEEP:
                    self._add(role, text)
                    self.place = STEP[self.place][role[:1]]
                elif edit == REROLE:
                    self.place, initial = self._due()
                    self._add(NAMES[initial], text)
        for _ in letters:
            self.insert()

    def insert(self) -> None:
        self.place, initial = self._due()
        self._add(NAMES[initial], "")

    def _due(self) -> tuple[int, str]:
        """Where the pattern goes by an edit that gives a role: one of user and assistant at each place."""
        return next((to, initial) for initial, to in STEP[self.place].items() if initial in NAMES)


def _told(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """``copies`` of each row after its damage, 0 for one that is dropped: by crc32(``conv_id:turn``) % 20, 0 drops
    the row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    kind = F.crc32(F.concat(_told(F.col("conv_id")), F.lit(":"), _told(F.col("turn"))).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(_told(F.col("text")), ".!?", "")).otherwise(_told(F.col("text")))
    role = F.when(kind == 4, "user").otherwise(_told(F.col("role")))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn counted together, each with its fault; rows that are gone have no copies.

    A text's first place in its conversation is a minimum by conversation and hash, which merges before the
    shuffle, and is joined back by hash.
    """
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("said", F.when(F.col("copies") > 0, said))
    rows = rows.groupBy("conv_id", "turn", "said").agg(F.sum("copies").alias("copies"), F.min("role").alias("role"), F.min("text").alias("text"))
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    first = rows.where("copies > 0").groupBy(F.col("conv_id").alias("_conv"), F.col("said").alias("_said")).agg(F.min(place).alias("_first"))
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    fault = F.when(last == "", BLANK).when(~place.eqNullSafe(F.col("_first")), DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return joined.select("conv_id", "turn", "role", "text", "said", "copies", F.when(F.col("copies") > 0, fault).otherwise(0).alias("fault"))


#: What a chunk tells: its place in order, its counts, its edges, and audits from place to place, or its whole result.
_CHUNK = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), ("whole", pa.bool_()), ("n", pa.int64()),
    ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("sha", pa.string()),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())),
])
_CHUNK_SQL = (
    "conv_id long, part long, chunk long, whole boolean, n long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, costs array<long>, audits array<string>, sha string, roles array<string>, texts array<string>, copies array<long>"
)
LEGAL = ("su", "ua", "au")


class _Chunk:
    """Rows of one conversation that follow each other, with what is counted on the way."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.rows, self.texts = conv_id, [], []
        self.turns: list[int] = []
        self.counts, self.illegal, self.chars = [0, 0, 0, 0], 0, 0

    def add(self, turn: int | None, role: str, text: str, fault: int, copies: int) -> None:
        if not copies:
            return
        initial = role[:1]
        if self.rows:
            self.illegal += self.rows[-1].initial + initial not in LEGAL
        self.illegal += (copies - 1) * (initial * 2 not in LEGAL)
        self.counts[fault] += 1 if fault != BLANK else copies
        self.counts[DUPLICATE] += copies - 1 if fault != BLANK else 0
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        self.rows.append(Row(initial, fault, copies))
        self.texts.append((role, text, copies))
        self.chars += len(text)

    def told(self, part: int, chunk: int, whole: bool) -> dict:
        out = {"conv_id": self.conv_id, "part": part, "chunk": chunk, "whole": whole, "n": sum(r.copies for r in self.rows), "low": min(self.turns, default=None), "high": max(self.turns, default=None), "turns": len(self.turns)}
        out |= {"blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[TRUNCATED], "illegal": self.illegal}
        out |= {"first": self.rows[0].initial if self.rows else None, "last": self.rows[-1].initial if self.rows else None}
        if whole:
            cost, audit = cheapest(self.rows, START, ENDS)
            made = Repaired()
            made.feed(audit, self.texts)
            return out | {"costs": [cost], "audits": [audit], "sha": made.hash.hexdigest(), "roles": None, "texts": None, "copies": None}
        found = [cheapest(self.rows, a, (b,)) for a in range(PLACES) for b in range(PLACES)]
        roles, texts, copies = zip(*self.texts) if self.texts else ((), (), ())
        return out | {"costs": [f and f[0] for f in found], "audits": [f and f[1] for f in found], "sha": None, "roles": roles, "texts": texts, "copies": copies}


def _chunks(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the first and the last conversation of a range may go on in another: they are never whole
        held, number, first, part, out = None, 0, True, 0, []
        for batch in batches:
            part = batch["part"][0].as_py() if batch.num_rows else part
            for conv_id, turn, role, text, fault, copies in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "copies"))):
                if held is not None and held.conv_id != conv_id:
                    out.append(held.told(part, number, not first and number == 0))
                    held, number, first = None, 0, False
                elif held is not None and (len(held.rows) >= size or held.chars >= CHUNK_CHARS):
                    out.append(held.told(part, number, False))
                    held, number = None, number + 1
                held = held or _Chunk(conv_id)
                held.add(turn, role, text, fault, copies)
            if out:
                yield pa.RecordBatch.from_pylist(out, _CHUNK)
                out = []
        if held is not None:
            yield pa.RecordBatch.from_pylist([held.told(part, number, False)], _CHUNK)

    return rows


def _together(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chunks of one conversation, without their texts: its figures, and the audit of each chunk.

    Each place after a chunk keeps the least way to it, and from where in the chunk before. What all ways
    start with tells them apart no more and is left out of the labels.
    """
    pdf = pdf.sort_values(["part", "chunk"])
    reach: list[Label | None] = [(0, "") if p == START else None for p in range(PLACES)]
    ways: list[list[int | None]] = []
    for costs, audits in zip(pdf["costs"], pdf["audits"]):
        new: list[Label | None] = [None] * PLACES
        came: list[int | None] = [None] * PLACES
        for a in range(PLACES):
            for b in range(PLACES):
                cost = costs[a * PLACES + b]
                if reach[a] is None or cost is None or cost != cost:
                    continue
                label = (reach[a][0] + int(cost), reach[a][1] + audits[a * PLACES + b])
                if new[b] is None or label < new[b]:
                    new[b], came[b] = label, a
        same = len(os.path.commonprefix([label[1] for label in new if label]))
        reach, ways = [label and (label[0], label[1][same:]) for label in new], [*ways, came]
    cost, _, end = min((*reach[e], e) for e in ENDS if reach[e] is not None)
    parts, at = [], end
    for came, audits in zip(reversed(ways), reversed(list(pdf["audits"]))):
        parts.append(audits[came[at] * PLACES + at])
        at = came[at]
    held = pdf[pdf["n"] > 0]
    edges = list(zip(held["last"][:-1], held["first"][1:]))
    spans = held[held["turns"] > 0]
    shared = int((spans["high"].to_numpy()[:-1] == spans["low"].to_numpy()[1:]).sum())
    low, high = (int(spans["low"].min()), int(spans["high"].max())) if len(spans) else (0, 0)
    gaps = high - low + 1 - (int(spans["turns"].sum()) - shared) if len(spans) else 0
    total = lambda c: int(pdf[c].sum())
    row = {"conv_id": pdf["conv_id"].iloc[0], "gaps": gaps, "blank": total("blank"), "duplicate": total("duplicate"), "truncated": total("truncated"), "illegal": total("illegal") + sum(a + b not in LEGAL for a, b in edges), "cost": cost, "audit": "".join(reversed(parts))}
    steps = [{"part": int(p), "chunk": int(c), "audit": a} for p, c, a in zip(pdf["part"], pdf["chunk"], reversed(parts))]
    return pd.DataFrame([row | {"steps": steps}])


_FIGURES = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of conversation, part and chunk: the hash of each conversation's repaired rows, as they stream by."""
    at, made = None, None
    schema = pa.schema([("_conv", pa.int64()), ("repaired_sha256", pa.string())])
    for batch in batches:
        out = []
        for conv_id, audit, roles, texts, copies in zip(*(batch[c].to_pylist() for c in ("conv_id", "audit", "roles", "texts", "copies"))):
            if made is None or conv_id != at:
                if made is not None:
                    out.append({"_conv": at, "repaired_sha256": made.hash.hexdigest()})
                at, made = conv_id, Repaired()
            made.feed(audit, list(zip(roles, texts, copies)))
        yield pa.RecordBatch.from_pylist(out, schema)
    if made is not None:
        yield pa.RecordBatch.from_pylist([{"_conv": at, "repaired_sha256": made.hash.hexdigest()}], schema)


def repair(rows: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, copies): counts of faults, ``gaps`` between its
    turns, ``illegal`` neighbours, the ``cost`` and ``audit`` of its cheapest repair, ``repaired_sha256`` of the result.

    A conversation's rows are ordered by turn, nulls first, then by hash of role and text, which settles ties: equal
    rows lie side by side. Rows with 0 copies are gone but keep their conversation in the result, with zeros, an empty
    audit and the hash of nothing where no row is left. A null conversation is one of its own; null roles and texts
    count as one space. Further columns are ignored; an empty table gives an empty result. Texts are taken whole.

    What meets in one task is: the rows of a range; the audits of a conversation's chunks, a few bytes a row; and, one
    after the other, never at once, the chunks of a conversation for its hash, which has to be taken in order.
    """
    if not chunk_rows > 0:
        raise ValueError("chunk_rows must be above 0")
    spark = rows.sparkSession
    short_batches(spark)
    told = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _told(F.col("role")).alias("role"), _told(F.col("text")).alias("text"), F.col("copies").cast("long").alias("copies"))
    tables = Scratch(spark)
    dealt = _marked(told).repartitionByRange("conv_id", "turn", "said").withColumn("part", F.spark_partition_id().cast("long")).sortWithinPartitions("conv_id", "turn", "said")
    chunks = tables.write(dealt.mapInArrow(_chunks(chunk_rows), _CHUNK_SQL), "conversation-chunks")
    span = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    whole = chunks.where("whole").select("conv_id", span.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"), F.col("sha").alias("repaired_sha256"))
    cut = chunks.where("not whole")
    both = cut.drop("roles", "texts", "copies", "whole", "sha").groupBy("conv_id").applyInPandas(_together, f"{_FIGURES}, steps array<struct<part: long, chunk: long, audit: string>>")
    both = tables.write(both, "conversation-audits")
    steps = both.select(F.col("conv_id").alias("_conv"), F.explode("steps").alias("_s")).select("_conv", "_s.*")
    same = cut["conv_id"].eqNullSafe(steps["_conv"]) & (cut["part"] == steps["part"]) & (cut["chunk"] == steps["chunk"])
    texts = cut.select("conv_id", "part", "chunk", "roles", "texts", "copies").join(steps, same).select(cut["conv_id"], cut["part"], cut["chunk"], "audit", "roles", "texts", cut["copies"])
    hashes = texts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(_hashes, "_conv long, repaired_sha256 string")
    rest = both.join(hashes, both["conv_id"].eqNullSafe(hashes["_conv"])).drop("steps", "_conv")
    return whole.unionByName(rest)
