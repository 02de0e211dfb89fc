"""Benchmark decontamination with an Aho-Corasick automaton over normalised item windows.

A text is normalised to lower-case words joined by single spaces; an item contributes each window
of 13 consecutive words (all its words where it has fewer). One automaton holds every window, so a
document is scanned once however many items there are. Normalised word positions are mapped back
to byte-exact character offsets of the original text.

The automaton is broadcast and every Python worker builds it, so its size is estimated first. Windows that
would need more than ``max_automaton_bytes`` are dealt over several automata of at most that size. Documents
are then read once to leave out those without any window, by a bitmap of the windows' hashes of one fixed
size; the others are scanned with one automaton after the other, each released when its scan is written.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_and_text, resident, small_batches, written

#: Characters that are no part of a word: all of ASCII but digits and letters.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: On UTF-8 bytes: separators become a space, A-Z lower case, everything else stays.
_FOLD = bytes(0x20 if b in SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_WORD = re.compile(rb"[^ ]+")
WINDOW = 13


def words_of(text: str | None) -> list[str]:
    """Normalised words; each UTF-8 byte is one character, so that automata stay on single bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).decode("latin-1").split(" ")


def _clean(words: list[str]) -> list[str]:
    return [w for w in words if w]


def windows_of(text: str | None, size: int = WINDOW) -> list[str]:
    """The distinct windows of an item, in order."""
    words = _clean(words_of(text))
    if not words:
        return []
    return list(dict.fromkeys(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))))


def _window_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids, out = [], []
            for item, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                own = windows_of(text, size)
                ids += [item] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["item_id", "window"])

    return rows


def _automaton(patterns: dict[str, list[int]]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for pattern, items in patterns.items():
        # a leading and a trailing space keep matches to whole words
        machine.add_word(f" {pattern} ", (pattern.count(" ") + 1, items))
    machine.make_automaton()
    return machine


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans (first word, end word) as character offsets of the original text, end exclusive."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    chars = lambda byte: len(raw[:byte].decode("utf-8", "surrogatepass"))
    return [(chars(at[a][0]), chars(at[b - 1][1])) for a, b in spans]


def _spans(words: list[str], machine) -> tuple[list[tuple[int, int]], set[int]]:
    """Word spans of every window's occurrences, and the items whose windows they are."""
    hit: list[tuple[int, int]] = []
    found: set[int] = set()
    starts: list[int] = []
    for end, (count, ids) in machine.iter(f" {' '.join(words)} "):
        if not starts:
            at = 0
            for w in words:
                starts.append(at)
                at += len(w) + 1
        last = bisect_right(starts, end - 1)  # words that start before the closing space
        hit.append((last - count, last))
        found.update(ids)
    return hit, found


def _scan(shared, key: str):
    """Arrow function: the automaton's results for each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = resident(("windows", key), lambda: _automaton(shared.value) if shared.value else None)
        for batch in small_batches(batches, 4 << 20):
            n_words, spans, offsets, items = [], [], [], []
            for text in batch["text"].to_pylist():
                words = _clean(words_of(text))
                n_words.append(len(words))
                hit, found = _spans(words, machine) if machine is not None and words else ([], set())
                hit = _merge(hit)
                spans.append([x for s in hit for x in s])
                offsets.append([x for s in char_spans(text, hit) for x in s] if hit else [])
                items.append(sorted(found))
            yield _finished(batch["doc_id"], batch["row_key"], pa.array(n_words, pa.int64()), spans, offsets, items)

    return rows


def _part_scan(shared, key: str):
    """Arrow function: for each document that one of several automata finds windows in, their spans and items."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = resident(("windows", key), lambda: _automaton(shared.value))
        for batch in small_batches(batches, 4 << 20):
            out = []
            for i, row_key, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "row_key", "text"))):
                hit, found = _spans(_clean(words_of(text)), machine)
                if hit:
                    hit = sorted(set(hit))
                    out.append({"doc_id": i, "row_key": row_key, "word_spans": [x for h in hit for x in h], "char_spans": [x for h in char_spans(text, hit) for x in h], "items": sorted(found)})
            yield pa.RecordBatch.from_pylist(out, _PART)

    return rows


_PART = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("word_spans", pa.list_(pa.int64())), ("char_spans", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])
#: Bits of the bitmap that stands for windows beyond one automaton: 16 MB, whatever their number.
BITS = 1 << 27


def _window_hashes(words: list[str], size: int) -> np.ndarray:
    """One 64-bit hash for each run of ``size`` words."""
    import xxhash

    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    out = h[: len(h) - size + 1].copy()
    for j in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - size + 1 + j]
    return (out ^ (out >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)


def _bits_of_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.array([int(_window_hashes(w.split(" "), w.count(" ") + 1)[0]) % BITS for w in batch["window"].to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at >> 6, pa.int64()), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64), pa.int64())], ["place", "bits"])


def _sifted(shared, sizes: list[int]):
    """Arrow function: each document's words, and its text if the bitmap holds the hash of one of its windows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in small_batches(batches, 4 << 20):
            n_words, kept = [], []
            for text in batch["text"].to_pylist():
                words = _clean(words_of(text))
                n_words.append(len(words))
                at = (_window_hashes(words, size) % np.uint64(BITS) for size in sizes if size <= len(words))
                kept.append(text if any((bits[h >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1)).any() for h in at) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row_key"], pa.array(n_words, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "row_key", "n_words", "text"])

    return rows


def _by_parts(rows: DataFrame, patterns: DataFrame, parts: int) -> DataFrame:
    """Results of ``parts`` automata: documents that may hold a window are scanned with each in turn."""
    spark, tables = rows.sparkSession, Scratch(rows.sparkSession)
    sizes = [r["k"] for r in patterns.select((F.length("window") - F.length(F.replace("window", F.lit(" "))) + 1).alias("k")).distinct().collect()]  # at most WINDOW rows
    marked = patterns.select("window").mapInArrow(_bits_of_windows, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    bits = np.zeros(BITS >> 6, np.uint64)
    filled = marked.toArrow()  # at most BITS / 64 rows, 32 MB
    bits[filled["place"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)
    seen = tables.write(rows.mapInArrow(_sifted(shared, sorted(sizes)), "doc_id long, row_key long, n_words long, text string"), "sifted")
    shared.destroy()
    texts = tables.write(seen.where(F.col("text").isNotNull()).dropDuplicates(["doc_id", "row_key"]), "texts")
    found = None
    for part in range(parts):
        own = patterns.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part).collect()  # within the bound of one automaton
        shared = spark.sparkContext.broadcast({r["window"]: r["items"] for r in own})
        hits = texts.mapInArrow(_part_scan(shared, uuid.uuid4().hex), "doc_id long, row_key long, word_spans array<long>, char_spans array<long>, items array<long>")
        hits = tables.write(hits, f"part-{part}")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    many = found.groupBy("doc_id", "row_key").agg(flat("word_spans"), flat("char_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("item_ids"))
    many = tables.write(many.withColumnsRenamed({"doc_id": "own_id", "row_key": "own_key"}), "hits")
    tables.drop("texts", *(f"part-{part}" for part in range(parts)))
    none = F.array().cast("array<bigint>")
    both = seen.drop("text").join(many, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("row_key") == F.col("own_key")), "left")
    return both.select("doc_id", "row_key", "n_words", *(F.coalesce(c, none).alias(c) for c in ("word_spans", "char_spans", "item_ids"))).mapInArrow(_merged, _FINISHED)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 4 << 20):
        flat = lambda name: [[x for s in _merge(list(zip(v[::2], v[1::2]))) for x in s] for v in batch[name].to_pylist()]
        # overlapping runs of words overlap in characters too; runs that touch have a gap between
        words, chars = flat("word_spans"), batch["char_spans"].to_pylist()
        places = [[x for a, b in zip(w[::2], w[1::2]) for x in _covering(a, b, own, c)] for w, own, c in zip(words, batch["word_spans"].to_pylist(), chars)]
        yield _finished(batch["doc_id"], batch["row_key"], batch["n_words"], words, places, batch["item_ids"].to_pylist())


def _covering(a: int, b: int, words: list[int], chars: list[int]) -> tuple[int, int]:
    """The characters of the word span (a, b), from spans of which one starts with it and one ends with it."""
    return chars[2 * words[::2].index(a)], chars[2 * words[1::2].index(b) + 1]


def _finished(ids: pa.Array, keys: pa.Array, n_words: pa.Array, spans: list[list[int]], chars: list[list[int]], items: list[list[int]]) -> pa.RecordBatch:
    """Counts and digests from merged word spans, their characters and item ids."""
    n_hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
    digests = [hashlib.sha256(",".join(sorted({str(i) for i in own})).encode()).hexdigest() for own in items]
    return pa.RecordBatch.from_arrays(
        [ids, keys, n_words, pa.array(n_hit, pa.int64()), pa.array([len(set(i)) for i in items], pa.int64()), pa.array(digests, pa.string()), pa.array(chars, pa.list_(pa.int64()))],
        ["doc_id", "row_key", "n_words", "n_hit", "n_items", "items_sha256", "char_spans"],
    )


_FINISHED = "doc_id long, row_key long, n_words long, n_hit long, n_items long, items_sha256 string, char_spans array<long>"


#: Bytes of an automaton for a byte of its windows, and for an item that a window names, as measured.
NODE_BYTES, ITEM_BYTES = 45, 64


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_cols: tuple[str, ...] = ("text",),
    window: int = WINDOW,
    max_automaton_bytes: int = 256 << 20,
    keyed: bool = False,
) -> DataFrame:
    """One row per document: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``char_spans``, ``contaminated``.

    ``item_text_cols`` are an item's question, answers and so on; windows never run from one into
    the next. ``char_spans`` holds start and end of each hit stretch in the original text.
    ``contaminated``: something is hit, and at least one word in twenty. ``keyed``: a hash of the text too, ``row_key``.

    Null and empty texts have no words and are never contaminated; items without words or with a
    null id have no windows. Repeated document rows are each judged and returned; repeated items
    count once. Further columns of either table are ignored. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    parts = [id_and_text(benchmark, item_col, c).where("doc_id is not null") for c in item_text_cols]
    items = parts[0]
    for more in parts[1:]:
        items = items.unionByName(more)
    patterns = written(
        items.mapInArrow(_window_rows(window), "item_id long, window string").groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items")),
        "windows",
    )
    size = patterns.agg(F.coalesce(F.sum(NODE_BYTES * F.length("window") + ITEM_BYTES * F.size("items")), F.lit(0))).first()[0]
    rows = id_and_text(docs, id_col, text_col).withColumn("row_key", F.xxhash64("text"))
    if size > max_automaton_bytes:
        found = _by_parts(rows, patterns, -(-size // max_automaton_bytes))
    else:
        shared = spark.sparkContext.broadcast({r["window"]: r["items"] for r in patterns.collect()})
        # workers outlive calls, so the key must never come again
        found = rows.mapInArrow(_scan(shared, uuid.uuid4().hex), _FINISHED)
    return found.select(
        *(["row_key"] if keyed else []), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "char_spans"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without contaminated documents, all columns kept.

    The decision is joined back by id and a hash of the text, so a clean row stays where another row of its id goes.
    """
    bad = benchmark_hits(docs, benchmark, id_col, text_col, keyed=True, **how).where("contaminated").select(F.col("doc_id").alias("_gf_id"), F.col("row_key").alias("_gf_key")).distinct()
    # written first: the join then knows how few there are, and broadcasts them only if they are
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_gf_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_gf_key"))
    return docs.join(written(bad, "contaminated"), same, "left_anti")
