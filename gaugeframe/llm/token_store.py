"""Token-id files: one wavelet matrix a segment, several segments a shard, one shard a file.

A shard is one Parquet file, written by one task over a range of document ids. Each of its rows is a
segment: about two million ids of consecutive documents as packed bit-planes, a rank directory for
every plane, and an index of its documents. Any segment answers token access, counting and
occurrence lookup by rank and select, without the ids being expanded.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, resident, scratch_dir, small_batches

END_ID = 2
SEGMENT_IDS = 2_000_000
#: Bits between two entries of a rank directory.
_STEP = 512
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


class WaveletMatrix:
    """A sequence of ids as bit-planes, highest bit first, each stably parted by its bits."""

    def __init__(self, n: int, planes: list[bytes], zeros: list[int], ranks: list[bytes]):
        self.n, self.zeros = n, list(zeros)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        planes, zeros, ranks = [], [], []
        for b in range(width - 1, -1, -1):
            bits = (ids & ids.dtype.type(1 << b)) != 0
            packed = np.packbits(bits)
            ones = np.add.reduceat(_ONES[packed], np.arange(0, len(packed), _STEP // 8)) if len(packed) else np.empty(0, np.int64)
            planes.append(packed.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32).tobytes())
            low = ids[~bits]
            zeros.append(len(low))
            ids = np.concatenate([low, ids[bits]])
        return cls(len(ids), planes, zeros, ranks)

    def _ones_before(self, plane: int, at: int) -> int:
        block = at // _STEP
        packed = self.planes[plane]
        count = int(self.ranks[plane][block]) if block < len(self.ranks[plane]) else int(self.ranks[plane][-1])
        whole = packed[block * _STEP // 8 : at // 8]
        count += int(_ONES[whole].sum())
        if at % 8:
            count += int(_ONES[packed[at // 8] >> (8 - at % 8)])
        return count

    def _bit(self, plane: int, at: int) -> int:
        return int(self.planes[plane][at // 8]) >> (7 - at % 8) & 1

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for p, zeros in enumerate(self.zeros):
            bit = self._bit(p, at)
            ones = self._ones_before(p, at)
            at = zeros + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for p, zeros in enumerate(self.zeros):
            a, b = self._ones_before(p, start), self._ones_before(p, end)
            if value >> (len(self.zeros) - 1 - p) & 1:
                start, end = zeros + a, zeros + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id among positions from ``start`` up to ``end``."""
        end = self.n if end is None else min(end, self.n)
        if value < 0 or value >> len(self.zeros) or start >= end:
            return 0
        a, b = self._range(value, start, end)
        return b - a

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) such bit of a plane."""
        ranks = self.ranks[plane].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * _STEP, self.n) - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        at = block * _STEP
        bits = np.unpackbits(self.planes[plane][at // 8 : (at + _STEP) // 8])
        return at + int(np.flatnonzero(bits == bit)[k - before[block]])

    def select(self, value: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        at = self._range(value, 0, self.n)[0] + k
        for p in range(len(self.zeros) - 1, -1, -1):
            bit = value >> (len(self.zeros) - 1 - p) & 1
            at = self._select_bit(p, bit, at - self.zeros[p] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order: the partings undone from the lowest plane up."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for b, (packed, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            bits = np.unpackbits(packed, count=self.n).view(bool)
            parted = np.empty_like(out)
            parted[~bits] = out[:zeros]
            parted[bits] = out[zeros:] | kind(1 << b)
            out = parted
        return out


# Classes of characters that the byte-level split tells apart.
_LETTER, _NUMBER, _SPACE, _OTHER, _UNSEEN = 0, 1, 2, 3, 4
#: English endings that stay with their apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: A worker's memo of words; emptied when full.
MOST_WORDS = 1_000_000
#: How byte-level models write bytes: printable ones as themselves, the rest, in order, from U+0100 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = [b for b in range(256) if b not in _PRINTED]
_BYTE_CHARS = [chr(b if b in _PRINTED else 0x100 + _OTHERS.index(b)) for b in range(256)]


def _byte_level(split) -> bool:
    """Whether a pre-tokenizer is the byte-level split that ``ByteTokenizer.starts`` makes."""
    import json

    told = json.loads(split.__getstate__()) if split is not None else {}
    return told.get("type") == "ByteLevel" and not told.get("add_prefix_space") and told.get("use_regex", True)


class ByteTokenizer:
    """Whole texts to ids with the tokenizers library, each distinct word encoded once.

    The library's byte-level split cuts a text into words that it encodes one by one. The same cuts
    are found here for many texts at once with array operations on character classes; the library
    itself tells the class of each new character and the ids of each new word.

    ``encode_special_tokens`` is the library's flag: if true, special tokens that stand in a text are
    cut like any other characters; if false, as the library is loaded, they are ids of their own. Added
    tokens that aren't special are always ids of their own.
    """

    def __init__(self, path: str, encode_special_tokens: bool = True):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.model = Tokenizer.from_file(path)
        if self.model.normalizer is not None or self.model.truncation or self.model.padding or not _byte_level(self.model.pre_tokenizer):
            raise ValueError("only a byte-level split without prefix space, and no normaliser, truncation or padding, is encoded as the library does")
        self.model.encode_special_tokens = encode_special_tokens
        added = self.model.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items() if not (encode_special_tokens and t.special)}
        #: At one place the longest added token counts, also one that is then cut like other text.
        self.cut = re.compile("|".join(map(re.escape, sorted((t.content for t in added.values()), key=len, reverse=True)))) if self.added else None
        #: If false, some take blanks with them or must be whole words: such texts go to the library.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.words = self.model.model.tokenize
        self.split = ByteLevel(add_prefix_space=False, use_regex=True)
        self.kind = np.uint16 if self.model.get_vocab_size() <= 1 << 16 else np.uint32
        self.classes = np.full(0x110000, _UNSEEN, np.uint8)
        self.memo: dict[str, bytes] = {}
        self.factors = [np.empty(0, np.uint64)] * 2

    def _class(self, char: str) -> int:
        alone = lambda other: len(self.split.pre_tokenize_str(other + char)) == 1
        return _LETTER if alone("a") else _NUMBER if alone("1") else _OTHER if alone("!") else _SPACE

    def starts(self, text: str, points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where words start in joined texts, given with their code points, that begin at ``firsts``."""
        n = len(points)
        if not n:
            return np.empty(0, np.int64)
        kinds = self.classes[points]
        if (kinds == _UNSEEN).any():
            for c in np.unique(points[kinds == _UNSEEN]).tolist():
                self.classes[c] = self._class(chr(c))
            kinds = self.classes[points]
        first = np.zeros(n + 1, bool)
        first[firsts] = True
        first[n] = True
        run = first[:n].copy()  # a run of one class starts
        run[1:] |= kinds[1:] != kinds[:-1]
        start = run.copy()
        # spaces before a word: the last one stands alone, or goes with the word if it is U+0020
        after = np.flatnonzero(run[1:] & (kinds[:-1] == _SPACE) & ~first[1:n]) + 1
        start[after - 1] = True
        blank = points[after - 1] == 0x20
        start[after[blank]] = False
        # an apostrophe that starts a word takes one of the endings with it
        quote = np.flatnonzero((points == 0x27) & start)
        for i in quote.tolist():
            if i + 1 < n and not first[i + 1] and kinds[i + 1] == _LETTER:
                for ending in _ENDINGS:
                    end = i + 1 + len(ending)
                    if text[i + 1 : end] == ending and not first[i + 2 : end].any():
                        start[i + 1] = False
                        if end < n:
                            start[end] = True
                        break
        return np.flatnonzero(start)

    def _equal(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place of each distinct word, number of its distinct word for every word)."""
        inside = np.arange(len(points), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
        longest = int(sizes.max())
        if longest > len(self.factors[0]):
            rng = np.random.default_rng(longest)
            self.factors = [rng.integers(1, 1 << 63, 2 * longest, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
        one, other = (np.add.reduceat((points + np.uint64(1)) * f[inside], starts) for f in self.factors)
        _, first, number = np.unique(one, return_index=True, return_inverse=True)
        if (other != other[first][number]).any():  # unequal words under one hash: take the pair of hashes
            _, first, number = np.unique(np.column_stack([one, other]), axis=0, return_index=True, return_inverse=True)
        return first, number.ravel()

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, from the memo or the library."""
        found = list(map(self.memo.get, words))
        if None in found:
            fresh = [w for w, f in zip(words, found) if f is None]
            if len(self.memo) + len(fresh) > MOST_WORDS:
                self.memo.clear()
            code = "H" if self.kind is np.uint16 else "I"
            new = {w: array(code, [t.id for t in self.words("".join(map(_BYTE_CHARS.__getitem__, w.encode("utf-8", "surrogatepass"))))]).tobytes() for w in fresh}
            found = [new[w] if f is None else f for w, f in zip(words, found)]
            self.memo |= {w: f for w, f in new.items() if len(w) <= 64}
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        marked = [k for k, t in enumerate(texts) if self.cut.search(t)] if self.cut else []
        if not marked:
            return self._encode(texts)
        if not self.plain:
            theirs = set(marked)
            own = self._encode(["" if k in theirs else t for k, t in enumerate(texts)])
            for k in marked:
                own[k] = np.array(self.model.encode(texts[k], add_special_tokens=False).ids, self.kind)
            return own
        # texts between added tokens are cut on their own
        parts, tokens, ends = [], [], []
        for t in texts:
            at = 0
            for m in self.cut.finditer(t):
                if m[0] in self.added:
                    parts.append(t[at : m.start()])
                    tokens.append([self.added[m[0]]])
                    at = m.end()
            parts.append(t[at:])
            tokens.append([])
            ends.append(len(parts))
        pieces = [np.append(ids, np.array(token, self.kind)) for ids, token in zip(self._encode(parts), tokens)]
        return [np.concatenate(pieces[a:b]) for a, b in zip([0, *ends], ends)]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without added tokens."""
        lengths = np.array([len(t) for t in texts], np.int64)
        text = "".join(texts)
        begins = np.cumsum(lengths) - lengths
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = self.starts(text, points, begins[lengths > 0])
        if not len(starts):
            return [np.empty(0, self.kind)] * len(texts)
        sizes = np.diff(starts, append=len(text))
        first, number = self._equal(points, starts, sizes)
        found = self._ids([text[a : a + n] for a, n in zip(starts[first].tolist(), sizes[first].tolist())])
        # lay the ids of each word in order: a gather from the distinct words' ids
        each = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.kind).itemsize
        flat = np.frombuffer(b"".join(found), self.kind)
        counts = each[number]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat((np.cumsum(each) - each)[number] - bounds[:-1], counts) + np.arange(bounds[-1])]
        cuts = bounds[np.searchsorted(starts, np.append(begins, len(text)))]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _tokenizer(path: str, encode_special_tokens: bool) -> ByteTokenizer:
    return resident(("tokens", path, encode_special_tokens), lambda: ByteTokenizer(path, encode_special_tokens))


_SEGMENT = "shard int, segment int, n_ids long, planes array<binary>, zeros array<long>, ranks array<binary>, doc_ids array<long>, doc_sizes array<long>"


def _segment(shard: int, segment: int, docs: list, ids: list[np.ndarray]) -> pa.RecordBatch:
    m = WaveletMatrix.build(np.concatenate(ids))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([m.n], pa.int64()),
            pa.array([[p.tobytes() for p in m.planes]], pa.list_(pa.binary())), pa.array([m.zeros], pa.list_(pa.int64())), pa.array([[r.tobytes() for r in m.ranks]], pa.list_(pa.binary())),
            pa.array([docs], pa.list_(pa.int64())), pa.array([[len(i) for i in ids]], pa.list_(pa.int64())),
        ],
        ["shard", "segment", "n_ids", "planes", "zeros", "ranks", "doc_ids", "doc_sizes"],
    )


def _shards(path: str, end_id: int, most: int, encode_special_tokens: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, shard, segment = _tokenizer(path, encode_special_tokens), TaskContext.get().partitionId(), 0
        end = np.array([end_id], tokenizer.kind)
        docs, ids, held = [], [], 0
        for batch in small_batches(batches, 4 << 20):
            encoded = tokenizer.encode([t or "" for t in batch["text"].to_pylist()])
            for doc, own in zip(batch["doc_id"].to_pylist(), encoded):
                docs.append(doc)
                ids.append(np.append(own, end))
                held += len(own) + 1
                if held >= most:
                    yield _segment(shard, segment, docs, ids)
                    docs, ids, held, segment = [], [], 0, segment + 1
        if docs:
            yield _segment(shard, segment, docs, ids)

    return rows


def write_token_files(docs: DataFrame, tokenizer_path: str, out_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, encode_special_tokens: bool = True) -> None:
    """Encode every document, append ``end_id``, and write shards in ascending document order.

    Null and empty texts become the end id alone. Null ids come first; documents that share an id are
    ordered by their texts. Further columns are ignored; an empty table gives a folder of no rows.
    ``encode_special_tokens``: as for ``ByteTokenizer``.
    """
    rows = id_and_text(docs, id_col, text_col)
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(_shards(tokenizer_path, end_id, segment_ids, encode_special_tokens), _SEGMENT).write.option("compression", "zstd").parquet(out_path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The files as one row a segment."""
    return spark.read.schema(_SEGMENT).parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = WaveletMatrix(row["n_ids"], row["planes"], row["zeros"], row["ranks"]).ids().astype("<u4")
            sizes = np.array(row["doc_sizes"], np.int64)
            begins = np.cumsum(sizes) - sizes
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begins.tolist(), sizes.tolist())]
            k = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * k, pa.int32()), pa.array([row["segment"]] * k, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(begins), pa.array(sizes), pa.array(crc, pa.int64())],
                ["shard", "segment", "doc_id", "begin", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: ``start``, ``n_tokens`` and ``ids_crc32``.

    ``start``: ids of all documents before it. Offsets add up by shard first and then within a shard,
    so that no task sees more than a row per shard, or the segments of one.
    """
    segments = read_segments(spark, path)
    index = segments.select("shard", "segment", "n_ids")
    shards = index.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    own = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.select("shard", "segment", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("segment_start")).join(shards, "shard")
    found = segments.mapInArrow(_documents, "shard int, segment int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["shard", "segment"]).select("doc_id", (F.col("shard_start") + F.col("segment_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def _occurrences(value: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                m = WaveletMatrix(row["n_ids"], row["planes"], row["zeros"], row["ranks"])
                at = [m.select(value, k) for k in range(m.count(value))]
                ends = np.cumsum(row["doc_sizes"])
                doc = np.searchsorted(ends, at, "right")
                docs = [row["doc_ids"][d] for d in doc.tolist()]
                inside = [a - int(ends[d]) + row["doc_sizes"][d] for a, d in zip(at, doc.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(inside, pa.int64())], ["doc_id", "position"])

    return rows


def find_token(spark: SparkSession, path: str, token_id: int) -> DataFrame:
    """Where an id occurs: ``doc_id`` and ``position`` in the document, by rank and select alone."""
    return read_segments(spark, path).mapInArrow(_occurrences(token_id), "doc_id long, position long")


def token_digests(docs: DataFrame, tokenizer_path: str, **how) -> DataFrame:
    """Write the token files to the shared folder and return ``read_documents`` of them."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "tokens")
    write_token_files(docs, tokenizer_path, path, **how)
    return read_documents(spark, path)
