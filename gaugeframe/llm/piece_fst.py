"""SentencePiece encoding and decoding as a weighted finite-state transduction.

Three machines are compiled from a model file: the normaliser (character rules, space collapsing, dummy
prefix, space escaping), the piece transducer (a path from characters to piece ids, with byte arcs for characters
that no piece covers) and a bigram acceptor over pieces. A text's ids label the shortest path, in the
tropical semiring, of their composition. A unigram model weighs piece arcs by its negated scores and
accepts every bigram. A byte-pair model weighs all arcs 0 and its acceptor gives infinity to a bigram
that merging would not leave standing; every string then has exactly one path of finite weight, the
one that merging finds.

Composition is lazy: a text is cut where no piece can span (before a run of spaces and around
characters outside every piece), and a segment's shortest path is kept in a bounded memo.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, resident, small_batches

SPACE = "▁"
#: Memo sizes of one Python worker; a full memo is emptied.
MOST_SEGMENTS, MOST_PAIRS, MOST_CHARS = 200_000, 200_000, 48
#: Segments searched together.
MOST_TOGETHER = 10_000


def _rules(charsmap: bytes) -> dict[str, str]:
    """The arcs of a model's character map: each source string and what is written for it.

    The map is a double-array trie over bytes, then the targets, each ended by a zero byte.
    """
    if not charsmap:
        return {}
    size = int.from_bytes(charsmap[:4], "little")
    units, targets = np.frombuffer(charsmap[4 : 4 + size], "<u4").tolist(), charsmap[4 + size :]
    reach = lambda unit: (unit >> 10) << ((unit & 1 << 9) >> 6)
    rules: dict[str, str] = {}
    todo = [(reach(units[0]), b"")]
    while todo:
        at, source = todo.pop()
        for byte in range(1, 256):
            here = at ^ byte
            if here < len(units) and units[here] & 0x800000FF == byte:
                beyond = here ^ reach(units[here])
                spelt = source + bytes([byte])
                if units[here] >> 8 & 1:
                    begin = units[beyond] & 0x7FFFFFFF
                    rules[spelt.decode()] = targets[begin : targets.index(b"\0", begin)].decode()
                todo.append((beyond, spelt))
    return rules


class Normaliser:
    """The normaliser as a deterministic transducer over characters.

    At its start state, the longest source string of ``rules`` that comes next is read and its target
    written; any other character writes itself. With ``collapse``, a second state after a written space
    writes no further ones, it is also where reading begins, and spaces at the end are taken back.
    """

    def __init__(self, rules: dict[str, str] | None = None, *, dummy_prefix: bool = True, collapse: bool = False):
        self.rules, self.dummy_prefix, self.collapse = rules or {}, dummy_prefix, collapse
        self.lengths: dict[str, list[int]] = {}  # by first character, the longest first
        for first, n in sorted({(r[0], len(r)) for r in self.rules}, key=lambda x: -x[1]):
            self.lengths.setdefault(first, []).append(n)
        self.starts = re.compile("[" + "".join(map(re.escape, self.lengths)) + "]") if self.rules else None

    def _arcs(self, text: str) -> Iterator[str]:
        """What is written, arc by arc; stretches without rules come whole."""
        at = 0
        while m := self.starts.search(text, at):
            i = m.start()
            yield text[at:i]
            n = next((n for n in self.lengths[text[i]] if text[i : i + n] in self.rules), 0)
            yield self.rules[text[i : i + n]] if n else text[i]
            at = i + (n or 1)
        yield text[at:]

    def __call__(self, text: str) -> str:
        if self.rules:
            text = "".join(self._arcs(text))
        if self.collapse:
            text = re.sub(" +", " ", text).lstrip(" ")
        if not text:
            return ""
        text = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        return text.rstrip(SPACE) if self.collapse else text


class Merges:
    """The bigram acceptor of a byte-pair model: which pieces may stand side by side."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        self.ends: dict[str, tuple[list, list]] = {}

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes this one, if merging its characters makes it at all."""
        parts = list(piece)
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == inf:
                return None
            i = best[1]
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return None

    def _edges(self, piece: str) -> tuple[list, list]:
        """What stands at the piece's left and right edge over time: (string, made at, merged at)."""
        if piece not in self.ends:
            out: tuple[list, list] = ([], [])
            for side in (0, 1):
                at, until = piece, inf
                while True:
                    halves = self.split(at) if len(at) > 1 else None
                    made = self.ranks[at] if len(at) > 1 else -1
                    out[side].append((at, made, until))
                    if not halves:
                        break
                    at, until = halves[side], made
            self.ends[piece] = out
        return self.ends[piece]

    def reachable(self, piece: str) -> bool:
        return len(piece) == 1 or self.split(piece) is not None

    def accepts(self, a: str, b: str) -> bool:
        """Whether no merge across the border of a and b comes before those inside them.

        Merges happen by rank, the leftmost first among equals.
        """
        for x, x_made, x_merged in self._edges(a)[1]:
            for y, y_made, y_merged in self._edges(b)[0]:
                rank = self.ranks.get(x + y)
                if rank is not None:
                    when = max(rank, x_made, y_made)
                    if when < x_merged and when <= y_merged:
                        return False
        return True


class PieceTransducer:
    """Encodes and decodes with the vocabulary of a SentencePiece model."""

    def __init__(self, pieces: dict[str, int], byte_ids: list[int], *, ranks: dict[str, int] | None = None, weights: dict[str, float] | None = None, unk: int = 0, dummy_prefix: bool = True, collapse: bool = False, rules: dict[str, str] | None = None):
        self.merges = Merges(ranks) if ranks is not None else None
        self.pieces = {p: i for p, i in pieces.items() if not self.merges or self.merges.reachable(p)}
        self.weights = weights or {}
        # a character without a piece costs more than any piece, as in the model's own search
        self.unknown = max(self.weights.values(), default=0.0) + 10.0 if weights else 0.0
        self.byte_ids, self.unk = byte_ids, unk
        self.dummy_prefix = dummy_prefix
        self.normalise = Normaliser(rules, dummy_prefix=dummy_prefix, collapse=collapse)
        self.longest = max(map(len, self.pieces), default=1)
        chars = set().union(*map(set, self.pieces)) if self.pieces else set()
        foreign = "".join(c for c in "\n\t\r" if c not in chars)
        spanning = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)
        self.segment = None if spanning else re.compile((f"[{foreign}]|" if foreign else "") + f"{SPACE}+[^{SPACE}{foreign}]*|[^{SPACE}{foreign}]+")
        self.memo: dict[str, bytes] = {}  # ids as packed 32-bit integers
        self.known: dict[int, bool] = {}
        self._compile()
        self.names = {i: p for p, i in self.pieces.items()}
        by_id = {i: p.replace(SPACE, " ").encode() for p, i in pieces.items()}
        self.output = by_id | {i: bytes([b]) for b, i in enumerate(byte_ids)}

    @classmethod
    def from_file(cls, path: str) -> PieceTransducer:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kind = type(model.pieces[0])
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        if not norm.escape_whitespaces or train.treat_whitespace_as_suffix or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("models with unescaped or trailing spaces, or with user-defined or unused pieces, aren't compiled")
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        scores = {p: model.pieces[i].score for p, i in normal.items()}
        bpe = train.model_type == train.BPE
        order = {p: k for k, p in enumerate(sorted(normal, key=lambda p: (-scores[p], normal[p])))} if bpe else None
        return cls(
            normal,
            [ids[f"<0x{b:02X}>"] for b in range(256)] if train.byte_fallback else [],
            ranks=order,
            weights=None if bpe else {p: -s for p, s in scores.items()},
            unk=next((i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN), 0),
            dummy_prefix=norm.add_dummy_prefix,
            collapse=norm.remove_extra_whitespaces,
            rules=_rules(norm.precompiled_charsmap),
        )

    def _shortest(self, text: str) -> tuple[int, ...]:
        """Labels of the lightest path over one segment."""
        # a state: (weight, last piece or None, position before, state before)
        states: list[list[tuple[float, str | None, int, int]]] = [[(0.0, None, -1, -1)]]
        pieces, weights, accepts = self.pieces, self.weights, self.merges.accepts if self.merges else None
        for end in range(1, len(text) + 1):
            here: dict[str | None, tuple[float, str | None, int, int]] = {}
            for start in range(max(0, end - self.longest), end):
                piece = text[start:end]
                if piece in pieces:
                    cost = weights.get(piece, 0.0)
                elif end - start == 1:
                    cost = self.unknown
                else:
                    continue
                for k, (weight, last, _, _) in enumerate(states[start]):
                    if accepts and last is not None and piece in pieces and last in pieces and not accepts(last, piece):
                        continue
                    total = weight + cost
                    if piece not in here or total < here[piece][0]:
                        here[piece] = (total, piece, start, k)
            found = list(here.values())
            # without an acceptor the last piece doesn't matter: one state is enough
            states.append(found if accepts else [min(found, key=lambda s: s[0])])
        at, k = len(text), min(range(len(states[-1])), key=lambda i: states[-1][i][0])
        out: list[tuple[int, ...]] = []
        while at:
            _, piece, before, back = states[at][k]
            out.append((self.pieces[piece],) if piece in self.pieces else tuple(self.byte_ids[b] for b in piece.encode()) if self.byte_ids else (self.unk,))
            at, k = before, back
        return tuple(chain.from_iterable(reversed(out)))

    def _only(self, text: str) -> tuple[int, ...]:
        """The one path of finite weight that a byte-pair acceptor leaves.

        Each prefix has one such path too, so a position keeps a single state: its last piece.
        """
        pieces, known, longest, n = self.pieces, self.known, self.longest, len(text)
        last, before = [-1], [0]  # -1: the start, or a character without a piece; anything may follow
        for end in range(1, n + 1):
            for start in range(end - longest if end > longest else 0, end):
                piece = pieces.get(text[start:end], -1)
                if piece >= 0:
                    prior = last[start]
                    if prior >= 0:
                        ok = known.get(prior << 32 | piece)
                        if ok is None:
                            ok = self._accepts(prior, piece)
                        if not ok:
                            continue
                    break
            # the innermost piece is a single character, whether or not the vocabulary has it
            last.append(piece)
            before.append(start)
        out: list[tuple[int, ...]] = []
        at = n
        while at:
            out.append((last[at],) if last[at] >= 0 else tuple(self.byte_ids[b] for b in text[before[at] : at].encode()) if self.byte_ids else (self.unk,))
            at = before[at]
        return tuple(chain.from_iterable(reversed(out)))

    def _compile(self) -> None:
        """The piece transducer as sorted arrays: (state, character) -> state, and a state's piece."""
        steps: dict[int, int] = {}
        ends = [-1]
        for text, piece in self.pieces.items():
            at = 0
            for c in text:
                key = at << 21 | ord(c)
                if key not in steps:
                    steps[key] = len(ends)
                    ends.append(-1)
                at = steps[key]
            ends[at] = piece
        self.keys = np.array(sorted(steps), np.int64)
        self.next = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)
        self.costs = np.zeros(max(self.pieces.values(), default=0) + 1)
        for text, piece in self.pieces.items():
            self.costs[piece] = self.weights.get(text, 0.0)

    def _arcs(self, points: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every piece in joined segments; ``stop``: each place's segment end."""
        at = np.arange(len(points))
        start, state, found = at, np.zeros(len(at), np.int64), []
        while len(start):
            key = state << 21 | points[at]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            alive = self.keys[i] == key
            start, at, state = start[alive], at[alive] + 1, self.next[i[alive]]
            piece = self.ends[state]
            whole = piece >= 0
            found.append((start[whole], at[whole], piece[whole]))
            more = at < stop[start]
            start, at, state = start[more], at[more], state[more]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _together(self, segments: list[str]) -> dict[str, bytes]:
        """The shortest paths of many distinct segments at once, all advancing one position at a time.

        The semiring's sum is the minimum over arcs into a position, its product adds an arc's weight.
        A position keeps one state: without an acceptor the last piece doesn't matter, and with one
        a single path has finite weight, so that all that are left weigh the same.
        """
        lengths = np.array([len(s) for s in segments])
        text = "".join(segments)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(segments)), lengths)
        start, end, piece = self._arcs(points, (begins + lengths)[owner])
        single = np.zeros(len(points), bool)
        single[start[end == start + 1]] = True
        odd = np.unique(owner[~single])  # with a character that is no piece: one by one
        out = {segments[i]: self.path(segments[i]) for i in odd.tolist()}
        keep = ~np.isin(owner[start], odd)
        start, end, piece = start[keep], end[keep], piece[keep]
        of = owner[start]
        depth = end - begins[of]
        order = np.lexsort((start, depth))
        start, end, piece, of, depth = start[order], end[order], piece[order], of[order], depth[order]
        # a segment of n characters has n + 1 slots
        total = np.zeros(len(points) + len(segments)) if self.weights else None
        last, before = np.full(len(points) + len(segments), -1, np.int64), np.zeros(len(points) + len(segments), np.int64)
        bounds = np.searchsorted(depth, np.arange(1, int(depth.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            slot_a, slot_b, p = start[a:b] + of[a:b], end[a:b] + of[a:b], piece[a:b]
            if self.weights:
                weight = total[slot_a] + self.costs[p]
                best = np.lexsort((slot_a, weight, slot_b))  # among equals the longest piece
                where, one = np.unique(slot_b[best], return_index=True)
                best = best[one]
                last[where], before[where], total[where] = p[best], slot_a[best], weight[best]
                continue
            prior = last[slot_a]
            ok = prior < 0
            pairs, number = np.unique(prior[~ok] << 32 | p[~ok], return_inverse=True)
            pairs = pairs.tolist()
            known = [self._accepts(k >> 32, k & 0xFFFFFFFF) if v is None else v for k, v in zip(pairs, list(map(self.known.get, pairs)))]
            ok[~ok] = np.array(known, bool)[number]
            where, one = np.unique(slot_b[ok], return_index=True)
            last[where], before[where] = p[ok][one], slot_a[ok][one]
        # walk all paths back together
        live = np.setdiff1d(np.arange(len(segments)), odd)
        at, owners, labels = begins[live] + lengths[live] + live, [], []
        while len(live):
            owners.append(live)
            labels.append(last[at])
            at = before[at]
            go = at > begins[live] + live
            at, live = at[go], live[go]
        if owners:
            owners, labels = np.concatenate(owners)[::-1], np.concatenate(labels)[::-1]
            order = np.argsort(owners, kind="stable")
            raw = labels[order].astype(np.int32).tobytes()
            cuts = (4 * np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(segments)))])).tolist()
            odd_ones = set(odd.tolist())
            out |= {s: raw[cuts[i] : cuts[i + 1]] for i, s in enumerate(segments) if i not in odd_ones}
        return out

    def _accepts(self, a: int, b: int) -> bool:
        if len(self.known) >= MOST_PAIRS:
            self.known.clear()
        ok = self.known[a << 32 | b] = self.merges.accepts(self.names[a], self.names[b])
        return ok

    def path(self, segment: str) -> bytes:
        """Ids of one segment, without the memo."""
        return array("i", self._only(segment) if self.merges and not self.weights else self._shortest(segment)).tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; segments that aren't in the memo are searched together."""
        normal = [self.normalise(t) for t in texts]
        segments = [self.segment.findall(t) if self.segment else [t] * bool(t) for t in normal]
        found = [list(map(self.memo.get, s)) for s in segments]
        fresh = {s for own, ids in zip(segments, found) if None in ids for s, i in zip(own, ids) if i is None}
        new: dict[str, bytes] = {}
        if fresh:
            short = [s for s in fresh if len(s) <= MOST_CHARS]
            for i in range(0, len(short), MOST_TOGETHER):
                new |= self._together(short[i : i + MOST_TOGETHER])
            new |= {s: self.path(s) for s in fresh if s not in new}
            found = [[new[s] if i is None else i for s, i in zip(own, ids)] if None in ids else ids for own, ids in zip(segments, found)]
            if len(self.memo) + len(new) > MOST_SEGMENTS:
                self.memo.clear()
            self.memo |= {s: i for s, i in new.items() if len(s) <= MOST_CHARS}
        return [np.frombuffer(b"".join(ids), np.int32) for ids in found]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """The inverse transduction: pieces and bytes back to text, without the dummy prefix."""
        raw = b"".join(map(self.output.get, ids)) if self.byte_ids else b"".join(self.output.get(i, b" \xe2\x81\x87 ") for i in ids)
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _machine(path: str) -> PieceTransducer:
    """One compiled machine a Python worker."""
    return resident(("pieces", path), lambda: PieceTransducer.from_file(path))


def _encoded(path: str, checked: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(path)
        for batch in small_batches(batches, 2 << 20):
            texts = [t or "" for t in batch["text"].to_pylist()]
            ids = machine.encode_all(texts)
            out = [batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))]
            if checked:
                out.append(pa.array([machine.decode(i.tolist()) == t for i, t in zip(ids, texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "round_trip"][: len(out)])

    return rows


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", checked: bool = False) -> DataFrame:
    """One row per document: ``doc_id`` and its piece ``ids``; if ``checked``, also whether they decode to the text.

    Null and empty texts have no ids. Rows are encoded one by one: repeated rows and null ids come
    back as they are, further columns are ignored, and an empty table gives an empty result.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(_encoded(model_path, checked), "doc_id long, ids array<int>" + (", round_trip boolean" if checked else ""))


def _decoded(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(path)
        for batch in small_batches(batches, 2 << 20):
            texts = [machine.decode(i or []) for i in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """The inverse of ``encode_pieces``; null ids decode to the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(model_path), "doc_id long, text string")


def _round_trip(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(path)
        for batch in small_batches(batches, 2 << 20):
            n, crc, digest, same = [], [], [], []
            texts = batch["text"].to_pylist()
            for text, ids in zip(texts, machine.encode_all([t or "" for t in texts])):
                back = machine.decode(ids.tolist())
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                digest.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == (text or ""))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())],
                ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    return rows


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every document and return digests of both.

    ``n_ids``; ``ids_crc32`` over little-endian 32-bit ids; ``decoded_sha256``; ``round_trip``: whether
    decoding gives the text back (it does unless the text holds the escape character itself). Rows
    that ``encode_pieces`` has no ids for have 0 ids and the empty text's digest.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(_round_trip(model_path), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
