"""Secret scans through a trigram inverted index.

Every rule's regular expression is parsed and turned into a Boolean query over trigrams that any
match must contain, letters folded to lower case. Each task builds the postings of its documents
for the trigrams that the queries name, intersects and unites them, and runs a rule's expression
only over the documents its query leaves. A rule without mandatory trigrams scans every document.

Sharding the index by task keeps postings local: nothing is shuffled, and a lost executor's shard is
rebuilt from its input split.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, small_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, the group that must be long enough, and that length."""

    kind: str
    pattern: str
    group: int
    least: int


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE_RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
)
RULES = BASE_RULES + MORE_RULES

# A Boolean query is True (any document), a trigram, or ("and" | "or", {queries}).


def _join(kind: str, parts: list) -> object:
    """Conjunction or disjunction with the constant True folded away."""
    flat: set = set()
    for p in parts:
        if p is True:
            if kind == "or":
                return True
            continue
        flat |= set(p[1]) if isinstance(p, tuple) and p[0] == kind else {p}
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


#: An exact set of strings larger than this is given up for what its trigrams already say.
MOST_STRINGS = 64


def _trigrams(strings: set[str]) -> object:
    """Trigrams are of UTF-8 bytes, as the index is; each byte is written as one character."""
    raw = [s.encode("utf-8", "surrogatepass").decode("latin-1") for s in strings]
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in raw])


def _folded(code: int) -> str:
    """The index folds A-Z and nothing else."""
    return chr(code + 32) if 0x41 <= code <= 0x5A else chr(code)


def _small_class(arg) -> set[str] | None:
    """The folded characters of a bracket class, if they are few."""
    chars: set[str] = set()
    for kind, v in arg:
        if kind is op.LITERAL:
            chars.add(_folded(v))
        elif kind is op.RANGE and v[1] - v[0] < 8:
            chars |= {_folded(c) for c in range(v[0], v[1] + 1)}
        else:
            return None
    return chars if len(chars) <= 8 else None


def _walk(nodes) -> tuple[set[str] | None, object]:
    """(every string the nodes can match, None if not few; a query that their matches satisfy)."""
    run: set[str] = {""}  # what the text since the last gap can be
    query: object = True
    exact = True
    for code, arg in nodes:
        strings: set[str] | None = None
        own: object = True
        if code is op.LITERAL:
            strings = {_folded(arg)}
        elif code is op.IN:
            strings = _small_class(arg)
        elif code is op.SUBPATTERN:
            strings, own = _walk(arg[3])
        elif code is op.BRANCH:
            each = [_walk(x) for x in arg[1]]
            strings = set().union(*(s for s, _ in each)) if all(s is not None for s, _ in each) else None
            own = _join("or", [q for _, q in each])
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, inner = arg
            inside, q = _walk(inner)
            if (least, most) == (0, 1) and inside is not None:
                strings = inside | {""}
            elif least:
                own = q
        query = _join("and", [query, own])
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            query = _join("and", [query, _trigrams(run)])
            run, exact = (strings, False) if strings is not None and len(strings) <= MOST_STRINGS else ({""}, False)
    return (run if exact else None), _join("and", [query, _trigrams(run)])


def _any_case(nodes) -> bool:
    """Whether some group of the parsed expression is set to ignore case."""
    for code, arg in nodes:
        if code is op.SUBPATTERN and (arg[1] & re.IGNORECASE or _any_case(arg[3])):
            return True
        if code is op.BRANCH and any(map(_any_case, arg[1])) or code in (op.MAX_REPEAT, op.MIN_REPEAT) and _any_case(arg[2]):
            return True
    return False


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query of a regular expression; True where none is mandatory.

    An expression that ignores case has none: letters beyond A-Z also match other cases of theirs.
    """
    nodes = _parser.parse(pattern)
    if nodes.state.flags & re.IGNORECASE or _any_case(nodes):
        return True
    return _walk(nodes)[1]


def _named(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(_named(q) for q in query[1]))


#: On UTF-8 bytes: A-Z lower case. The index folds case, so one trigram serves every spelling.
_FOLD = np.frombuffer(bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)), np.uint8)


class Index:
    """Postings of one batch of texts for the named trigrams."""

    def __init__(self, trigrams: list[str]):
        self.slots = {t: i for i, t in enumerate(trigrams)}
        self.table = np.zeros(1 << 24, np.min_scalar_type(len(trigrams)))  # trigram code -> slot + 1
        for t, i in self.slots.items():
            a, b, c = t.encode("latin-1")
            self.table[a << 16 | b << 8 | c] = i + 1

    def postings(self, raw: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """For each slot the sorted numbers of the texts that hold its trigram.

        ``raw``: the UTF-8 bytes of all texts; ``starts``: where each begins, and the end.
        """
        found: list[list[np.ndarray]] = [[] for _ in self.slots]
        step = 4 << 20
        for at in range(0, max(0, len(raw) - 2), step):
            low = _FOLD[raw[at : at + step + 2]].astype(np.uint32)
            slot = self.table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
            where = np.flatnonzero(slot)
            doc = np.searchsorted(starts, where + at, "right") - 1
            inside = where + at + 2 < starts[doc + 1]  # not across two texts
            for s, d in zip(*self._distinct(slot[where][inside], doc[inside])):
                found[s - 1].append(d)
        return [np.unique(np.concatenate(f)) if f else np.empty(0, np.int64) for f in found]

    @staticmethod
    def _distinct(slot: np.ndarray, doc: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
        order = np.argsort(slot, kind="stable")
        slot, doc = slot[order], doc[order]
        kinds, first = np.unique(slot, return_index=True)
        return kinds.tolist(), [np.unique(d) for d in np.split(doc, first[1:])]

    def answer(self, query: object, postings: list[np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, str):
            return postings[self.slots[query]]
        parts = sorted((self.answer(q, postings, n) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def _joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in sorted(spans))


def _scan(rules: tuple[Rule, ...], n_base: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        compiled = [re.compile(r.pattern) for r in rules]
        index = Index(sorted(set().union(*map(_named, queries))))
        for batch in small_batches(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            starts = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
            postings = index.postings(np.frombuffer(b"".join(raw), np.uint8), starts)
            found: dict[int, list[tuple[int, int, int]]] = {}
            for k, (rule, query) in enumerate(zip(rules, queries)):
                for d in index.answer(query, postings, len(texts)).tolist():
                    for m in compiled[k].finditer(texts[d]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found.setdefault(d, []).append((m.start(), k, m.end()))
            counts = [[0] * len(texts) for _ in range(n_base)]
            base, every = [], []
            for d in range(len(texts)):
                own = found.get(d, [])
                for _, k, _ in own:
                    if k < n_base:
                        counts[k][d] += 1
                base.append(hashlib.sha256(_joined([s for s in own if s[1] < n_base], rules).encode()).hexdigest())
                every.append(_joined(own, rules))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(every, pa.string())],
                ["doc_id", *(f"n_{r.kind}" for r in rules[:n_base]), "base_sha256", "spans"],
            )

    return rows


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more_rules: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """One row per document: counts by base kind, a digest of the base spans, and all spans.

    Spans are ``kind:start:end`` in code points, end exclusive, ordered by start and then as the
    rules are listed. Matches are leftmost and do not overlap within a kind.

    Null and empty texts have no spans. Each row is scanned by itself, so repeated rows and null ids
    come back as they are; further columns are ignored; an empty table gives an empty result.
    """
    rules = BASE_RULES + tuple(more_rules)
    counts = ", ".join(f"n_{r.kind} long" for r in BASE_RULES)
    return id_and_text(docs, id_col, text_col).mapInArrow(_scan(rules, len(BASE_RULES)), f"doc_id long, {counts}, base_sha256 string, spans string")
