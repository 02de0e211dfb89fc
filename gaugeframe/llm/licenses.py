"""License scans: Dice coefficient over word bigrams against licence templates.

A unit (the whole text, a paragraph between blank lines, or a line) is normalised to lower-case
words and becomes its set of distinct bigrams. With sizes a and b, a Dice coefficient of t or more
needs ``t/(2-t) * b <= a <= (2-t)/t * b``; templates outside that bound are pruned before any
bigram is compared, and a unit outside every template's bound is not even split into bigrams.

By default, runs of consecutive words are compared too, wherever they start and end, so that a
licence over several paragraphs of a longer text, or a notice within a line, is found. A run at t or
more holds at least ``t/(2-t) * b`` of a template's bigrams, so only templates with so many bigrams
in the text, and only stretches with so many of them, are looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, small_batches
from .license_texts import all_templates

_WORD = re.compile(r"[^\W_]+")
_PARAGRAPH = re.compile(r"[^\n]+(?:\n[^\n]+)*")
_LINE = re.compile(r"[^\n]+")


def bigrams(text: str) -> set[tuple[str, ...]]:
    """Distinct bigrams of lower-case words; a single word is a bigram of its own."""
    words = _WORD.findall(text.lower())
    return set(zip(words, words[1:])) or ({(words[0],)} if words else set())


def _outermost(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of spans that nest or lie apart, those in no other, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def _within(start: int, end: int, spans: list[tuple[int, int]]) -> bool:
    k = bisect_right(spans, start, key=lambda s: s[0]) - 1
    return k >= 0 and end <= spans[k][1]


#: Bigrams of a template beyond which its runs are looked for as stretches, at a cost in proportion to the text.
LONG = 600


class Matcher:
    """Templates by size, with postings from bigrams to templates."""

    def __init__(self, templates: Mapping[str, str], threshold: float):
        self.threshold = threshold
        sized = sorted((len(s), name, s) for name, t in templates.items() if (s := bigrams(t)))
        self.sizes = [n for n, _, _ in sized]
        self.names = [name for _, name, _ in sized]
        self.postings: dict[tuple[str, ...], list[int]] = {}
        for i, (_, _, s) in enumerate(sized):
            for b in s:
                self.postings.setdefault(b, []).append(i)
        self.alone = {b[0]: i[0] for b, i in self.postings.items() if len(b) == 1}
        self.low, self.high = threshold / (2 - threshold), (2 - threshold) / threshold
        #: The most bigrams of a run, repeats counted, by template.
        self.longest = [int(self.high * max(1, len(_WORD.findall(templates[name].lower())) - 1) + 1e-9) for name in self.names]
        # a word has at least one letter and a gap, so shorter units cannot reach the smallest size
        self.least_chars = 2 * self.low * self.sizes[0] if self.sizes else float("inf")

    def best(self, unit: str) -> tuple[float, str] | None:
        """The likest template at the threshold or above; ties go to the name that sorts first."""
        if len(unit) < self.least_chars:
            return None
        own = bigrams(unit)
        n = len(own)
        first, last = bisect_left(self.sizes, self.low * n - 1e-9), bisect_right(self.sizes, self.high * n + 1e-9)
        if not n or first >= last:
            return None
        shared: Counter[int] = Counter()
        for b in own & self.postings.keys():
            shared.update(self.postings[b])
        scored = [(2 * k / (n + self.sizes[i]), self.names[i]) for i, k in shared.items() if first <= i < last]
        scored = [x for x in scored if x[0] >= self.threshold]
        return min(scored, key=lambda x: (-x[0], x[1])) if scored else None

    def _runs_of(self, i: int, pairs: list[tuple[str, ...]], at: list[int]) -> list[tuple[int, int, int, int, float]]:
        """(template, first word, end word, bigrams shared, Dice) of a template's likest runs, none overlapping.

        ``at``: where the template's bigrams stand, in order. A likest run starts and ends with one;
        of equally like runs the longest counts, then the first.
        """
        size, longest = self.sizes[i], self.longest[i]
        own, least = set(at), self.low * size - 1e-9
        found = []
        for k, a in enumerate(at):
            if bisect_right(at, a + longest - 1) - k < least:
                continue
            seen: set[tuple[str, ...]] = set()
            shared, best = 0, (0.0, 0, 0)
            for j in range(a, min(a + longest, len(pairs))):
                shared += j in own and pairs[j] not in seen
                seen.add(pairs[j])
                if j in own and (dice := 2 * shared / (len(seen) + size)) >= best[0]:
                    best = (dice, j + 2, shared)
            if best[0] >= self.threshold:
                found.append((-best[0], a - best[1], a, best[1], best[2]))
        taken, out = bytearray(len(pairs) + 1), []
        for dice, less, a, b, shared in sorted(found):
            if 1 not in taken[a:b]:
                taken[a:b] = b"\1" * -less
                out.append((i, a, b, shared, -dice))
        return out

    def _stretch_of(self, i: int, pairs: list[tuple[str, ...]], at: list[int]) -> list[tuple[int, int, int, int, float]]:
        """As ``_runs_of``, for a long template: stretches of its bigrams with no gap of over an eighth of its size."""
        size, gap = self.sizes[i], max(1, self.sizes[i] // 8)
        breaks = [k for k in range(1, len(at)) if at[k] - at[k - 1] > gap]
        found = []
        for a, b in zip([0, *breaks], [*breaks, len(at)]):
            if b - a < self.low * size - 1e-9:
                continue
            shared = len({pairs[k] for k in at[a:b]})
            dice = 2 * shared / (len(set(pairs[at[a] : at[b - 1] + 1])) + size)
            if dice >= self.threshold:
                found.append((i, at[a], at[b - 1] + 2, shared, dice))
        return found

    def runs(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, template, Dice) of runs of words that match, wherever they stand in the text.

        Of runs that share most of their words, the one with most bigrams of its template stays.
        """
        lower = text.lower()
        words = _WORD.findall(lower)
        pairs = list(zip(words, words[1:]))
        at: dict[int, list[int]] = {}
        for k, b in enumerate(pairs):
            if b in self.postings:
                for i in self.postings[b]:
                    at.setdefault(i, []).append(k)
        found = []
        for i, own in at.items():
            least = self.low * self.sizes[i] - 1e-9
            if len(own) >= least and len({pairs[k] for k in own}) >= least:
                found += (self._runs_of if self.sizes[i] <= LONG else self._stretch_of)(i, pairs, own)
        if self.alone:
            found += [(self.alone[w], k, k + 1, 1, 1.0) for k, w in enumerate(words) if w in self.alone]
        if not found:
            return []
        taken, kept = bytearray(len(words)), []
        for i, a, b, _, dice in sorted(found, key=lambda r: (-r[3], -r[4], self.names[r[0]], r[1])):
            if 2 * taken.count(1, a, b) <= b - a:
                taken[a:b] = b"\1" * (b - a)
                kept.append((i, a, b, dice))
        spans = [m.span() for m in _WORD.finditer(lower)]
        # a letter may become two in lower case
        place = range(len(text) + 1) if len(lower) == len(text) else [k for k, c in enumerate(text) for _ in c.lower()]
        return sorted((place[spans[a][0]], place[spans[b - 1][1] - 1] + 1, self.names[i], dice) for i, a, b, dice in kept)

    def scan(self, text: str, runs: bool = False) -> list[tuple[int, int, str, float]]:
        """(start, end, template, Dice) of every matching unit, whole text first.

        ``runs``: then those of runs of words, but for runs within a unit of the same template
        that is itself no longer than a run may be.
        """
        spans = [(0, len(text))]
        if "\n" in text:
            spans += [m.span() for m in _PARAGRAPH.finditer(text)] + [m.span() for m in _LINE.finditer(text)]
        out = []
        for a, b in dict.fromkeys(spans):
            if hit := self.best(text[a:b]):
                out.append((a, b, hit[1], hit[0]))
        if runs:
            units: dict[str, list[tuple[int, int]]] = {}
            for a, b, name, _ in out:
                if len(_WORD.findall(text[a:b])) <= self.longest[self.names.index(name)] + 1:
                    units.setdefault(name, []).append((a, b))
            outer = {name: _outermost(spans) for name, spans in units.items()}
            out += [r for r in self.runs(text) if not _within(r[0], r[1], outer.get(r[2], []))]
        return out


def _scan(templates: Mapping[str, str], threshold: float, runs: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in small_batches(batches):
            n, best, dice, spans = [], [], [], []
            for text in batch["text"].to_pylist():
                hits = matcher.scan(text or "", runs)
                top = min(hits, key=lambda h: (-h[3], h[0] - h[1], h[2]), default=None)
                n.append(len(hits))
                best.append(top and top[2])
                dice.append(round(top[3], 6) if top else 0.0)
                spans.append(",".join(f"{h[2]}:{h[0]}:{h[1]}" for h in sorted(hits)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(best, pa.string()), pa.array(dice, pa.float64()), pa.array(spans, pa.string())],
                ["doc_id", "n_matches", "license", "dice", "spans"],
            )

    return rows


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] | None = None, threshold: float = 0.8, runs: bool = True) -> DataFrame:
    """One row per document: ``n_matches``, the likest ``license`` and its ``dice``, and all ``spans``.

    Spans are ``template:start:end`` in code points, ordered by start. Ties of the likest go to
    the longer span, then to the name that sorts first. ``templates``: all that ``license_texts`` has, if not given. ``runs``: compare runs of
    words too, across paragraphs and within lines; those of a template of over ``LONG`` bigrams are stretches of its
    bigrams, taken whole.
    Null, empty and wordless texts match nothing (``license`` null, ``dice`` 0). Rows are scanned one by one: repeated rows and null ids come back as they are, further columns
    are ignored, and an empty table gives an empty result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    return id_and_text(docs, id_col, text_col).mapInArrow(_scan(dict(all_templates() if templates is None else templates), threshold, runs), "doc_id long, n_matches long, license string, dice double, spans string")
