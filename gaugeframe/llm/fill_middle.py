"""Fill-in-middle: texts cut at line boundaries, looked up in a piecewise-linear learned rank index.

The index of a text maps the rank k of a boundary (0 is the start, k the end of line k) to its offset in code
points. It holds straight segments, each of which passes within ``error`` of all its boundaries, and one residual
of two bytes a boundary. A lookup predicts the offset from the segment of k and adds the residual, so it is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: How far a segment may be from a boundary, in code points; residuals then fit in 16 bits.
ERROR = 512


def boundaries(text: str) -> np.ndarray:
    """Offsets of all boundaries in code points: 0, then the end of each line, the last with or without its break."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 10) + 1
    tail = [] if not len(points) or points[-1] == 10 else [len(points)]
    return np.concatenate([[0], ends, tail]).astype(np.int64)


class RankIndex:
    """Boundary offsets as error-bounded segments (first rank, offset there, slope) and residuals."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR) -> None:
        if not 0 < error < 1 << 15:
            raise ValueError("error must be above 0 and below 32768, as residuals have 16 bits")
        starts, slopes, at = [], [], 0
        while at < len(offsets):
            slope, n = _segment(offsets[at:], error)
            starts.append(at)
            slopes.append(slope)
            at += n
        self.n = len(offsets)
        self.starts, self.slopes = np.array(starts, np.int64), np.array(slopes)
        self.bases = offsets[self.starts]
        self.residuals = (offsets - self._predict(np.arange(self.n))).astype(np.int16)

    def _predict(self, ranks: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.starts, ranks, "right") - 1
        return self.bases[k] + np.rint(self.slopes[k] * (ranks - self.starts[k])).astype(np.int64)

    def offset(self, rank: int) -> int:
        """The exact offset of a boundary: predicted by its segment, corrected by its residual."""
        return int(self._predict(np.array([rank]))[0]) + int(self.residuals[rank])


def _segment(y: np.ndarray, error: int) -> tuple[float, int]:
    """The slope through the first point that stays within ``error`` of as many points as it can, and how many.

    Each point narrows the cone of slopes that pass close enough; the segment ends before the point that closes
    it. Points are taken in blocks that double, so a segment costs what it covers.
    """
    low, high, done, block = 0.0, np.inf, 1, 64
    while done < len(y):
        steps = np.arange(done, min(done + block, len(y)))
        rise = (y[steps] - y[0]).astype(float)
        # half a point less than the bound, as predictions are rounded
        lows = np.maximum(np.maximum.accumulate((rise - (error - 0.5)) / steps), low)
        highs = np.minimum(np.minimum.accumulate((rise + (error - 0.5)) / steps), high)
        closed = np.flatnonzero(lows > highs)
        fits = int(closed[0]) if len(closed) else len(steps)
        if fits:
            low, high = float(lows[fits - 1]), float(highs[fits - 1])
        done += fits
        if fits < len(steps):
            break
        block *= 2
    return (low + high) / 2 if done > 1 else 0.0, done


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned numbers of 32 bits from the hash of ``seed:doc_id``; a null id counts as empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def split(text: str, doc_id: int | None, seed: int, rate: int, spm_rate: int, error: int) -> tuple[str, str, str, str, int, RankIndex]:
    """The form, prefix, middle and suffix, how many lines there are, and the index; a plain text is all prefix."""
    index = RankIndex(boundaries(text), error)
    n = index.n - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return "plain", text, "", "", n, index
    a, b = (index.offset(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    return "spm" if h4 % 100 < spm_rate else "psm", text[:a], text[a:b], text[b:], n, index


def joined(form: str, prefix: str, middle: str, suffix: str) -> str:
    """The output of a form."""
    if form == "plain":
        return prefix
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restored(form: str, output: str) -> str:
    """The text that an output was made from.

    No text that is transformed holds a mark, and marks can't overlap the text around them, so each
    mark is where it is first found.
    """
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    other, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (one, other) if form == "psm" else (other, one)
    return prefix + middle + suffix


def _transform(seed: int, rate: int, spm_rate: int, error: int, digests: bool):
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids, out = batch["doc_id"], []
            for doc_id, text in zip(ids.to_pylist(), batch["text"].to_pylist()):
                form, prefix, middle, suffix, n, index = split(text or "", doc_id, seed, rate, spm_rate, error)
                output = joined(form, prefix, middle, suffix)
                back = restored(form, output)
                sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
                out.append((n, form, *sizes, len(index.starts), *((sha(output), sha(back)) if digests else (output, back == (text or "")))))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if digests else pa.bool_()]
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", *_NAMES[:5], *(_NAMES[7:] if digests else _NAMES[5:7])])

    return rows


_NAMES = ["n", "form", "prefix_chars", "middle_chars", "n_segments", "output", "round_trip", "output_sha256", "restored_sha256"]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, error: int = ERROR, digests: bool = False) -> DataFrame:
    """One row per document: ``n`` lines, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars``,
    ``n_segments`` of its index, the ``output``, and whether it was rebuilt exactly (``round_trip``).

    ``rate`` per cent of the documents are transformed, ``spm_rate`` per cent of those with the suffix first, both
    drawn by a hash of the id. ``digests``: hashes of the output and of the text rebuilt from it in place of texts.
    A null text counts as empty; empty texts and texts that hold a mark stay plain, with null sizes. Texts are taken
    whole, however long. Rows are taken one by one: repeated rows come back as they are, equal ids with different
    texts are each cut in their own, further columns are ignored, an empty table gives an empty result.
    """
    tail = "output_sha256 string, restored_sha256 string" if digests else "output string, round_trip boolean"
    schema = f"doc_id long, n long, form string, prefix_chars long, middle_chars long, n_segments long, {tail}"
    return id_and_text(docs, id_col, text_col).mapInArrow(_transform(seed, rate, spm_rate, error, digests), schema)
