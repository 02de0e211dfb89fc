"""Quality classifier by compression: which labelled text a document shares more with.

Two zstandard dictionaries are built, from text labelled good and text labelled bad. A document is
cut into short blocks, each compressed by itself with either dictionary, so that the dictionaries
weigh on every part of a long text. The difference of the two summed sizes over their total is the
raw figure; a logistic curve fitted on other labelled documents turns it into a probability.

Fitting takes a bounded sample: ``per_class`` labelled documents of either class, chosen by hash. Up to
half of them, whole texts of ``dictionary_bytes`` together, make a dictionary; the rest fit the curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, resident, short_batches, small_batches, written

BLOCK_BYTES, DICT_BYTES, LEVEL = 512, 110_000, 3


@dataclass(frozen=True)
class Model:
    """Two dictionaries (bytes, and whether they are raw content) and the curve 1/(1+exp(-(a+b*x)))."""

    good: tuple[bytes, bool]
    bad: tuple[bytes, bool]
    a: float = 0.0
    b: float = 0.0

    def compressors(self):
        import zstandard as z

        out = []
        for data, raw in (self.good, self.bad):
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT if raw else z.DICT_TYPE_FULLDICT)
            d.precompute_compress(level=LEVEL)
            out.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a + self.b * x, -35, 35)))


def _blocks(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]


def difference(text: str | None, good, bad) -> float:
    """(bad size - good size) / (both): above 0 where the good dictionary helps more; 0 for empty texts."""
    g = b = 0
    for block in _blocks(text):
        g += len(good(block))
        b += len(bad(block))
    return (b - g) / (g + b) if g else 0.0


def held_out(id_col: str = "doc_id"):
    """True for the third of the documents that labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def _all_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 4 << 20):
        labels, blocks = [], []
        for y, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist()):
            own = _blocks(text)
            labels += [y] * len(own)
            blocks += own
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(blocks, pa.binary())], ["label", "block"])


def _for_dictionary(rows: list[tuple[int, int]], most: int) -> set[int]:
    """Ids of whole texts, in the order given, of ``most`` bytes together; half of the rows at most."""
    out: set[int] = set()
    for doc, size in rows:
        if len(out) < (len(rows) + 1) // 2 and size <= most:
            out.add(doc)
            most -= size
    return out


def _dictionary(blocks: list[bytes]) -> tuple[bytes, bool]:
    import zstandard as z

    try:
        return z.train_dictionary(DICT_BYTES, blocks).as_bytes(), False
    except z.ZstdError:  # too few blocks to train on: their bytes are the dictionary
        return (b"".join(blocks) or b" " * 8)[-DICT_BYTES:].rjust(8), True


def _raw_scores(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = resident(("quality", model.good, model.bad), model.compressors)
        for batch in small_batches(batches, 4 << 20):
            x = np.array([difference(t, good, bad) for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(x, pa.float64())], ["label", "x"])

    return rows


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one figure by Newton steps, with a slight ridge."""
    scale = float(x.std()) or 1.0
    design = np.column_stack([np.ones_like(x), x / scale])
    w = np.zeros(2)
    ridge = np.diag([1e-6, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        gradient = design.T @ (weight * (p - y)) + ridge @ w
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge + 1e-9 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step if np.abs(step).max() < 5 else step * 5 / np.abs(step).max()
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 3000, dictionary_bytes: int = 8 << 20) -> Model:
    """Learn from labelled documents that aren't held out.

    At most ``2 * per_class`` label rows reach the driver and, for either dictionary, whole texts of
    up to ``dictionary_bytes``; the other documents are for the curve and are scored whole, on the
    executors. The curve weighs the classes as they occur among the labels. Null labels and null ids
    are left out. With one class missing, every score is that of the label counts alone.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").where(~held_out("doc_id")).distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    if not n_good or not n_bad:
        odds = float(np.log((n_good + 1) / (n_bad + 1)))
        return Model((b" " * 8, True), (b" " * 8, True), odds, 0.0)
    order = F.xxhash64("doc_id")
    chosen = known.where("label = 1").orderBy(order, "doc_id").limit(per_class).unionByName(known.where("label = 0").orderBy(order, "doc_id").limit(per_class))
    # at most 2 * per_class rows of two numbers
    sample = docs.sparkSession.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, label int")
    texts = written(id_and_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id"), "labelled")
    sizes = texts.select("doc_id", "label", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy(order, "doc_id").collect()
    ids = set().union(*(_for_dictionary(list({r["doc_id"]: r["size"] for r in sizes if r["label"] == y}.items()), dictionary_bytes) for y in (0, 1)))
    half = F.col("doc_id").isin(sorted(ids)) if ids else F.lit(False)
    rows = texts.where(half).mapInArrow(_all_blocks, "label int, block binary").orderBy(F.xxhash64("block"), "block").collect()
    model = Model(*(_dictionary([bytes(r["block"]) for r in rows if r["label"] == y]) for y in (1, 0)))
    scored = texts.where(~half).mapInArrow(_raw_scores(model), "label int, x double").collect()
    if len({r["label"] for r in scored}) < 2:  # so few labels that one half lacks a class
        scored = texts.mapInArrow(_raw_scores(model), "label int, x double").collect()
    y = np.array([r["label"] for r in scored], float)
    x = np.array([r["x"] for r in scored])
    if len(set(y)) < 2:  # labels whose documents aren't there
        return Model(model.good, model.bad, float(np.log((n_good + 1) / (n_bad + 1))), 0.0)
    weight = np.where(y == 1, n_good / (y == 1).sum(), n_bad / (y == 0).sum()) * len(y) / (n_good + n_bad)
    return Model(model.good, model.bad, *_curve(x, y, weight))


def _scores(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = resident(("quality", model.good, model.bad), model.compressors)
        for batch in small_batches(batches, 4 << 20):
            p = model.probability(np.array([difference(t, good, bad) for t in batch["text"].to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(p, pa.float64())], ["doc_id", "score"])

    return rows


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted``.

    Scores look at nothing but the text. Null and empty texts get the curve's value at 0. Repeated
    rows score alike, null ids are not held out, and further columns are ignored.
    """
    scored = id_and_text(docs, id_col, text_col).mapInArrow(_scores(model), "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _passing(model: Model, text_col: str, least: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = resident(("quality", model.good, model.bad), model.compressors)
        for batch in small_batches(batches, 4 << 20):
            p = model.probability(np.array([difference(t, good, bad) for t in batch[text_col].to_pylist()]))
            yield batch.filter(pa.array(p >= least))

    return rows


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without documents that score below ``least``: all columns, nothing shuffled."""
    short_batches(docs.sparkSession)
    return docs.mapInArrow(_passing(model, text_col, least), docs.schema)
