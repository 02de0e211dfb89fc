"""The compression classifier: held-out accuracy, its fold rule and odd inputs."""

import zlib

import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import quality

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, quality.fit(docs, labels)


def test_held_out_accuracy_and_ranking(fitted):
    docs, labels, model = fitted
    rows = quality.score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
    assert auc > 0.93 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    assert sum(g >= 0.5 for g in good) / len(good) > 0.97


def test_scores_match_an_independent_scorer(fitted, real_docs):
    """Block by block with the library itself, from the dictionaries' bytes and the curve."""
    import math

    import zstandard

    docs, _, model = fitted
    assert not model.good[1] and not model.bad[1]
    sides = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d, _ in (model.good, model.bad)]
    rows = {r.doc_id: r for r in quality.score_quality(real_docs, model).collect()}
    for d in real_docs.collect():
        raw = (d.text or "").encode()
        good, bad = (sum(len(c.compress(raw[i : i + 512])) for i in range(0, len(raw), 512)) for c in sides)
        x = (bad - good) / (good + bad) if raw else 0.0
        p = 1 / (1 + math.exp(-(model.a + model.b * x)))
        assert abs(rows[d.doc_id].score - p) < 1e-9 and rows[d.doc_id].predicted == (p >= 0.5)


def test_dictionary_takes_whole_texts_within_its_bound():
    assert quality._for_dictionary([(1, 50), (2, 70), (3, 40), (4, 5), (5, 1), (6, 1)], 100) == {1, 3, 4}
    assert quality._for_dictionary([(1, 500)], 100) == set() and quality._for_dictionary([], 9) == set()


def test_fold_and_bounds(fitted):
    docs, _, model = fitted
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_held_out_labels_change_nothing(fitted):
    docs, labels, model = fitted
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, flipped) == model


def test_every_part_of_a_long_text_counts(fitted, make_docs):
    docs, labels, model = fitted
    good = docs.join(labels.where("quality = 1"), "doc_id").orderBy("doc_id").first().text
    bad = docs.join(labels.where("quality = 0"), "doc_id").orderBy("doc_id").first().text
    g, b = model.compressors()
    assert quality.difference(good * 20, g, b) > quality.difference(good * 20 + bad * 40, g, b) > quality.difference(bad * 20, g, b)


def test_odd_inputs(fitted, make_docs, spark):
    _, _, model = fitted
    docs = make_docs([(1, None), (2, ""), (3, "x " * 100000), (4, "same"), (4, "same"), (None, "y")]).withColumn("score", F.lit(9))
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (1, 2)} == {float(model.probability(quality.np.array([0.0]))[0])}
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert quality.score_quality(docs.where("false"), model).count() == 0
    some = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int")
    for labels in (some, some.where("false"), spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, 1, 0)], some.schema)):
        assert quality.score_quality(docs, quality.fit(docs, labels)).count() == 6
