"""The pipeline, stage by stage, against brute force on small documents."""

import importlib
import sys
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeframe.llm import quality
from gaugeframe.llm.common import written
from tests.llm import test_line_dedup, test_near_dups, test_scans

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DIR), "stage"))
    return [d.collect() for d in out], [d.columns for d in out]


def rows(stage):
    return {r.doc_id: r for r in stage}


def test_columns_stay(stages):
    assert all(c == stages[1][0] for c in stages[1][1:-1]) and stages[1][-1] == ["doc_id", "ids", "round_trip", "n_ids"]


def test_quality_stage(spark, stages):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    g, b = model.compressors()
    want = {r.doc_id for r in stages[0][0] if model.probability(quality.np.array([quality.difference(r.text, g, b)]))[0] >= 0.5}
    assert {r.doc_id for r in stages[0][1]} == want
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in want for d in good) / len(good) > 0.97
    assert sum(d in want for d, q in labels.items() if q == 0) / (len(labels) - len(good)) < 0.3


def test_line_stage(stages):
    before, after = stages[0][1], rows(stages[0][2])
    want = test_line_dedup.brute([(r.doc_id, r.text, r.source) for r in before], 10)
    want = {d: t for d, t, n, gone in want if not (gone and gone == n)}
    assert {d: r.text for d, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_near_stage(stages):
    before, after = stages[0][2], rows(stages[0][3])
    kept = {d for d, _, _, k in test_near_dups.brute([(r.doc_id, r.text) for r in before], 5) if k}
    assert set(after) == kept and len(kept) < len(before)


def test_benchmark_stage(spark, stages):
    before, after = stages[0][3], rows(stages[0][4])
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    suspects = {r.doc_id for r in before} - set(after)
    for r in before:
        if r.doc_id in suspects or r.doc_id % 40 == 0:
            assert test_scans.brute_hits(r.text, items)[4] == (r.doc_id in suspects)
    assert suspects


def test_encoding_stage(stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = rows(stages[0][4])
    assert len(stages[0][5]) == len(stages[0][4])
    for r in stages[0][5][:150]:
        assert r.ids == library.encode(texts[r.doc_id].text) and r.n_ids == len(r.ids)
        assert r.round_trip == (library.decode(r.ids) == texts[r.doc_id].text)


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, DIR)
    assert sorted((r.doc_id, r.n_ids) for r in got.collect()) == sorted((r.doc_id, r.n_ids) for r in stages[0][5])


def test_odd_rows_pass_every_stage(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "ok " * 50000, None, "s", 1), (4, "same words here", "x", "s", 1), (4, "same words here", "x", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for start in (docs, docs.where("false")):
        d = start
        for _, stage in corpus_pipeline.STAGES:
            d = written(stage(spark, d, DIR), "stage")
        assert d.columns == ["doc_id", "ids", "round_trip", "n_ids"] and d.where(F.col("n_ids") > 0).count() == d.where(F.size("ids") > 0).count()


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names and sum(n.startswith("op") for n in names) == 10
    assert set(entry.oracle_sql()) <= names
    assert "corpus_pipeline" in sys.modules


def test_tables_are_deleted_when_their_readers_are_done(spark, stages):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    rows = corpus_pipeline.run(spark, DIR).collect()
    assert sorted(rows) == sorted(stages[0][-1])
    assert [p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p not in before] == ["decontamination"]
