"""Fill-in-middle against a plain version, and its rank index against the offsets themselves."""

import hashlib
import random
import re

import numpy as np

from gaugeframe.llm import fill_middle, queries

ODD = [None, "", " ", "\n", "\n\n\n", "a", "a\n", "é\U0001f600\nb", "with <P> in it\nx\n", "<S\nP>\n<M", "x\n" * 50000, "y" * 300000 + "\nz", "".join("w" * (k % 997) + "\n" for k in range(3000)), "\r\n\x0b \n"]


def plain_version(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    return len(lines), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_index_gives_every_offset_within_its_bound():
    rng = random.Random(3)
    for error in (1, 7, 512):
        for lengths in ([], [1], [5] * 400, [rng.randrange(1, 3000) for _ in range(3000)], [100000, 1, 1, 1, 90000] * 5):
            offsets = np.cumsum([0, *lengths])
            index = fill_middle.RankIndex(offsets, error)
            assert [index.offset(k) for k in range(len(offsets))] == offsets.tolist()
            assert np.abs(index.residuals).max() <= error
    assert len(fill_middle.RankIndex(np.arange(0, 80 * 100000, 80)).starts) == 1


def test_matches_plain_version(make_docs, real_docs):
    docs = make_docs(ODD).unionByName(make_docs([(5, "twice\nthere"), (5, "twice\nthere"), (5, "another\none\n"), (None, "no id\nat all\n")])).unionByName(real_docs)
    docs = docs.withColumnsRenamed({"lang": "form", "source": "output"})  # names that the result has
    for rates in ((100, 50), (60, 20)):
        want = sorted(((r.doc_id, *plain_version(r.doc_id, r.text, 7, *rates)) for r in docs.collect()), key=repr)
        got = fill_middle.fill_in_middle(docs, rate=rates[0], spm_rate=rates[1]).collect()
        assert all(r.round_trip for r in got)
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_query_over_all_documents(spark):
    rows = {r.doc_id: r for r in queries.op12_fill_in_middle(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n, form, prefix, middle, output = plain_version(d.doc_id, d.text)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = rows[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, prefix, middle, sha(output), sha(d.text or ""))


def test_empty_table(make_docs):
    assert fill_middle.fill_in_middle(make_docs([]), digests=True).collect() == []
