"""Merkle fingerprints against a brute-force tree."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import merkle

md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def tree(text):
    pieces = lambda pattern, t: [m for m in re.findall(pattern.replace(r"\z", r"\Z"), t)]
    out = [[[md5(x) for x in pieces(merkle.PASSAGE, p)] for p in pieces(merkle.PARAGRAPH, s)] for s in pieces(merkle.SECTION, text)]
    assert "".join(x for s in pieces(merkle.SECTION, text) for p in pieces(merkle.PARAGRAPH, s) for x in pieces(merkle.PASSAGE, p)) == text
    return out


def brute_print(text):
    t = tree(text)
    root = sha("".join(md5("".join(md5("".join(p)) for p in s)) for s in t))
    return root + ":" + ";".join(",".join(".".join(h[:10] for h in p) for p in s) for s in t)


def brute_like(a, b):
    if a.split(":")[0] == b.split(":")[0]:
        return 1.0
    x, y = ({h for h in re.split("[.,;]", f.split(":")[1]) if h} for f in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 3
        e = t[: len(t) - cut] + nxt[:cut]
        f, g = brute_print(t), brute_print(e)
        out.append((d, len(t), sha(e), f, g, brute_like(f, g), brute_like(f, brute_print(nxt))))
    return out


ODD = [None, "", "\n", "\n\n\n", "a", "ab", "abc", "é. ü! x", "One. Two.\n\nThree\nfour. 五六七。 😀😀😀\n\n", "\n\nlead", "z" * 1000, "w " * 50000, "A. " * 3000]


def same(got, want):
    got, want = sorted(map(tuple, got), key=repr), sorted(want, key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(x - y) < 1e-12 for g, w in zip(got, want) for x, y in zip(g[5:], w[5:]))


@pytest.mark.parametrize("size", [1, 7, 500])
def test_matches_brute_force(make_docs, real_docs, monkeypatch, size):
    monkeypatch.setattr(merkle, "RANGE_ROWS", size)
    rows = [(i * i * 37 % 1009 - 5, t) for i, t in enumerate(ODD)] + [(None, "null id"), (None, "again"), (7_000, "tie b"), (7_000, "tie a"), (7_000, "tie a")]
    rows += [(r.doc_id + 10_000, r.text) for r in real_docs.limit(80).collect()]
    docs = make_docs(rows).withColumn("key", F.lit(1)).withColumn("range", F.lit("x"))
    same(merkle.edited_fingerprints(docs).collect(), brute(rows))


def test_few_rows(make_docs):
    for rows in ([(1, "only. one here")], [(None, "x")], [(None, "x"), (None, "y")], [(1, "a"), (2, "b")]):
        same(merkle.edited_fingerprints(make_docs(rows)).collect(), brute(rows))
    assert merkle.edited_fingerprints(make_docs(["x"]).where("false")).count() == 0


def test_equal_texts_and_unequal_ones(spark):
    texts = ["a\n\nb", "a\n\n\nb", "a\nb", "a b", "a. b", "a.  b", "", " "]
    prints = [r.f for r in spark.createDataFrame([(t,) for t in texts * 2], "t string").select(merkle.fingerprint(F.col("t")).alias("f")).collect()]
    assert prints[:8] == prints[8:] and len({p.split(":")[0] for p in prints}) == 8


def test_branches_that_differ(spark):
    rng = random.Random(1)
    a = [[" ".join(f"w{rng.randrange(99)}" for _ in range(9)) + "." for _ in range(4)] for _ in range(3)]
    b = [s[:] for s in a]
    b[1][2] = "changed here."
    b[2].append("new.")
    text = lambda d: "\n\n".join("\n".join(s) for s in d)
    prints = spark.createDataFrame([(text(a), text(b))], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    got = prints.select(merkle.differing_paragraphs(F.col("a"), F.col("b")).alias("d"), merkle.differing_paragraphs(F.col("a"), F.col("a")).alias("e")).first()
    assert [tuple(x) for x in got.d] == [(1, 2), (2, 3), (2, 4)] and got.e == []
