"""Near-duplicates against all pairs by brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import graph, near_dups


def brute_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k):
    sets = [brute_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least[root(i)] if d is not None else None, d is None or least[root(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("k", [2, 5])
def test_matches_all_pairs(make_docs, real_docs, k):
    rng = random.Random(k)
    texts = [None, "", "  \n", "One", "one", "two words", "Two  WORDS", "a b c", "a b c", " x", "é É"]
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts += [" ".join(base)] * 4 + [edited(rng, base, rng.randrange(1, 40)) for _ in range(60)]  # around the bound
    chain = base[:]
    for _ in range(15):  # each like the one before, the last unlike the first
        chain = edited(rng, chain, 8).split()
        texts.append(" ".join(chain))
    texts += ["x " * 20000, "x " * 100]
    rng.shuffle(texts)
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(None, " ".join(base)), (None, " ".join(base)), (9, texts[3])]
    rows += [(r.doc_id + 10_000, r.text) for r in real_docs.collect()]
    docs = make_docs(rows).withColumn("kept", F.lit("clash")).withColumn("component", F.lit(1))
    got = near_dups.near_duplicates(docs, shingle_words=k).collect()
    assert order(got) == order(brute(rows, k))


def test_pairs_across_a_bucket_are_found(make_docs):
    """The bucket's smallest document is like neither of two that are like each other."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, edited(rng, base, 26)) for i in range(40)]
    for i in range(40, 60):
        rows.append((i, edited(rng, rows[i - 30][1].split(), 5)))
    got = near_dups.near_duplicates(make_docs(rows), shingle_words=2).collect()
    assert order(got) == order(brute(rows, 2))


def test_signature_similarity_is_unbiased():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 2**63, 600).astype(np.uint64)
        a, b = np.unique(pool[:500]), np.unique(pool[100:])
        s = near_dups.signatures([a, b])
        errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_dropping_keeps_one_of_each_group(make_docs):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(5, long), (5, long), (2, long + " more"), (8, "other text here now ok"), (None, long), (9, None), (9, None), (8, "else entirely different words in here")]
    docs = make_docs(rows)
    kept = near_dups.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert order((r.doc_id, r.text) for r in kept.collect()) == order([rows[i] for i in (2, 3, 4, 5, 7)])
    assert near_dups.drop_near_duplicates(docs.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(7, 7), (None, 3)] + [(500, 500 + i) for i in range(1, 300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seen = {}
    for start in sorted(near):
        todo = [start] if start not in seen else []
        while todo:
            v = todo.pop()
            if v not in seen:
                seen[v] = start
                todo += near[v]
    assert got == seen
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_an_id_with_several_texts(make_docs):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (0, a + " end"), (7, b), (7, b), (1, b), (-4, None)]
    docs = make_docs(rows)
    assert order(near_dups.near_duplicates(docs, shingle_words=2).collect()) == order(brute(rows, 2))
    assert order((r.doc_id, r.text) for r in near_dups.drop_near_duplicates(docs, shingle_words=2).collect()) == order([rows[i] for i in (1, 2, 6)])


def _pairs_made(monkeypatch, docs):
    made = []
    across = near_dups._across

    def counted(cells, percent, tables):
        made.append(across(cells, percent, tables).count())
        return across(cells, percent, tables)

    monkeypatch.setattr(near_dups, "_across", counted)
    rows = near_dups.near_duplicates(docs, shingle_words=2).collect()
    monkeypatch.setattr(near_dups, "_across", across)
    return made[0], rows


def test_pairs_grow_with_a_group_not_its_square(make_docs, monkeypatch):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, edited(rng, base, rng.randrange(1, 40))) for i in range(600)]
    monkeypatch.setattr(near_dups, "PART_MEMBERS", 20)  # leads in many parts
    few, _ = _pairs_made(monkeypatch, make_docs(rows[:300]))
    many, got = _pairs_made(monkeypatch, make_docs(rows))
    assert many <= 3 * few + 600 and many <= len(rows)
    assert order(got) == order(brute(rows, 2))
    # repeated rows make no further pairs
    again, _ = _pairs_made(monkeypatch, make_docs(rows + [rows[0]] * 50 + rows[:100]))
    assert again == many
