"""Line dedup against brute force, and its SQL twin."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import line_dedup


def brute(rows, least):
    """rows: (doc_id, text, site). Same order back: (doc_id, text, n_lines, n_removed)."""
    sites, first = {}, {}
    key = lambda d, p: (d if d is not None else 1 << 63, p)
    for d, t, s in rows:
        for p, line in enumerate((t or "").split("\n")):
            line = line.strip(" ")
            if line:
                sites.setdefault(line, set()).update({s} - {None})
                first[line] = min(first.get(line, key(d, p)), key(d, p))
    out = []
    for d, t, s in rows:
        parts = (t or "").split("\n")
        gone = [bool(x.strip(" ")) and len(sites[x.strip(" ")]) >= least and first[x.strip(" ")] != key(d, p) for p, x in enumerate(parts)]
        text = t if t is None else "\n".join(x for x, g in zip(parts, gone) if not g)
        out.append((d, text, sum(bool(x.strip(" ")) for x in parts), sum(gone)))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("least", [2, 5, 10])
def test_matches_brute_force(spark, least):
    rng = random.Random(least)
    rows = []
    for i in range(150):
        lines = [f"shared {rng.randrange(30)}" + " " * rng.randrange(2) if rng.random() < 0.5 else f"own {i} {k}" for k in range(rng.choice([1, 3, 70, 200]))]
        lines += ["", "é line", "x\ty"][: rng.randrange(4)]
        rows.append((i, "\n".join(lines), f"s{min(int(rng.expovariate(0.2)), 25)}" if rng.random() < 0.95 else None))
    rows += [(900, None, "s1"), (901, "", "s2"), (902, "\n\n", "s3"), (None, "shared 1\nz", "s4"), (None, "shared 1", "s4"), (3, "shared 2\nshared 2", "s1"), (3, rows[3][1], rows[3][2]), (904, "y " * 30000 + "\nshared 3", "s9")]
    docs = spark.createDataFrame([(d, t, s, 1, "x", 7) for d, t, s in rows], "doc_id long, text string, source string, line int, site string, n_lines int")
    got = line_dedup.dedup_lines(docs, min_sites=least)
    assert got.columns == [*docs.columns, "n_removed"]
    assert order(got.select("doc_id", "text", "n_lines", "n_removed").collect()) == order(brute(rows, least))


def test_real_rows_and_dropping(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], 10)
    assert sum(w[3] for w in want) > 50
    got = line_dedup.line_digests(docs).collect()
    assert order(got) == order((d, n, r, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, r in want)
    kept = line_dedup.drop_boilerplate(docs)
    assert kept.columns == docs.columns
    assert order(kept.select("doc_id", "text").collect()) == order((d, t) for d, t, n, r in want if not (r and r == n))


def test_sql_twin(spark, real_docs):
    import duckdb

    con = duckdb.connect()
    con.sql("create view documents as from '/root/testdata/sf0.01/documents.parquet'")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert order(con.sql(line_dedup.DIGEST_SQL).fetchall()) == order(line_dedup.line_digests(docs).collect())


def test_empty_table(make_docs):
    empty = make_docs(["x"]).where("false")
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(make_docs([None, ""])).where(F.col("n_removed") > 0).count() == 0


def test_dropping_leaves_columns_of_the_same_names(make_docs):
    docs = make_docs(["one\ntwo", None, ""]).withColumns({"n_lines": F.lit(99), "n_removed": F.lit("x")})
    kept = line_dedup.drop_boilerplate(docs)
    assert kept.columns == docs.columns and sorted(kept.collect(), key=repr) == sorted(docs.collect(), key=repr)
