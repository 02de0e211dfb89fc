"""The neighbour graph against brute force: recall, exact scores, ties and vectors that take no part."""

import numpy as np
import pytest

from gaugeframe.llm import neighbour_graph as ng
from gaugeframe.llm import queries

NAN, INF = float("nan"), float("inf")


def brute(rows, n):
    """{query: [(vec_id, score)]} over (id, vector) rows of equal length."""
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], float)
    norms = np.sqrt((v * v).sum(1))
    out = {}
    for k, i in enumerate(ids):
        if i % 50 == 0:
            s = (v[k] * v).sum(1) / (norms[k] * norms)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:n]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        got = out.setdefault(r.query_id, [])
        assert r.rank == len(got) + 1
        got.append((r.vec_id, r.score))
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_query_recall_and_scores(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = brute(rows, len(rows) - 1)
    got = found(queries.op11_neighbours(spark, d))
    assert all(len(g) == 5 for g in got.values()) and set(got) == set(want)
    assert recall(got, {q: w[:5] for q, w in want.items()}) >= 0.9
    for q, rows in got.items():
        exact = dict(want[q])
        assert all(abs(s - exact[i]) < 1e-12 for i, s in rows)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    rows = [(i, list(map(float, centres[i % 40] + rng.normal(size=24) * 0.7))) for i in range(3000)]
    # a third of all rows: one vector; many near copies of another
    rows += [(i, rows[7][1]) for i in range(3000, 4500)]
    return rows + [(i, list(map(float, centres[0] + rng.normal(size=24) * 1e-3))) for i in range(4500, 4900)]


def test_hot_vector_ties_and_near_copies(spark, clustered):
    got = found(ng.nearest_rows(spark.createDataFrame(clustered, "vec_id long, embedding array<double>").repartition(5), "vec_id % 50 = 0"))
    want = brute(clustered, 5)
    assert recall(got, want) >= 0.97
    hot = [q for q in want if 3000 <= q < 4500]
    # the smallest ids of equal vectors, exactly
    assert all([i for i, _ in got[q]] == [i for i in (7, 3000, 3001, 3002, 3003, 3004) if i != q][:5] for q in hot)


def test_queries_from_outside(spark, clustered):
    df = spark.createDataFrame(clustered, "vec_id long, embedding array<double>")
    rng = np.random.default_rng(2)
    asked = [(100000 + 50 * k, [x + 0.1 * float(rng.normal()) for x in clustered[k][1]]) for k in range(60)]
    graph = ng.build(df)
    got = found(ng.search(graph, spark.createDataFrame(asked, "vec_id long, embedding array<double>")))
    want = {q: [(i, s) for i, s in near if i < 100000][:5] for q, near in brute(clustered + asked, 200).items() if q >= 100000}
    assert recall(got, want) >= 0.9


def test_what_takes_no_part(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (150, [None, 1.0]), (200, [NAN, 1.0]), (250, [INF, 1.0]), (300, [1.0, 2.0, 3.0]), (350, []), (None, [1.0, 1.0]), (400, [2.0, 0.0]), (3, [1e-200, 1e-200]), (4, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as node", "'x' as raw")
    got = found(ng.nearest_rows(df, "vec_id % 50 = 0"))
    half = 1 / np.sqrt(2)
    assert {q: [(i, round(s, 12)) for i, s in near] for q, near in got.items()} == {0: [(400, 1.0), (3, round(half, 12)), (4, -1.0)], 400: [(0, 1.0), (3, round(half, 12)), (4, -1.0)]}


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert found(ng.nearest_rows(spark.createDataFrame([], schema), "vec_id % 50 = 0")) == {}
    assert found(ng.nearest_rows(spark.createDataFrame([(0, [1.0])], schema), "vec_id % 50 = 0")) == {}
    assert found(ng.nearest_rows(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema), "vec_id % 50 = 0")) == {0: [(1, 1.0)]}
