"""Communities by modularity against all partitions of small graphs, and planted ones of a larger graph."""

import random

import pytest

from gaugeframe.operators import modularity

SCHEMA = "a long, b long, w double"


def quality(edges, label, gamma):
    m2 = 2 * sum(w for _, _, w in edges)
    total, inside = {}, 0.0
    for a, b, w in edges:
        inside += 2 * w * (label[a] == label[b])
        for n in (a, b):
            total[label[n]] = total.get(label[n], 0.0) + w
    return inside / m2 - gamma * sum(t * t for t in total.values()) / (m2 * m2)


def partitions(nodes):
    """All partitions, as labels."""
    if not nodes:
        yield {}
        return
    for rest in partitions(nodes[1:]):
        for k in range(max(rest.values(), default=-1) + 2):
            yield {nodes[0]: k, **rest}


def by_resolution(labels):
    out = {}
    for r in labels.collect():
        out.setdefault(r.resolution, {})[r.node] = r.community
    return out


def test_no_partition_is_better(spark):
    rng = random.Random(4)
    # two small graphs at once: what is best for both is best for each
    edges = [(a, b, rng.choice([0.5, 1.0, 2.0])) for a in range(8) for b in range(a) if rng.random() < (0.8 if a // 4 == b // 4 else 0.25)]
    edges += [(3, 3, 0.5)]
    labels, figures = modularity.communities(spark.createDataFrame([*edges, (1, None, 1.0), (0, 5, -2.0)], SCHEMA), "a", "b", "w", (0.5, 1.0, 1.6), orders=3)
    found, told = by_resolution(labels), {r.resolution: r for r in figures.collect()}
    for gamma in (0.5, 1.0, 1.6):
        best = max(quality(edges, label, gamma) for label in partitions(sorted({n for a, b, _ in edges for n in (a, b)})))
        assert quality(edges, found[gamma], gamma) == pytest.approx(told[gamma].modularity) == pytest.approx(best)
        names = found[gamma].values()
        assert told[gamma].communities == len(set(names)) and all(min(n for n, c in found[gamma].items() if c == name) == name for name in names)


def test_planted_communities(spark):
    rng = random.Random(6)
    edges = [(a, b, 1.0) for a in range(120) for b in range(a) if rng.random() < (0.5 if a // 20 == b // 20 else 0.02)]
    df = spark.createDataFrame(edges, SCHEMA)
    labels, _ = modularity.communities(df, "a", "b", "w")
    assert by_resolution(labels)[1.0] == {n: n // 20 * 20 for n in range(120)}
    scores = spark.createDataFrame([(n, 5.0 if 40 <= n < 60 else n / 1000) for n in range(120)], "id long, marker double")
    assert [tuple(r) for r in modularity.best_communities(labels, scores, "id", "marker").collect()] == [(1.0, 40, 5.0, 20)]


def test_no_edges(spark):
    labels, figures = modularity.communities(spark.createDataFrame([(1, None, 1.0), (None, None, None)], SCHEMA), "a", "b", "w", (0.5, 1.0))
    assert labels.isEmpty() and figures.isEmpty()
