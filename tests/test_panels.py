"""Panels scored move by move against full recomputation; the beam against all panels."""

import itertools
import math
import random
import statistics

import numpy as np

from gaugeframe.operators import panels


def corr(x, y):
    if np.std(x) < 1e-9 or np.std(y) < 1e-9:
        return None
    return round(float(np.corrcoef(x, y)[0, 1]), 9) + 0.0


def judged(panel, one, other, kind):
    """Metrics of one panel from scratch."""
    cats, all_, bad_, gaps = [], [], [], []
    for a in sorted(one):
        r = {b: corr([one[a].get(f, 0.0) for f in panel], [other[b].get(f, 0.0) for f in panel]) for b in other}
        ranked = sorted(r, key=lambda b: (r[b] is None, -(r[b] or 0), b))
        if r[ranked[1]] is not None:
            gaps.append(r[ranked[0]] - r[ranked[1]])
        of = lambda b: kind.get((a, b), "bad")
        cats.append(of(ranked[0]) if any(of(b) == "preferred" for b in other) else "unscored")
        own = [r[b] for b in other if of(b) == "preferred" and r[b] is not None]
        for into, test in ((all_, lambda b: of(b) != "preferred"), (bad_, lambda b: of(b) == "bad")):
            rest = [r[b] for b in other if test(b) and r[b] is not None]
            if own and rest:
                into.append(max(own) - max(rest))
    middle = lambda v: statistics.median(v) if v else None
    return cats.count("bad"), cats.count("soft"), cats.count("family"), middle(bad_), middle(all_), middle(gaps), len(panel)


def rank(m):
    return (*m[:3], *(math.inf if v is None else -round(v, 9) for v in m[3:6]), m[6])


def tables(spark, seed):
    rng = random.Random(seed)
    features = [f"f{i}" for i in range(8)]
    one = {a: {f: float(rng.randrange(9)) for f in features if rng.random() < 0.9} for a in "pqrs"}
    other = {b: {f: one[a].get(f, 0) + rng.gauss(0, 2) for f in features} for b, a in zip("PQRST", "pqrsp")}
    one["s"] = {f: 3.0 for f in features}  # without spread
    kind = {(a, a.upper()): "preferred" for a in "pqs"} | {("p", "T"): "soft", ("q", "P"): "family", ("r", "R"): "family"}
    frame = lambda t: spark.createDataFrame([(k, f, v) for k, vs in t.items() for f, v in vs.items()], "label string, feature string, value double")
    relations = spark.createDataFrame([(a, b, k) for (a, b), k in kind.items()] + [("p", "P", "family"), ("p", None, "soft")], "a string, b string, kind string")
    return features, one, other, kind, panels.terms(frame(one), frame(other), "label", "feature", "value"), relations


def test_moves_equal_full_sums(spark):
    features, one, other, kind, told, relations = tables(spark, 1)
    start = features[:4]
    beam = panels.keyed(spark, [start])
    sums = panels.summed(told, beam.selectExpr("panel", "explode(features) as feature"))
    moves = panels.all_moves(beam, features)
    got = panels.scores(panels.moved(told, sums, moves), relations).join(moves, "panel").collect()
    assert len(got) == 4 + 4 + 16
    for r in got:
        panel = sorted((set(start) - {r.dropped}) | ({r.added} - {None}))
        want = judged(panel, one, other, kind)
        for g, w in zip((r.bad, r.soft, r.family, r.margin_bad, r.margin_all, r.gap, r.size), want):
            assert g == w or abs(g - w) < 1e-7, (r, want)


def test_search_goes_on_with_the_best(spark):
    features, one, other, kind, told, relations = tables(spark, 2)
    got = panels.search(told, relations, features[:3], [*features, "absent"], width=3, rounds=2).collect()
    beam, seen = [tuple(features[:3])], {tuple(features[:3])}
    for turn in (1, 2):
        near = {tuple(sorted(set(p) ^ set(m))) for p in beam for m in [(f,) for f in features] + [(f, g) for f, g in itertools.product(p, set(features) - set(p))]}
        near = {p for p in near if len(p) >= 2 and p not in seen}
        best = sorted(near, key=lambda p: rank(judged(p, one, other, kind)))
        beam = [tuple(r.features) for r in got if r.round == turn]
        assert [rank(judged(p, one, other, kind)) for p in beam] == [rank(judged(p, one, other, kind)) for p in best[:3]]
        seen |= set(beam)


def test_nothing_to_compare(spark):
    _, _, _, _, told, relations = tables(spark, 3)
    empty = panels.summed(told, spark.createDataFrame([], "panel long, feature string"))
    assert panels.scores(empty, relations).count() == 0
