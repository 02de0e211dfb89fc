"""Queries on embeddings that SQL has no twin of, against brute force over all rows."""

import numpy as np

from gaugeframe import queries


def test_batch_neighbours_are_the_nearest_of_all_rows(spark, sf):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = {}
    for r in queries.QUERIES["batch_neighbours"](spark, sf).collect():
        got.setdefault((r.q, r.batch), []).append((r["rank"], r.r, r.distance))
    assert set(got) == {(q, b) for q in rows if q % 50 == 0 for b in (0, 1)}
    for (q, b), found in got.items():
        own = [r for r in rows if (r % 100 < 50) == bool(b)]
        want = sorted(float(np.linalg.norm(rows[r] - rows[q])) for r in own)[:3]
        assert {r for _, r, _ in found} <= set(own)
        assert np.allclose([d for _, _, d in sorted(found)], want, atol=1e-6)


def test_every_row_has_a_community(spark, sf):
    ids = sorted(r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    assert sorted(r.node for r in queries.QUERIES["communities"](spark, sf).collect()) == ids
