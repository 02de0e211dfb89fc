"""Registered queries against their SQL twins over whole small tables."""

import duckdb
import pytest

from gaugeframe.llm import queries

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as from '{DIR}/{t}.parquet'")
    twin = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(twin.columns)
    got = sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    want = sorted((tuple(r) for r in con.sql(f"select {', '.join(sorted(twin.columns))} from ({queries.ORACLES[name]})").fetchall()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or isinstance(a, float) and abs(a - b) < 1e-12 for a, b in zip(g, w)), (g, w)
