"""Every registered query of the library against its SQL twin, over whole small tables."""

import duckdb
import pandas as pd
import pytest

from gaugeframe import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '/root/testdata/sf0.01/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return None if v != v else round(v, 3)
        return pd.Timestamp(v) if hasattr(v, "isoformat") else v

    return sorted(([value(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    rows = df.collect()
    assert rows
    if name not in queries.ORACLES:
        return
    twin = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(twin.columns)
    got, want = plain(rows, df.columns), plain(twin.fetchall(), twin.columns)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or isinstance(a, float) and abs(a - b) <= 2e-3 * max(1, abs(a)) for a, b in zip(g, w)), (g, w)
