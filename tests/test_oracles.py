"""Every bound query against the independent SQL engine on the smallest data set."""

import duckdb
import pytest

from terrace.catalog import TABLES
from terrace.plans import bindings, oracles

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = bindings.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rounded(rows, order):
    return sorted((tuple(round(r[i], 4) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=str)


def test_each_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df, want = QUERIES[name](spark, FOLDER), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    got = rounded([tuple(r) for r in df.collect()], [df.columns.index(c) for c in columns])
    assert got == rounded(want.fetchall(), [want.columns.index(c) for c in columns])
