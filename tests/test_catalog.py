"""Every query against its SQL on the smallest tables."""

import os

import pytest

from loomgraph import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    return None if x is None or x != x else round(x, 9) if isinstance(x, float) else x


def rows(cursor_columns, data):
    order = sorted(range(len(cursor_columns)), key=lambda i: cursor_columns[i])
    return sorted(cursor_columns), sorted(([str(plain(r[i])) for i in order] for r in data))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    cur = duck.execute(catalog.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).columns


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
