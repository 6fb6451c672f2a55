"""The registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from profusion.plans import catalog, run_catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(rows):
    form = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(form, r)) for r in rows)


QUERIES, SQL = catalog.queries() | run_catalog.queries(), catalog.oracle_sql() | run_catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})")
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_of_the_catalog_has_sql():
    assert set(QUERIES) == set(SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
