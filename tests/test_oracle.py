"""Every query with SQL against DuckDB on the same tables."""

import functools
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tillwise.plans import reports
from tillwise.plans.reports import monthly_sales
from tillwise.sources.sample_tables import SampleTables
from tillwise.sources.shared import settle

FOLDER = "/root/testdata/sf0.01"
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def tables(spark):
    """One instance for all queries: merchant orders and monthly sales are derived once."""
    shared = SampleTables(spark, FOLDER)
    shared.orders = shared.stored_orders
    with pytest.MonkeyPatch.context() as patch:
        once = functools.cache(lambda: settle(monthly_sales(entry._inputs(shared, stored=True))))
        patch.setattr(reports, "monthly_sales", lambda inputs: once())
        yield shared


def test_every_query_has_sql():
    assert {q.__name__ for q in entry._QUERIES} <= set(SQL)
    assert not set(SQL) - set(entry.queries())


@pytest.mark.parametrize("query", entry._QUERIES, ids=lambda q: q.__name__)
def test_same_rows(query, tables, duck):
    ours = query(tables)
    theirs = duck.sql(SQL[query.__name__])
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    kinds = dict(zip(theirs.columns, theirs.types))
    assert {n: TYPES[k] for n, k in ours.dtypes} == {n: str(kinds[n]) for n in names}
    got = sorted(repr(tuple(r[n] for n in names)) for r in ours.collect())
    want = sorted(
        repr(tuple(dict(zip(theirs.columns, r))[n] for n in names)) for r in theirs.fetchall()
    )
    assert got
    assert got == want


def test_entry_runs(spark):
    report = entry.entry(spark)
    assert report.columns[0] == "merchant_name"
    assert report.count() > 0
