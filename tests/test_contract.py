"""Every named query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from entrypoints.oracle import ORACLE
from entrypoints.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
NAMES = list(QUERIES)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(FOLDER)):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def test_every_query_has_sql():
    assert set(NAMES) == set(ORACLE)
    assert set(NAMES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(entry_module.oracle_sql()[name])
    theirs_columns = [d[0] for d in cursor.description]
    assert sorted(theirs_columns) == columns
    order = [theirs_columns.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    assert ours == theirs


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
