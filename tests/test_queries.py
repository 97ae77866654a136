"""Every checked query against DuckDB, at the smallest size."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import TABLES, normal
from checks.queries import QUERIES

ALL = {name: run for name, run in queries().items() if name in QUERIES}
SQL = {name: sql for name, sql in oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(ALL) == set(SQL)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, db, sf, name):
    df = ALL[name](spark, sf)
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == normal(columns, result.fetchall())
