"""Every query with SQL against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from quillon import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def tidy(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    return sorted(columns), sorted(repr([one(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(name, spark, duck, sf_dir):
    df = catalog.queries()[name](spark, sf_dir)
    got = tidy(df.columns, [tuple(r) for r in df.collect()])
    want = duck.execute(SQL[name])
    assert got == tidy([c[0] for c in want.description], want.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalog.queries())
