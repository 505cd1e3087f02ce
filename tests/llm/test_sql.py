"""The operators that SQL can express against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from quillon.llm import registry
from tests.test_oracles import tidy


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equal(name, spark):
    sf_dir, con = "/root/testdata/sf0.01", duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = registry.queries()[name](spark, sf_dir)
    got = tidy(df.columns, [tuple(r) for r in df.collect()])
    want = con.execute(registry.oracle_sql()[name])
    assert got == tidy([c[0] for c in want.description], want.fetchall())
