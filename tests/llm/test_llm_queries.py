"""The queries of this subpackage against the SQL that must give the same rows."""

import glob
import os

import duckdb
import pytest

from palimpsest.llm.oracle import oracle_sql
from palimpsest.llm.queries import queries


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, sf, name):
    df = queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=repr)
    rel = con.sql(oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["p10_redacted"])
def test_query_runs(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0
