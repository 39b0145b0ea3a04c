"""The operators' queries against their SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from tessella.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    out = queries.QUERIES[name](spark, sf)
    columns = sorted(out.columns)
    rel = con.execute(queries.ORACLES[name])
    there = [c[0] for c in rel.description]
    assert sorted(there) == columns
    want = [tuple(r[there.index(c)] for c in columns) for r in rel.fetchall()]
    got = [tuple(r) for r in out.select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and got
