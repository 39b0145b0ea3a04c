"""Every eighth raster query against its SQL in DuckDB (all of them with TESSELLA_ALL=1)."""

import glob
import os

import duckdb
import pytest

from tessella.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracles()
NAMES = sorted(ORACLES)[:: 1 if os.environ.get("TESSELLA_ALL") else 8]
NAMES += [n for n in sorted(ORACLES) if n.startswith(("codec_", "source_")) and n not in NAMES]


def rows(values):
    return sorted(tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in values)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    rel = duck.execute(ORACLES[name])
    there = [c[0] for c in rel.description]
    assert sorted(there) == columns
    order = [there.index(c) for c in columns]
    assert rows(got) == rows(tuple(r[i] for i in order) for r in rel.fetchall())
