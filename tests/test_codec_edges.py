"""Codec queries on vectors at the edges of bytes and on odd ones, against their SQL in DuckDB."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessella.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracles()


def same(spark, folder, name, vectors):
    ids, values = zip(*vectors, strict=True)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(values, pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())}), f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    rel = con.execute(ORACLES[name])
    columns = [c[0] for c in rel.description]
    there = sorted(rel.fetchall(), key=str)
    got = sorted((tuple(r) for r in QUERIES[name](spark, str(folder)).select(*columns).collect()), key=str)
    assert got == there


def edges():
    """Vectors of the floats at and beside the lower ends of all bytes: there single and double precision part."""
    at = np.float32(np.arange(256) / 127.5 - 1)
    v = np.concatenate([np.nextafter(at, np.float32(-2)), at, np.nextafter(at, np.float32(2))])
    return [(n, row.tolist()) for n, row in enumerate(v.reshape(-1, 64))]


def odd():
    """Vectors that are none, empty, short or long, or hold what is no number."""
    whole = [i / 64 for i in range(64)]
    nan, inf = float("nan"), float("inf")
    return [(0, None), (1, []), (2, whole[:60]), (3, [*whole, 0.25]), (4, [nan, None, inf, -inf, 3e38, -3e38, *whole[6:]]), (5, whole)]


@pytest.mark.parametrize("vectors", [edges, odd])
@pytest.mark.parametrize("name", ["codec_png_u1_1", "codec_pnm_u1_1"])
def test_bytes_of_a_codec(spark, tmp_path, name, vectors):
    same(spark, tmp_path, name, vectors())


@pytest.mark.parametrize("vectors", [edges, odd])
def test_bytes_of_files_told_apart(spark, tmp_path, vectors):
    rows = vectors()
    same(spark, tmp_path, "source_any", [*rows, (-1, rows[2][1]), (-6, rows[2][1]), (None, rows[2][1])])
