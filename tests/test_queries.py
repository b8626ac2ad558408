"""Registered raster queries against DuckDB on the smallest tables."""

import glob
import os
import re

import duckdb
import pytest

from gridloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["raster_f32_deflate_pred3", "raster_u16_lzw_pred2_be", "raster_planar_f64", "raster_tile_prune", "raster_palette_join", "range_coalesce", "dtype_from_tags", "rational_div", "raster_tag_variants", "raster_differences", "raster_calibrated"])
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(want.columns) == cols
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want.select(",".join(cols)).fetchall()))


@pytest.mark.parametrize("name", ["bit_unpack", "raster_u16_lzw_pred2_be"])
def test_keys_of_more_than_two_bytes(spark, tmp_path, name):
    rows = [(k, k % 50 + 1) for k in (1, 255, 32767, 65535, 65536, 65537, 70001, 120000, (1 << 20) + 5)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    want = con.sql(catalogue.SQL[name])
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_sql_decode_cuts_binaries(spark, tmp_path):
    """Rows of pixels carry no tile, and no place is sought in a long string."""
    rows = [(k, 1 + k * 2654435761 % (2**31 - 1)) for k in range(0, 9000, 7)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    df = catalogue.QUERIES["raster_sql_decode"](spark, str(tmp_path))
    assert sorted(map(tuple, df.select("o_orderkey", "o_custkey").collect())) == rows
    assert not re.search(r"hex\((pythonUDF|raster_decode)", df._jdf.queryExecution().optimizedPlan().toString())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)
