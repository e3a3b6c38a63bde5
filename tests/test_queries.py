"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from tools.check_queries import TABLES, table

# slow whole extractions have their own test; wide cross-engine joins run in tools/check_queries.py
FAST = ["clean_points", "color_by_index", "range_to_xyz_a", "range_to_xyz_b", "surfels", "octree_rollup", "finest_normal",
        "sphere_votes", "rho_histogram", "grid_contact", "plane_pca_fit", "msac_plane", "texture_rgb", "blur",
        "region_classes", "region_borders", "chunked_points", "duplicate_claims", "spread_candidates", "merge_candidates"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, sf, duck, name):
    df = driver.queries()[name](spark, sf)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(driver.oracle_sql()[name])
    assert got == table([d[0] for d in res.description], res.fetchall())


def test_registry():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert len(driver.queries()) > 80


def test_entry(spark):
    assert driver.entry(spark).count() > 0
