"""Layers from curve ranges, and consecutive numbers for ids of any kind."""

import pytest
from pyspark.sql import functions as F

from facetry.functions.moments import SUMS
from facetry.operators import octree
from facetry.params import SegParams
from facetry.sinks import tables

SPREAD = "(id*7919 % 1009)/252.25D - 2D as x", "(id*104729 % 1013)/253.25D - 2D as y", "(id*611953 % 997)/249.25D - 2D as z"


def rounded(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*octree.NODE, "n", *SUMS, "node_min").collect())


@pytest.mark.parametrize("p", [SegParams(rho_max=4.0, min_octree_resolution=0.125, sq_dist_factor=-1.0), SegParams(rho_max=4.0, min_octree_resolution=0.0625, sq_dist_factor=0.1)],
                         ids=["even", "by_range"])
def test_layers_by_curve_ranges(spark, p):
    pts = spark.range(4000).selectExpr("id % 3 as scan_id", "id as pid", *SPREAD)
    leaves = octree.leaf_moments(octree.with_keys(pts, p)).cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # many borders
    try:
        got = rounded(octree.roll_up(leaves, p.layers(), p))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == rounded(octree.roll_up(leaves, p.layers()))


def test_layers_of_nothing(spark):
    p = SegParams(rho_max=4.0, min_octree_resolution=0.5)
    pts = spark.range(0).selectExpr("id as scan_id", "id as pid", *SPREAD)
    assert octree.roll_up(octree.leaf_moments(octree.with_keys(pts, p)), p.layers(), p).count() == 0


def test_numbers_of_hashed_ids(spark):
    pts = spark.range(5000).selectExpr("id % 2 as scan_id", "if(id % 5 = 0, -1L, 1L)*abs(xxhash64(id)) as pid", *SPREAD)
    got = tables.numbered(pts)
    again = got.withColumn("want", F.expr("row_number() over (partition by scan_id order by pid) - 1"))
    assert again.filter("num <> want").count() == 0 and got.count() == 5000
    assert tables.chunks(pts).filter("size > 100").count() == 0
    assert tables.numbered(pts.limit(0)).count() == 0
