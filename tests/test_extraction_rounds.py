"""Vote rounds settled in one task or by jobs, and consensus tries made one by one or in one pass."""

import pytest
from pyspark.sql import functions as F

from facetry.catalog.common import P
from facetry.catalog.views import load
from facetry.operators import octree, sphere
from facetry.plans import planes
from facetry.plans.book import stack
from facetry.plans.planes import NODE_COLS, NODE_KEY

LAYER = P.depth


@pytest.fixture(scope="module")
def votes(spark):
    nodes = octree.build(load(spark, "/root/testdata/sf0.01", "scene_points"), P, [LAYER])
    rows = sphere.votes(nodes.filter("stable").select(*NODE_COLS), P.phi_resolution, P.angle_eps, P.curv_threshold, True)
    return planes.stage(rows)


def rows_of(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*NODE_KEY, "round", "hx", "hy", "hz", "hd").collect())


def test_rounds_in_a_task_are_the_rounds_of_jobs(votes):
    p = P.but(tries_on_each_depth=1)
    here, jobs = rows_of(planes.vote_rounds(votes, p, LAYER)), rows_of(planes.vote_rounds(votes, p, LAYER, in_task=0))
    assert here == jobs and len({r[-5] for r in here}) > 3
    assert len({r[:len(NODE_KEY)] for r in here}) == len(here)  # a node leaves with its round


def test_rounds_made(spark):
    """Few voters or too few points so far count as failures; the round of the failure too many is made."""
    rows = [(0, 0, 9, 0), (0, 1, 9, 500), (0, 2, 1, 0), (0, 3, 9, 0), (0, 4, 1, 0), (0, 5, 9, 9), (1, 0, 9, 30), (1, 1, 1, 0), (2, 0, 1, 0), (2, 1, 1, 0), (2, 2, 1, 0)]
    df = spark.createDataFrame(rows, "scan_id bigint, round bigint, voters bigint, gained bigint")
    made = planes.rounds_made(df, P.but(tries_on_each_depth=1)).collect()
    # scan 0 fails at round 0 (no points yet) and ends with the failure of round 2
    assert sorted((r.scan_id, r["round"]) for r in made) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)]


def cloud(spark):
    """Two crossing planes and points in between, two scans."""
    wall = "case id % 3 when 0 then 0.7D when 1 then (id*7919 % 1009)/504.5D - 1D else (id*611953 % 997)/498.5D - 1D end"
    floor = "case id % 3 when 1 then -0.5D else (id*104729 % 1013)/506.5D - 1D end"
    return spark.range(1500).selectExpr("id % 2 as scan_id", "id as pid", f"{wall} as x", "(id*15485863 % 991)/495.5D - 1D as y", f"{floor} as z")


def test_tries_in_one_pass_are_the_tries_one_by_one(spark):
    p = P.but(min_sac_distance=0.2, min_points_in_cc=60, sac_iterations=40)
    pts = cloud(spark)
    books = [planes.peel_planes(pts, p, most_tries=n, failures=3) for n in (1, 50)]
    shapes = [sorted(tuple(r) for r in b.structures.select("scan_id", "plane_id", "members", *(F.round(c, 9) for c in ("nx", "ny", "nz", "d"))).collect()) for b in books]
    owned = [sorted(tuple(r) for r in stack(b.assignment).select("scan_id", "pid", "plane_id").collect()) for b in books]
    assert shapes[0] == shapes[1] and owned[0] == owned[1]
    assert len(shapes[0]) >= 4 and len({r[:2] for r in owned[0]}) == len(owned[0])


def test_scans_peeled_in_a_task_are_those_peeled_by_jobs(spark):
    """A scan in one task gives the planes and points of the chain of jobs; it took a chain for each plane before."""
    p = P.but(min_sac_distance=0.2, min_points_in_cc=60, sac_iterations=40)
    pts = cloud(spark)
    odd = spark.createDataFrame([(0, 9001, float("nan"), 0.0, 0.0), (0, 9002, 0.0, None, 0.0), (None, 9003, 0.0, 0.0, 0.0)],
                                "scan_id int, pid bigint, x double, y double, z double")
    pts = pts.select("scan_id", "pid", "x", "y", "z").unionByName(odd.withColumn("scan_id", F.col("scan_id").cast(dict(pts.dtypes)["scan_id"])))
    pts = pts.unionByName(pts.filter("pid % 50 = 7"))  # rows that come twice
    books = [planes.peel_planes(pts, p, failures=3, in_task=n) for n in (0, 10**6)]
    shapes = [sorted(tuple(r) for r in b.structures.select("scan_id", "plane_id", "members", *(F.round(c, 9) for c in ("nx", "ny", "nz", "d", "area"))).collect()) for b in books]
    owned = [sorted(tuple(r) for r in stack(b.assignment).select("scan_id", "pid", "plane_id").collect()) for b in books]
    cells = [sorted(tuple(r) for r in b.cells.collect()) for b in books]
    assert shapes[0] == shapes[1] and owned[0] == owned[1] and cells[0] == cells[1] and len(shapes[0]) >= 4
