"""Claiming nodes for known structures, and pairs across octree depths."""

from pyspark.sql import functions as F

from facetry.catalog.common import LAYER, P, SIZE, TRUE_CYLINDER
from facetry.catalog.views import load
from facetry.operators import octree
from facetry.plans import cylinders, planes
from facetry.plans.book import Book, stack, stage
from facetry.params import SegParams

SF = "/root/testdata/sf0.01"


def test_plane_grows_over_connected_nodes(spark):
    pts = load(spark, SF, "scene_points").filter("scan_id = 0")
    keyed = stage(octree.with_keys(pts.select("scan_id", "pid", "x", "y", "z"), P))
    nodes = octree.surfels(octree.node_moments(keyed, [LAYER]), P).filter("stable").select(*planes.NODE_COLS)
    half = pts.filter("surf = 1 and y < 0").selectExpr("scan_id", "1L as plane_id", "pid", "x", "y", "z")
    one = spark.createDataFrame([(0, 1, 1.0, 0.0, 0.0, 1.6, 0.05)],
                                "scan_id bigint, plane_id bigint, nx double, ny double, nz double, d double, thr double")
    book = Book()
    table, cells = planes.describe(one, half, 2 * SIZE)  # a grid one layer coarser than the nodes
    book.add_structures(table.withColumn("layer", F.lit(LAYER - 1)), cells)
    book.assignment.append(stage(half.select("scan_id", "pid", "plane_id")))
    before = book.structures.first()
    claimed = planes.claim_nodes(book, nodes, keyed, P, LAYER)
    assert claimed.count() > 40
    after, rows = book.structures.first(), stack(book.assignment)
    assert rows.groupBy("pid").count().filter("count > 1").count() == 0
    assert after.members == rows.count() > 1.7 * before.members
    assert after.cell == SIZE and after.area > 1.7 * before.area and book.cells.count() >= 60
    # fully covered nodes are closed afterwards
    assert book.open_nodes(nodes).count() < nodes.count()


def test_cylinder_grows_along_its_axis(spark):
    pts = load(spark, SF, "scene_points").filter("scan_id = 1")
    keyed = stage(octree.with_keys(pts.select("scan_id", "pid", "x", "y", "z"), P))
    nodes = stage(octree.surfels(octree.node_moments(keyed, [LAYER]), P))
    book = Book()
    book.add_structures(spark.range(1).selectExpr("1L as scan_id", *TRUE_CYLINDER, "-1D as axis_min", "0.5D as axis_max",
                                                  "0.05D as thr", "3 as crank", "0L as members"))
    claimed = cylinders.claim_nodes(book, nodes, keyed, P, LAYER)
    c = book.structures.first()
    assert claimed.count() > 10 and 0.5 < c.axis_max <= 1.0 and c.members == stack(book.assignment).count() > 300


def test_pairs_across_depths(spark):
    p = SegParams(min_octree_resolution=0.25, rho_max=4.0, sq_dist_factor=0.2)
    pts = load(spark, SF, "scene_points")
    nodes = octree.build(pts, p, [p.depth]).filter("stable")
    got = octree.neighbour_pairs(nodes, 1, mixed=True)
    rows = nodes.select("scan_id", "depth", "ix", "iy", "iz").collect()
    want = set()
    for a in rows:
        for b in rows:
            if a.scan_id == b.scan_id and a.depth >= b.depth:
                s = a.depth - b.depth
                far = max(abs((u >> s) - w) for u, w in zip((a.ix, a.iy, a.iz), (b.ix, b.iy, b.iz)))
                if far <= 1 and (s > 0 or tuple(a) < tuple(b)):
                    want.add((tuple(a), tuple(b)))
    have = {((r.scan_id, r.a_depth, r.a_ix, r.a_iy, r.a_iz), (r.scan_id, r.b_depth, r.b_ix, r.b_iy, r.b_iz)) for r in got.collect()}
    assert have == want and any(a[1] != b[1] for a, b in want)
