"""Whole extraction on the scene with known geometry, scored with the evaluation operators."""

from facetry.catalog.quality_queries import EXTRACT
from facetry.catalog.views import load
from facetry.operators import evaluate, octree
from facetry.plans import cylinders, pipeline
from facetry.sinks import tables


def test_planes_are_found_and_scored(spark):
    pts = load(spark, "/root/testdata/sf0.01", "scene_points")
    seg = pipeline.segment(pts, EXTRACT)
    px = pts.selectExpr("scan_id as image_id", "pid div 512 as r", "pid % 512 as c", "pid", "surf")
    ms = tables.label_image(px, seg.assignment, seg.structures.withColumnRenamed("plane_id", "structure_id"))
    gt = px.selectExpr("image_id", "r", "c", "if(surf < 3, bigint(surf) + 10, 0L) as label")
    g, _ = evaluate.classify(evaluate.overlap_table(evaluate.join_labels(gt, ms)), 0.8)
    assert [r["class"] for r in g.collect()] == ["correct"] * 6
    assert seg.assignment.groupBy("scan_id", "pid").count().filter("count > 1").count() == 0


def cylinder_cloud(spark):
    return spark.range(3000).selectExpr(
        "0L as scan_id", "id as pid", "0.5D + 0.3D*cos(id*3.883222D) as x", "0.2D + 0.3D*sin(id*3.883222D) as y",
        "(id % 500)/250D - 1D as z")


CYL = EXTRACT.but(min_octree_resolution=0.125, rho_max=4.0, only_depth=0, min_points_in_cc=100, min_sac_distance=0.02,
                  min_points_for_normal=8, occupied_ratio=0.1, plane_hypotheses=50, cylinder_hypotheses=50, sac_iterations=50,
                  tries_on_each_depth=2)


def test_cylinder_fit_with_octree_normals(spark):
    pts = cylinder_cloud(spark)
    keyed = octree.with_keys(pts, CYL)
    nodes = octree.surfels(octree.roll_up(octree.leaf_moments(keyed), CYL.layers()), CYL)
    best, inliers = cylinders.octree_fit(pts, keyed, nodes, CYL, CYL.depth)
    got = best.first()
    assert abs(got.radius - 0.3) < 0.05 and abs(got.az) > 0.95 and inliers.count() > 1000


def test_cylinder_peeling(spark):
    seg = pipeline.segment(cylinder_cloud(spark), CYL.but(consensus_only=True, cylinders=True))
    got = seg.structures.orderBy("cylinder_id").first()
    assert abs(got.radius - 0.3) < 0.05 and got.members > 1000
    assert seg.assignment.groupBy("scan_id", "pid").count().filter("count > 1").count() == 0


def test_clouds_of_structures(spark):
    pts = cylinder_cloud(spark)
    owned = pts.filter("pid < 10").selectExpr("scan_id", "pid", "1 as structure_id")
    ids = owned.select("scan_id", "structure_id").distinct()
    assert tables.structure_cloud(pts, owned, ids).count() == 10
    assert tables.segmented_cloud(pts, owned, ids).filter("rgb <> 0").count() == 10
    assert tables.named_cloud(pts, "cloud", 255).filter("rgb = 255 and name = 'cloud'").count() == 3000
