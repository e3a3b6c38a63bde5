"""Output tables: label images, coloured clouds, geometry rows, chunks, plane records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour
from ..functions.geometry import cylinder_box_vertices, frame_columns, frame_from, quaternion
from ..functions.vec import v
from ..operators import fit
from ..operators.assign import dense_labels
from ..operators.raster import to_byte
from ..session import stage

CHUNK = 100


def label_image(pixels: DataFrame, assignment: DataFrame, structures: DataFrame, id_col: str = "structure_id") -> DataFrame:
    """Pixels (image_id, r, c, pid or null) with label 10.. of their structure, 0 elsewhere."""
    labels = dense_labels(structures.select("scan_id", id_col), [id_col])
    a = assignment.join(labels, ["scan_id", id_col]).select(F.col("scan_id").alias("image_id"), "pid", "label")
    d = pixels.join(a, ["image_id", "pid"], "left")
    return d.select("image_id", "r", "c", F.coalesce("label", F.lit(0)).cast("bigint").alias("label"))


def normals_table(structures: DataFrame, id_col: str = "plane_id") -> DataFrame:
    """Region label and normal of each plane, with the number of planes of its scan."""
    count = structures.groupBy("scan_id").agg(F.count("*").alias("planes"))
    return dense_labels(structures, [id_col]).join(count, "scan_id").selectExpr(
        "scan_id as image_id", "planes", "label as region", "nx", "ny", "nz")


def segmented_cloud(points: DataFrame, assignment: DataFrame, structures: DataFrame, id_col: str = "structure_id") -> DataFrame:
    """All points; unsegmented ones black, the others in the colour of their structure index."""
    ranked = dense_labels(structures.select("scan_id", id_col), [id_col], 0)
    total = ranked.groupBy("scan_id").agg(F.count("*").alias("_total"))
    c = ranked.join(total, "scan_id")
    c = c.withColumns(colour.index_colour(F.col("label"), F.col("_total")))
    c = c.select("scan_id", id_col, colour.rgb_from_unit(F.col("red"), F.col("green"), F.col("blue")).cast("bigint").alias("_rgb"))
    a = assignment.join(c, ["scan_id", id_col]).select("scan_id", "pid", "_rgb")
    d = points.drop("rgb").join(a, ["scan_id", "pid"], "left")
    return d.withColumn("rgb", F.coalesce("_rgb", F.lit(0)).cast("bigint")).drop("_rgb")


def structure_cloud(points: DataFrame, assignment: DataFrame, structures: DataFrame, id_col: str = "structure_id") -> DataFrame:
    """Only the points of structures, coloured."""
    inside = points.join(assignment.select("scan_id", "pid"), ["scan_id", "pid"], "left_semi")
    return segmented_cloud(inside, assignment, structures, id_col)


def unsegmented(points: DataFrame, assignment: DataFrame) -> DataFrame:
    return points.join(assignment.select("scan_id", "pid"), ["scan_id", "pid"], "left_anti")


def numbered(points: DataFrame) -> DataFrame:
    """Consecutive number ``num`` per scan in pid order, whatever the ids are, without ordering a scan in one task.

    Points are dealt by ranges of (scan, pid) and stored in that order; a range counts its own points, and one count for
    each range and scan is brought together.  Equal ids in a scan are numbered in any order.
    """
    dealt = points.repartitionByRange("scan_id", "pid").sortWithinPartitions("scan_id", "pid")
    dealt = stage(dealt.withColumn("_m", F.monotonically_increasing_id()))
    # the id holds the number of the range and the place in it
    d = dealt.withColumns({"_g": F.expr("shiftright(_m, 33)"), "_k": F.expr("_m & 8589934591L")})
    w = Window.partitionBy("scan_id").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    ranges = d.groupBy("scan_id", "_g").agg(F.count("*").alias("_c"), F.min("_k").alias("_first"))
    ranges = ranges.withColumn("_o", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    return d.join(ranges, ["scan_id", "_g"]).withColumn("num", F.expr("_o + _k - _first")).drop("_g", "_o", "_k", "_first", "_m")


def chunks(points: DataFrame, size: int = CHUNK) -> DataFrame:
    """Points packed into arrays of at most ``size``."""
    d = numbered(points).withColumn("chunk", F.expr(f"num div {size}"))
    cols = [c for c in d.columns if c not in ("scan_id", "chunk", "num")]
    item = F.sort_array(F.collect_list(F.struct("num", *cols)))
    return d.groupBy("scan_id", "chunk").agg(item.alias("points"), F.count("*").alias("size"))


def plane_outlines(planes: DataFrame) -> DataFrame:
    """Two triangles per rectangle (six corners) and the normal line from the centroid."""
    d = fit.with_outline(planes)
    order = (0, 1, 2, 2, 3, 0)
    corners = F.array(*(F.col("rectangle")[i] for i in order))
    return d.select("scan_id", "plane_id", "area", F.posexplode(corners).alias("corner", "_p"), "cgx", "cgy", "cgz",
                    *((F.col("cg" + a) + 0.1 * F.col("n" + a)).alias("tip_" + a) for a in "xyz")).select(
        "scan_id", "plane_id", "area", F.col("corner").cast("bigint").alias("corner"), "_p.x", "_p.y", "_p.z", "cgx", "cgy", "cgz",
        "tip_x", "tip_y", "tip_z")


def cylinder_poses(cylinders: DataFrame) -> DataFrame:
    """Diameter, height, orientation quaternion, middle point and box corners."""
    d = cylinders.withColumns(frame_columns(v("a")))
    d = d.withColumns(quaternion(frame_from()))
    mid = (F.col("axis_min") + F.col("axis_max")) * 0.5
    box = cylinder_box_vertices(v("p"), frame_from(), F.col("radius"), F.col("axis_min"), F.col("axis_max"))
    return d.select("scan_id", "cylinder_id", (2 * F.col("radius")).alias("diameter"),
                    F.abs(F.col("axis_max") - F.col("axis_min")).alias("height"), "qx", "qy", "qz", "qw",
                    *((F.col("p" + a) + mid * F.col("a" + a)).alias("mid_" + a) for a in "xyz"), box.alias("box"))


def plane_records(planes: DataFrame, size: DataFrame, colours: DataFrame, heights: DataFrame) -> DataFrame:
    """One record per plane and raster row: normal, distance, rectangle, and the row's texels.

    A record carries one raster row, so its arrays are bounded by the raster width.
    """
    key = ["scan_id", "plane_id"]
    d = heights.join(colours, [*key, "tx", "ty"], "full").join(size.select(*key, "width", "height"), key)
    d = d.filter("tx < width and ty < height")
    eight = lambda c: to_byte(F.coalesce(F.col(c), F.lit(0.0)))
    item = F.struct("tx", eight("h").alias("h"), *(eight(c).alias(c) for c in ("red", "green", "blue")),
                    (F.coalesce("alpha", F.lit(0.0)) > 0.5).alias("alpha"))
    rows = d.groupBy(*key, "ty").agg(F.sort_array(F.collect_list(item)).alias("texels"))
    head = fit.with_outline(planes).select(*key, "nx", "ny", "nz", "d", "thr", "rectangle")
    return head.join(size.select(*key, "texel", "width", "height", "width_ratio", "height_ratio"), key).join(rows, key)


def named_cloud(points: DataFrame, name: str, rgb: int) -> DataFrame:
    """A point list with one colour and a name."""
    return points.withColumn("rgb", F.lit(rgb).cast("bigint")).withColumn("name", F.lit(name))
