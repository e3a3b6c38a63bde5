"""Node against structure joins: candidates, first-match claims, coverage, edge splitting.

Planes and cylinders are rasterised into coarse blocks and joined to nodes by block, so
a node meets only the structures that pass through its block; there is no all-pairs join
inside a scan and a large scan spreads over many keys.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import (axis_distance, box_distance, cylinder_normal_ok, frame_columns, frame_from,
                                  height_ok, middle_plane, near_cylinder, near_plane, normals_agree, plane_distance,
                                  signed_distance, to_frame, to_plane)
from ..functions.vec import V, v
from ..params import SegParams
from ..session import is_empty, stage
from .grid import attached, touching

BLOCK = ["bx", "by", "bz"]


def block_size(p: SegParams, cell: float) -> float:
    """Eight cells, but at most 64 blocks along an axis of the volume."""
    return max(8 * cell, 2 * p.rho_max / 64)


def with_block(df: DataFrame, size: float, cols=("mx", "my", "mz")) -> DataFrame:
    return df.withColumns({b: F.floor(F.col(c) / size).cast("bigint") for b, c in zip(BLOCK, cols)})


def plane_blocks(planes: DataFrame, p: SegParams, size: float, slack: str) -> DataFrame:
    """All blocks that contain points within ``slack`` of each plane, inside the volume."""
    reach = math.ceil(p.rho_max / size)
    lo, hi = -reach, reach - 1
    d = planes.selectExpr("*", "case when abs(nz) >= abs(nx) and abs(nz) >= abs(ny) then 2"
                          " when abs(ny) >= abs(nx) then 1 else 0 end as _a")
    d = d.selectExpr("*", *(f"element_at(array(nx, ny, nz), pmod(_a + {k}, 3) + 1) as _n{k}" for k in range(3)))
    d = d.selectExpr("*", f"explode(sequence({lo}, {hi})) as _u").selectExpr("*", f"explode(sequence({lo}, {hi})) as _v")
    d = d.selectExpr("*", f"(d - _n1*(_u + 0.5D)*{size!r}D - _n2*(_v + 0.5D)*{size!r}D)/_n0 as _c",
                     f"((abs(_n1) + abs(_n2))*{size / 2!r}D + {slack})/abs(_n0) as _h")
    d = d.selectExpr("*", f"cast(greatest({lo}D, floor((_c - _h)/{size!r}D)) as int) as _w0",
                     f"cast(least({hi}D, floor((_c + _h)/{size!r}D)) as int) as _w1")
    d = d.filter("_w0 <= _w1").selectExpr("*", "explode(sequence(_w0, _w1)) as _w")
    # component k of the block index sits at position (k - axis) mod 3 of (w, u, v)
    return d.selectExpr(*planes.columns, *(
        f"cast(element_at(array(_w, _u, _v), pmod({k} - _a, 3) + 1) as bigint) as {b}" for k, b in enumerate(BLOCK)))


def near_planes(nodes: DataFrame, planes: DataFrame, p: SegParams, cell: float, angle: float | None = None) -> DataFrame:
    """Node x plane candidates by distance (plane column ``thr``) and, with ``angle``, by normal."""
    size = block_size(p, cell)
    cols = ["scan_id", "plane_id", "nx", "ny", "nz", "d", "thr"]
    rest = [c for c in planes.columns if c not in cols]
    side = plane_blocks(planes.select(*cols, *rest), p, size, "thr")
    side = side.select("scan_id", "plane_id", *BLOCK, *(F.col(c).alias("p_" + c) for c in ("nx", "ny", "nz", "d", "thr")), *rest)
    d = with_block(nodes, size).join(side, ["scan_id", *BLOCK])
    d = d.filter(near_plane(v("m"), v("p_n"), F.col("p_d"), F.col("p_thr")))
    if angle is not None:
        d = d.filter(normals_agree(v("p_n"), v("n"), angle))
    return d.drop(*BLOCK)


def near_cylinders(nodes: DataFrame, cylinders: DataFrame, p: SegParams, cell: float) -> DataFrame:
    """Node x cylinder candidates by surface distance (``thr``), normal and height."""
    size = block_size(p, cell)
    slack = p.cylinder_height_dev
    d = cylinders.selectExpr("*", f"axis_min - {slack!r}D*abs(axis_max - axis_min) as _h0",
                             f"axis_max + {slack!r}D*abs(axis_max - axis_min) as _h1")
    for a, b in zip("xyz", BLOCK):
        low = f"least(p{a} + _h0*a{a}, p{a} + _h1*a{a}) - radius - thr"
        high = f"greatest(p{a} + _h0*a{a}, p{a} + _h1*a{a}) + radius + thr"
        d = d.selectExpr("*", f"explode(sequence(cast(floor(({low})/{size!r}D) as bigint),"
                         f" cast(floor(({high})/{size!r}D) as bigint))) as {b}")
    centre = V(*((F.col(b) + 0.5) * size for b in BLOCK))
    gap = F.abs(axis_distance(centre, v("p"), v("a")) - F.col("radius"))
    d = d.filter(gap <= size * math.sqrt(3) / 2 + F.col("thr"))
    side = d.select("scan_id", "cylinder_id", "crank", *BLOCK, "px", "py", "pz", "ax", "ay", "az", "radius",
                    "axis_min", "axis_max", "thr")
    j = with_block(nodes, size).join(side, ["scan_id", *BLOCK])
    m = v("m")
    j = j.filter(near_cylinder(m, v("p"), v("a"), F.col("radius"), F.col("thr")))
    j = j.filter(cylinder_normal_ok(m, v("n"), v("p"), v("a"), p.angle_eps))
    h = "(mx-px)*ax + (my-py)*ay + (mz-pz)*az"
    return j.filter(height_ok(F.expr(h), F.col("axis_min"), F.col("axis_max"), slack)).drop(*BLOCK)


def first_match(candidates: DataFrame, node_key, rank: str) -> DataFrame:
    """Each node keeps the structure with the lowest rank."""
    w = Window.partitionBy(*node_key).orderBy(rank)
    return candidates.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def claim_waves(candidates: DataFrame, old_cells: DataFrame, node_key, min_nodes: int) -> DataFrame:
    """Claims in rank order: each plane takes the candidates connected to its grid that no earlier plane has taken.

    Planes that share no candidate do not influence each other, so they go together: a wave holds every plane without
    an earlier, still waiting plane that wants one of its nodes.  The result is that of one plane after the other; the
    number of waves is the longest chain of such conflicts.  ``candidates`` have plane_id, rank, cx and cy, one row for
    each node and plane, and are stored; ``old_cells`` are the grids on the candidates' cell size.
    """
    plane = ["scan_id", "plane_id"]
    wanted = candidates.select(*node_key, "plane_id", "rank")
    # an earlier claimant for each later one that shares a node; few planes meet in a node
    earlier = wanted.join(wanted.select(*node_key, F.col("plane_id").alias("first_id"), F.col("rank").alias("first_rank")), list(node_key))
    waits = stage(earlier.filter("first_rank < rank").select(*plane, "first_id").distinct())
    waiting = stage(candidates.select(*plane).distinct())
    won: list[DataFrame] = []
    while not is_empty(waiting):
        blocked = waits.join(waiting.withColumnRenamed("plane_id", "first_id"), ["scan_id", "first_id"], "left_semi")
        ready = stage(waiting.join(blocked.select(*plane).distinct(), plane, "left_anti"))
        rows = candidates.join(ready, plane, "left_semi")
        for taken in won:
            rows = rows.join(taken.select(*node_key), list(node_key), "left_anti")
        won.append(stage(attached(old_cells, rows, plane, min_nodes)))
        waiting = stage(waiting.join(ready, plane, "left_anti"))
    out = won[0] if won else candidates.limit(0)
    for more in won[1:]:
        out = out.unionByName(more)
    return out


def coverage(points: DataFrame, node_key, hit, ratio: float) -> DataFrame:
    """Nodes whose share of points fulfilling ``hit`` is at least ``ratio``."""
    share = points.groupBy(*node_key).agg(F.avg(hit.cast("double")).alias("share"), F.count("*").alias("points"))
    return share.filter(F.col("share") >= ratio)


def box_and_grid(candidates: DataFrame, planes: DataFrame, cells: DataFrame, p: SegParams) -> DataFrame:
    """Spread candidates: near the plane's box and in contact with its grid."""
    cols = [*(f"r{i}{j}" for i in range(3) for j in range(3)), "umin", "umax", "vmin", "vmax", "wmin", "wmax", "area", "cell",
            "u0", "v0"]
    d = candidates.join(planes.select("scan_id", "plane_id", *cols), ["scan_id", "plane_id"])
    q = to_plane(v("m"), v("p_n"), F.col("p_d"), frame_from())
    d = d.withColumns({"u": q[0], "v": q[1], "w": q[2]})
    gap = box_distance(v("u", "v", "w"), v("umin", "vmin", "wmin"), v("umax", "vmax", "wmax"))
    d = d.filter(gap < F.sqrt("area") * p.node_to_box_distance)
    d = d.withColumn("cx", F.floor((F.col("u") - F.col("u0")) / F.col("cell")).cast("bigint")).withColumn(
        "cy", F.floor((F.col("v") - F.col("v0")) / F.col("cell")).cast("bigint"))
    d = touching(d, cells, ["scan_id", "plane_id"], p.connection_neighbors)
    return d.drop(*cols, "u", "v", "w", "cx", "cy")


def nearest_two(candidates: DataFrame, node_key) -> DataFrame:
    """Nearest and second-nearest plane per node, and the number of candidates."""
    dist = plane_distance(v("m"), v("p_n"), F.col("p_d"))
    w = Window.partitionBy(*node_key).orderBy("dist", "plane_id")
    d = candidates.withColumn("dist", dist).withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    return d.groupBy(*node_key).agg(
        F.max(F.when(F.col("_r") == 1, F.col("plane_id"))).alias("first_plane"),
        F.max(F.when(F.col("_r") == 2, F.col("plane_id"))).alias("second_plane"),
        F.max(F.when(F.col("_r") == 1, F.col("dist"))).alias("first_dist"),
        F.max(F.when(F.col("_r") == 2, F.col("dist"))).alias("second_dist"))


def middle_planes(pairs: DataFrame, planes: DataFrame) -> DataFrame:
    """Bisecting plane per (first_plane, second_plane): h*, hd and the side of the first centroid.

    ``same_side`` marks pairs whose centroids lie on one side; parallel pairs count as such.
    """
    cols = ["nx", "ny", "nz", "d", "cgx", "cgy", "cgz"]
    d = pairs.select("scan_id", "first_plane", "second_plane").distinct()
    for tag, key in (("a", "first_plane"), ("b", "second_plane")):
        d = d.join(planes.select("scan_id", F.col("plane_id").alias(key), *(F.col(c).alias(f"{tag}_{c}") for c in cols)),
                   ["scan_id", key])
    m, offset = middle_plane(v("a_n"), v("a_cg"), F.col("a_d"), v("b_n"), v("b_cg"), F.col("b_d"))
    d = d.withColumns({"_h" + a: c for a, c in zip("xyz", m)} | {"_hd": offset})
    d = d.selectExpr("*", "if(_hd < 0, -_hx, _hx) as hx", "if(_hd < 0, -_hy, _hy) as hy", "if(_hd < 0, -_hz, _hz) as hz",
                     "abs(_hd) as hd")
    d = d.withColumns({"sa": signed_distance(v("a_cg"), v("h"), F.col("hd")),
                       "sb": signed_distance(v("b_cg"), v("h"), F.col("hd"))})
    return d.selectExpr("scan_id", "first_plane", "second_plane", "hx", "hy", "hz", "hd",
                        "coalesce(sa*sb > 0, true) as same_side", "sa")


def split_points(points: DataFrame, middles: DataFrame) -> DataFrame:
    """Points of contested nodes (first_plane, second_plane) -> plane_id by the side they lie on."""
    d = points.join(middles, ["scan_id", "first_plane", "second_plane"])
    d = d.withColumn("_s", signed_distance(v("x", "y", "z"), v("h"), F.col("hd")))
    own = F.expr("same_side or (sa < 0 and _s < 0) or (sa >= 0 and _s > 0)")
    return d.withColumn("plane_id", F.when(own, F.col("first_plane")).otherwise(F.col("second_plane"))).drop(
        "_s", "hx", "hy", "hz", "hd", "same_side", "sa")


def merge_candidates(planes: DataFrame, p: SegParams) -> DataFrame:
    """Ordered plane pairs (lower rank first) with similar normals and mutually close centroids."""
    size = 2 * p.rho_max / 64
    f = p.merge_similarity_factor
    cols = ["nx", "ny", "nz", "d", "cgx", "cgy", "cgz", "thr", "rank"]
    # a pair's limit is the larger threshold of the two, so blocks use the scan's largest
    top = planes.groupBy("scan_id").agg(F.max("thr").alias("_top"))
    a = plane_blocks(planes.select("scan_id", "plane_id", *cols).join(top, "scan_id"), p, size, f"_top*{f!r}D")
    a = a.select("scan_id", *BLOCK, F.col("plane_id").alias("a_id"), *(F.col(c).alias("a_" + c) for c in cols))
    b = with_block(planes, size, ("cgx", "cgy", "cgz")).select(
        "scan_id", *BLOCK, F.col("plane_id").alias("b_id"), *(F.col(c).alias("b_" + c) for c in cols))
    d = a.join(b, ["scan_id", *BLOCK]).filter("a_rank < b_rank")
    limit = F.greatest("a_thr", "b_thr") * f
    d = d.filter(normals_agree(v("a_n"), v("b_n"), f * p.angle_eps))
    d = d.filter(near_plane(v("b_cg"), v("a_n"), F.col("a_d"), limit) & near_plane(v("a_cg"), v("b_n"), F.col("b_d"), limit))
    return d.select("scan_id", "a_id", "b_id", "a_rank", "b_rank", F.greatest("a_thr", "b_thr").alias("thr"))


def grid_contacts(pairs: DataFrame, members: DataFrame, planes: DataFrame, cells: DataFrame, reach: int) -> DataFrame:
    """Pairs (a_id, b_id) where some member point of b sees a populated cell of a's grid."""
    cols = ["nx", "ny", "nz", "d", *(f"r{i}{j}" for i in range(3) for j in range(3)), "u0", "v0", "cell"]
    side = planes.select("scan_id", F.col("plane_id").alias("a_id"), *cols)
    pts = members.select("scan_id", F.col("plane_id").alias("b_id"), "x", "y", "z")
    d = pairs.select("scan_id", "a_id", "b_id").join(side, ["scan_id", "a_id"]).join(pts, ["scan_id", "b_id"])
    q = to_plane(v("x", "y", "z"), v("n"), F.col("d"), frame_from())
    d = d.select("scan_id", "a_id", "b_id", F.floor((q[0] - F.col("u0")) / F.col("cell")).cast("bigint").alias("cx"),
                 F.floor((q[1] - F.col("v0")) / F.col("cell")).cast("bigint").alias("cy")).distinct()
    near = cells.select("scan_id", F.col("plane_id").alias("a_id"), "cx", "cy")
    return touching(d, near, ["scan_id", "a_id"], reach).select("scan_id", "a_id", "b_id").distinct()


def cylinder_cells(points: DataFrame, cylinders: DataFrame, size: float) -> DataFrame:
    """Unrolled cells of member points: (scan_id, cylinder_id, cx, cy)."""
    side = cylinders.select("scan_id", "cylinder_id", "px", "py", "pz", "ax", "ay", "az", "radius", "axis_min")
    side = side.withColumns(frame_columns(v("a")))
    d = points.join(side, ["scan_id", "cylinder_id"])
    q = to_frame(v("x", "y", "z"), v("p"), frame_from())
    d = d.select("scan_id", "cylinder_id", "radius", "axis_min", *(c.alias("q" + a) for a, c in zip("xyz", q)))
    return d.selectExpr("scan_id", "cylinder_id",
                        f"cast(floor(if(atan2(qy, qx) < 0, atan2(qy, qx) + 2*pi(), atan2(qy, qx))*radius/{size!r}D) as bigint) as cx",
                        f"cast(floor((qz - axis_min)/{size!r}D) as bigint) as cy")


def occupancy(points: DataFrame, cylinders: DataFrame, size: float) -> DataFrame:
    """Occupied share of the unrolled cylinder surface."""
    hit = cylinder_cells(points, cylinders, size).distinct().groupBy("scan_id", "cylinder_id").agg(
        F.count("*").alias("occupied"))
    whole = cylinders.selectExpr("scan_id", "cylinder_id",
                                 f"(cast(floor(radius*2*pi()/{size!r}D) as bigint) + 1)"
                                 f"*(cast(floor(abs(axis_max - axis_min)/{size!r}D) as bigint) + 1) as total")
    return whole.join(hit, ["scan_id", "cylinder_id"]).withColumn("ratio", F.col("occupied") / F.col("total"))
