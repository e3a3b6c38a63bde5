"""Filters, colours, camera models and geometry columns."""

from pyspark.sql import functions as F

from ..functions import colour
from ..functions import geometry as G
from ..functions.vec import V, v
from ..operators import assign, claims, clean, fit
from ..sources import camera
from .common import P, TRUE_CYLINDER, TRUE_PLANES, r, rounded, rs
from .registry import part, query
from .views import load

GOOD = "not isnan(x) and not isinf(x) and not isnan(y) and not isinf(y) and not isnan(z) and not isinf(z)"


@query("clean_points", f"select scan_id, pid, {rs('x y z', 6)} from raw_points where {GOOD} and z < 20e0 and z > -20e0")
def clean_points(spark, sf):
    kept, _ = clean.split_valid(load(spark, sf, "raw_points"), 20.0, -20.0)
    return rounded(kept.select("scan_id", "pid", "x", "y", "z"), "xyz", 6)


@query("reject_counts", f"""select scan_id, case when {GOOD} then 'range' else 'undefined' end as reason, count(*) as points
  from raw_points where not ({GOOD} and z < 20e0 and z > -20e0) group by all""")
def reject_counts(spark, sf):
    _, lost = clean.split_valid(load(spark, sf, "raw_points"), 20.0, -20.0)
    return lost.groupBy("scan_id", "reason").agg(F.count("*").alias("points"))


@query("pass_through", f"select scan_id, pid from raw_points where {GOOD} and z between -0.5e0 and 0.5e0")
def pass_through(spark, sf):
    return clean.pass_through(load(spark, sf, "raw_points"), "z", -0.5, 0.5).select("scan_id", "pid")


@query("axis_permute", "select scan_id, pid, round(z, 6)+0.0e0 as x, round(-x, 6)+0.0e0 as y, round(-y, 6)+0.0e0 as z from scene_points")
def axis_permute(spark, sf):
    return rounded(clean.to_robot_axes(load(spark, sf, "scene_points")).select("scan_id", "pid", "x", "y", "z"), "xyz", 6)


@query("unpack_rgb", """select scan_id, pid, (rgb >> 16) & 255 as red, (rgb >> 8) & 255 as green, rgb & 255 as blue, rgb as packed
  from colored_points""")
def unpack_rgb(spark, sf):
    d = load(spark, sf, "colored_points")
    d = d.withColumns({"red": colour.red(F.col("rgb")), "green": colour.green(F.col("rgb")), "blue": colour.blue(F.col("rgb"))})
    return d.select("scan_id", "pid", "red", "green", "blue", colour.pack(F.col("red"), F.col("green"), F.col("blue")).alias("packed"))


part("wheel", """select scan_id, surf, members, 1e0 - cast(rk as double)/cast(total as double) as t from (
  select scan_id, surf, count(*) as members, row_number() over (partition by scan_id order by surf) - 1 as rk,
    count(*) over (partition by scan_id) as total from scene_points group by scan_id, surf) q""")


@query("color_by_index", """select scan_id, surf, members,
  round(case when t = 1e0 then 1e0 when t >= 0.83333e0 then 1e0 when t >= 0.66666e0 then (t-0.66666e0)/0.16666e0
    when t >= 0.33333e0 then 0e0 when t >= 0.16666e0 then (t-0.16666e0)/0.16666e0 else 1e0 end, 6)+0.0e0 as red,
  round(case when t = 1e0 then 0e0 when t >= 0.83333e0 then 1e0-(t-0.83333e0)/0.16666e0 when t >= 0.5e0 then 1e0
    when t >= 0.33333e0 then 1e0-(t-0.33333e0)/0.16666e0 else 0e0 end, 6)+0.0e0 as green,
  round(case when t >= 0.66666e0 then 0e0 when t >= 0.5e0 then 1e0-(t-0.5e0)/0.16666e0 when t >= 0.16666e0 then 1e0
    else 1e0-t/0.16666e0 end, 6)+0.0e0 as blue from wheel""")
def color_by_index(spark, sf):
    d = load(spark, sf, "scene_points").groupBy("scan_id", "surf").agg(F.count("*").alias("members"))
    d = assign.dense_labels(d, ["surf"], 0)
    total = d.groupBy("scan_id").agg(F.count("*").alias("total"))
    d = d.join(total, "scan_id")
    d = d.withColumns(colour.index_colour(F.col("label"), F.col("total")))
    return rounded(d.select("scan_id", "surf", "members", "red", "green", "blue"), ["red", "green", "blue"], 6)


# camera models
part("cam_a", """select image_id, r, c, v, (c-255)*(v/0.791686e0+771.016866e0)/1586.072821e0 as px,
  (255-r)/1.4508e0*(v/0.791686e0+771.016866e0)/1586.072821e0 as py, (255-v)/0.791686e0 as pz from range_image where v <> 0
  and image_id <> 0 union all
  select image_id, r, c, v, (c-255)*(v/0.773545e0+785.410786e0)/1610.981722e0 as px,
  (255-r)/1.4508e0*(v/0.773545e0+785.410786e0)/1610.981722e0 as py, (255-v)/0.773545e0 as pz from range_image where v <> 0
  and image_id = 0""")
METRES = "round(-(pz/100e0-4e0), 6)+0.0e0 as x, round(-px/100e0, 6)+0.0e0 as y, round(py/100e0, 6)+0.0e0 as z"
IN_RANGE = "-(pz/100e0-4e0) < 10e0 and -px/100e0 < 10e0 and py/100e0 < 10e0"


@query("range_to_xyz_a", f"select image_id, r, c, {METRES} from cam_a where {IN_RANGE}")
def range_to_xyz_a(spark, sf):
    pix = load(spark, sf, "range_image")
    named = camera.with_calibration(pix.withColumn("path", F.expr("concat('abw.test.', image_id, '.range')")))
    pts, _ = camera.to_metres(camera.structured_light(named))
    return rounded(pts.select("image_id", "r", "c", "x", "y", "z"), "xyz", 6)


part("cam_b0", """select *, radians(51.65e0*(255.5e0-c)/512e0) as al, radians(36.73e0*(255.5e0-r)/512e0) as be from range_image""")
part("cam_b1", "select *, -(3e0*(1e0-cos(al))/tan(radians(45e0))) as dz from cam_b0")
part("cam_b2", "select *, dz*tan(radians(45e0)+0.5e0*be) as dy from cam_b1")
part("cam_b3", "select *, (5.5e0+dy)*tan(al) as dx from cam_b2")
part("cam_b4", """select *, (v+830.3e0-((dz-5.5e0)/0.20236e0+sqrt(dx*dx+(5.5e0+dy)*(5.5e0+dy))/0.20236e0))*0.20236e0 as r3 from cam_b3""")
part("cam_b", "select image_id, r, c, dx+r3*sin(al) as px, dy+r3*cos(al)*sin(be) as py, dz+r3*cos(al)*cos(be) as pz from cam_b4")


@query("range_to_xyz_b", f"select image_id, r, c, {METRES} from cam_b where {IN_RANGE}")
def range_to_xyz_b(spark, sf):
    pts, _ = camera.to_metres(camera.scanning_mirror(load(spark, sf, "range_image")))
    return rounded(pts.select("image_id", "r", "c", "x", "y", "z"), "xyz", 6)


part("cam_c", """select image_id, r, c, tx, ty, v/sqrt(1e0+ty*ty+tx*tx) as pz from (select *, tan(radians(-30e0+(r+0.5e0)*60e0/512e0)) as tx,
  tan(radians(-30e0+(c+0.5e0)*60e0/512e0)) as ty from range_image where v <> 0) t""")


@query("range_to_xyz_pinhole", "select image_id, r, c, round(pz*tx,5)+0.0e0 as px, round(pz*ty,5)+0.0e0 as py, round(pz,5)+0.0e0 as pz from cam_c")
def range_to_xyz_pinhole(spark, sf):
    d = camera.pinhole(load(spark, sf, "range_image")).filter("pz is not null")
    return rounded(d.select("image_id", "r", "c", "px", "py", "pz"), ["px", "py", "pz"], 5)


# planes
part("plane_pairs", "select p.*, t.plane_id, t.nx, t.ny, t.nz, t.d, t.nx*p.x+t.ny*p.y+t.nz*p.z-t.d as s from scene_points p cross join true_planes t")


@query("plane_distance", """select scan_id, plane_id, count(*) as points, round(min(s),6)+0.0e0 as lowest, round(max(s),6)+0.0e0 as highest,
  cast(sum(cast(abs(s) <= 0.05e0 as int)) as bigint) as near_points,
  cast(sum(cast(abs(0.6e0*nx+0.8e0*nz) > cos(0.8e0) as int)) as bigint) as agreeing,
  round(sum(x-nx*s+y-ny*s+z-nz*s),3)+0.0e0 as projected from plane_pairs group by scan_id, plane_id""")
def plane_distance(spark, sf):
    d = load(spark, sf, "scene_points").selectExpr("scan_id", "x", "y", "z", TRUE_PLANES)
    p, n, dist = v("x", "y", "z"), v("n"), F.col("d")
    d = d.withColumns({"s": G.signed_distance(p, n, dist), "near": G.near_plane(p, n, dist, 0.05),
                       "agree": G.normals_agree(n, (F.lit(0.6), F.lit(0.0), F.lit(0.8)), 0.8)})
    q = G.project_on_plane(p, n, dist)
    return d.groupBy("scan_id", "plane_id").agg(
        F.count("*").alias("points"), r(F.min("s"), 6).alias("lowest"), r(F.max("s"), 6).alias("highest"),
        F.sum(F.col("near").cast("bigint")).alias("near_points"), F.sum(F.col("agree").cast("bigint")).alias("agreeing"),
        r(F.sum(q[0] + q[1] + q[2]), 3).alias("projected"))


# plane coordinates written out for the three fixed planes: -z (half turn), x and y
@query("plane_frame_roundtrip", """select scan_id, plane_id, pid,
  round(case plane_id when 0 then -x when 1 then -z else x end, 6)+0.0e0 as u,
  round(case plane_id when 0 then y when 1 then y else -z end, 6)+0.0e0 as v,
  round(case plane_id when 0 then -z-0.9e0 when 1 then x-1.6e0 else y-1.6e0 end, 6)+0.0e0 as w, true as closed from plane_points""")
def plane_frame_roundtrip(spark, sf):
    pts, planes = load(spark, sf, "plane_points"), fit.with_frames(load(spark, sf, "true_planes"))
    d = fit.in_plane(pts, planes, ["plane_id"]).join(planes, "plane_id")
    back = G.from_plane(v("u", "v", "w"), v("n"), F.col("d"), G.frame_from())
    err = F.greatest(*(F.abs(b - F.col(a)) for a, b in zip("xyz", back)))
    return rounded(d.select("scan_id", "plane_id", "pid", "u", "v", "w", (err < 1e-12).alias("closed")), "uvw", 6)


part("directions", "select vec_id, cast(embedding[1] as double) as ax, cast(embedding[2] as double) as ay, cast(embedding[3] as double) as az, "
     "cast(embedding[4] as double) as bx, cast(embedding[5] as double) as bjy, cast(embedding[6] as double) as bz from embeddings")
part("rotations", """select *, ay*bz-az*bjy as cx, az*bx-ax*bz as cy, ax*bjy-ay*bx as cz,
  (ax*bx+ay*bjy+az*bz)/sqrt((ax*ax+ay*ay+az*az)*(bx*bx+bjy*bjy+bz*bz)) as co from directions""")


def directions(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.selectExpr("vec_id", *(f"double(embedding[{i}]) as {n}" for i, n in enumerate(("ax", "ay", "az", "bx", "by", "bz"))))


@query("rotation_between", """select vec_id, round(cx/sqrt(cx*cx+cy*cy+cz*cz),6)+0.0e0 as axis_x, round(cy/sqrt(cx*cx+cy*cy+cz*cz),6)+0.0e0 as axis_y,
  round(cz/sqrt(cx*cx+cy*cy+cz*cz),6)+0.0e0 as axis_z,
  round(case when co < 0e0 then 3.141592653589793e0-2e0*asin(least(1e0,0.5e0*sqrt((ax+bx)*(ax+bx)+(ay+bjy)*(ay+bjy)+(az+bz)*(az+bz))))
    else 2e0*asin(least(1e0,0.5e0*sqrt((ax-bx)*(ax-bx)+(ay-bjy)*(ay-bjy)+(az-bz)*(az-bz)))) end,6)+0.0e0 as angle from rotations""")
def rotation_between(spark, sf):
    d = G.with_rotation(directions(spark, sf), v("a"), v("b"), "axis_", "angle")
    return rounded(d.select("vec_id", "axis_x", "axis_y", "axis_z", "angle"), ["axis_x", "axis_y", "axis_z", "angle"], 6)


@query("vector_angles", """select vec_id, round(degrees(acos(abs(co))),4)+0.0e0 as deg, round(-1e0*sign(ax*bx+ay*bjy+az*bz)*ax,6)+0.0e0 as flipped_x,
  round(acos(cos(ax)*sin(ay)*cos(bx)*sin(bjy)+sin(ax)*sin(ay)*sin(bx)*sin(bjy)+cos(ay)*cos(bjy)),4)+0.0e0 as polar from rotations""")
def vector_angles(spark, sf):
    d = directions(spark, sf)
    a, b = v("a"), v("b")
    return d.select("vec_id", r(G.angle_between_deg(a, b)).alias("deg"), r(G.toward_viewpoint(a, b)[0], 6).alias("flipped_x"),
                    r(G.polar_angle(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).alias("polar"))


# cylinders
part("cyl_points", """select p.*, sqrt((x-0.3e0)*(x-0.3e0)+(y+0.2e0)*(y+0.2e0)) as rho from scene_points p""")


@query("cylinder_distance", """select scan_id, pid, round(rho,6)+0.0e0 as axis_dist, round(rho-0.3e0,6)+0.0e0 as surface_dist,
  abs(rho-0.3e0) < 0.05e0 as near, round(0.3e0+(x-0.3e0)*0.3e0/rho,6)+0.0e0 as sx, round(-0.2e0+(y+0.2e0)*0.3e0/rho,6)+0.0e0 as sy,
  abs((x-0.3e0)/rho) >= cos(0.5e0) as normal_ok, z < 1.0e0+0.2e0*2e0 and z > -1.0e0-0.2e0*2e0 as height_fits from cyl_points""")
def cylinder_distance(spark, sf):
    d = load(spark, sf, "scene_points").selectExpr("*", *TRUE_CYLINDER).withColumns(G.frame_columns(v("a")))
    p, on, axis, rad = v("x", "y", "z"), v("p"), v("a"), F.col("radius")
    d = d.withColumns({"q" + a: c for a, c in zip("xyz", G.to_frame(p, on, G.frame_from()))})
    s = G.from_frame(G.project_on_cylinder(v("q"), rad), on, G.frame_from())
    m = V(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    return d.select("scan_id", "pid", r(G.axis_distance(p, on, axis), 6).alias("axis_dist"),
                    r(G.surface_distance(p, on, axis, rad), 6).alias("surface_dist"),
                    G.near_cylinder(p, on, axis, rad, 0.05).alias("near"), r(s[0], 6).alias("sx"), r(s[1], 6).alias("sy"),
                    G.cylinder_normal_ok(p, m, on, axis, 0.5).alias("normal_ok"),
                    G.height_ok(F.col("qz"), F.lit(-1.0), F.lit(1.0), 0.2).alias("height_fits"))


# both normal lines as equations q.x = c, solved by Cramer's rule around the second point
part("circle_lines", """select vec_id, az as pax, bjy as pay, bx as pbx, bz as pby, ax/sqrt(ax*ax+ay*ay) as nax, ay/sqrt(ax*ax+ay*ay) as nay,
  bz/sqrt(bz*bz+az*az) as nbx, az/sqrt(bz*bz+az*az) as nby from directions""")
part("circle_meets", """select *, nbx*c/nullif(det,0e0)+pbx as cx, nby*c/nullif(det,0e0)+pby as cy from (
  select *, nay*(pax-pbx)-nax*(pay-pby) as c, nbx*nay-nby*nax as det from circle_lines) t""")


@query("circle_from_pairs", """select vec_id, round(cx,4)+0.0e0 as cx, round(cy,4)+0.0e0 as cy, round((ra+rb)*0.5e0,4)+0.0e0 as radius,
  coalesce(greatest(ra,rb)-least(ra,rb) < 0.6e0, false) as stable from (select *, sqrt(pow(cx-pax,2)+pow(cy-pay,2)) as ra, sqrt(pow(cx-pbx,2)+pow(cy-pby,2)) as rb from circle_meets) t""")
def circle_from_pairs(spark, sf):
    d = directions(spark, sf).selectExpr(
        "vec_id", "az as pax", "by as pay", "bx as pbx", "bz as pby", "ax/sqrt(ax*ax+ay*ay) as nax", "ay/sqrt(ax*ax+ay*ay) as nay",
        "bz/sqrt(bz*bz+az*az) as nbx", "az/sqrt(bz*bz+az*az) as nby")
    pair = lambda k: (F.col(k + "x"), F.col(k + "y"))
    d = d.withColumns(G.circle_from_pair(pair("pa"), pair("na"), pair("pb"), pair("nb"), 0.3))
    return rounded(d.select("vec_id", "cx", "cy", "radius", "stable"), ["cx", "cy", "radius"])


@query("box_distance", """select scan_id, pid, round(sqrt(pow(greatest(-1e0-x,x-1e0,0e0),2)+pow(greatest(-1e0-y,y-1e0,0e0),2)
  +pow(greatest(-0.5e0-z,z-0.5e0,0e0),2)),6)+0.0e0 as gap from scene_points""")
def box_distance(spark, sf):
    lo, hi = [F.lit(c) for c in (-1.0, -1.0, -0.5)], [F.lit(c) for c in (1.0, 1.0, 0.5)]
    return load(spark, sf, "scene_points").select("scan_id", "pid", r(G.box_distance(v("x", "y", "z"), lo, hi), 6).alias("gap"))


@query("cylinder_occupancy", f"""select scan_id, cast(occupied as bigint) as occupied, cast(total as bigint) as total,
  round(occupied/total,6)+0.0e0 as ratio, occupied/total > 0.2e0 as accepted from (
  select scan_id, count(distinct (cast(floor(case when atan2(y+0.2e0,x-0.3e0) < 0e0 then atan2(y+0.2e0,x-0.3e0)+6.283185307179586e0
      else atan2(y+0.2e0,x-0.3e0) end*0.3e0/0.05e0) as bigint), cast(floor((z-zmin)/0.05e0) as bigint))) as occupied,
    max((cast(floor(0.3e0*6.283185307179586e0/0.05e0) as bigint)+1)*(cast(floor(abs(zmax-zmin)/0.05e0) as bigint)+1)) as total
  from (select *, min(z) over (partition by scan_id) as zmin, max(z) over (partition by scan_id) as zmax from scene_points where surf = 3) q
  group by scan_id) t""")
def cylinder_occupancy(spark, sf):
    pts = load(spark, sf, "scene_points").filter("surf = 3").withColumn("cylinder_id", F.lit(3))
    cyl = pts.select("scan_id").distinct().selectExpr("scan_id", *TRUE_CYLINDER)
    ranges = fit.axis_ranges(pts, cyl, ["scan_id", "cylinder_id"])
    cyl = cyl.join(ranges.select("scan_id", "cylinder_id", "axis_min", "axis_max"), ["scan_id", "cylinder_id"])
    d = claims.occupancy(pts, cyl, 0.05)
    return d.select("scan_id", "occupied", "total", r("ratio", 6).alias("ratio"), (F.col("ratio") > P.occupied_ratio).alias("accepted"))


@query("cylinder_axis_range", """select scan_id, count(*) as members, round(min(z),6)+0.0e0 as axis_min, round(max(z),6)+0.0e0 as axis_max,
  round(max(z)-min(z),6)+0.0e0 as height, round(max(z),6)+0.0e0 as top_z, round((min(z)+max(z))/2e0,6)+0.0e0 as mid_z,
  0.3e0 as mid_x from scene_points where surf = 3 group by scan_id""")
def cylinder_axis_range(spark, sf):
    pts = load(spark, sf, "scene_points").filter("surf = 3").withColumn("cylinder_id", F.lit(3))
    cyl = pts.select("scan_id").distinct().selectExpr("scan_id", *TRUE_CYLINDER)
    d = fit.axis_ranges(pts, cyl, ["scan_id", "cylinder_id"])
    names = ["axis_min", "axis_max", "height", "top_z", "mid_z", "mid_x"]
    return rounded(d.select("scan_id", "members", *names), names, 6)


_dep = [(d, P.cell_size(d), P.sac_distance(d), P.ht_distance(d), *P.radius_limits(d), P.angle_at(d)) for d in range(P.depth + 1)]
part("depth_values", "select * from (values " + ", ".join(
    f"({d}, {a!r}e0, greatest(0.02e0, least(0.05e0, 0.1e0*{a!r}e0)), least(0.2e0, 2e0*{a!r}e0), 0.5e0*{a!r}e0, 10e0*{a!r}e0)"
    for d, a, *_ in _dep) + ") t(depth, size, sac, ht, r_min, r_max)")


@query("depth_thresholds", f"""select m.scan_id, cast(v.depth as bigint) as depth, count(distinct (ix // cast(pow(2, 8-v.depth) as bigint),
  iy // cast(pow(2, 8-v.depth) as bigint), iz // cast(pow(2, 8-v.depth) as bigint))) as nodes, {", ".join(f"round(max({c}),6)+0.0e0 as {c}" for c in ("size", "sac", "ht", "r_min", "r_max"))},
  round({P.angle_eps!r}e0,6)+0.0e0 as angle from scene_moments m cross join depth_values v group by m.scan_id, v.depth""")
def depth_thresholds(spark, sf):
    from ..operators import octree
    from ..params import depth_table
    nodes = octree.roll_up(octree.leaf_moments(octree.with_keys(load(spark, sf, "scene_points"), P)), P.layers(), P)
    d = nodes.groupBy("scan_id", F.col("layer").alias("depth")).agg(F.count("*").alias("nodes")).join(depth_table(spark, P), "depth")
    d = d.withColumn("depth", F.col("depth").cast("bigint"))
    return rounded(d, ["size", "sac", "ht", "r_min", "r_max", "angle"], 6)
