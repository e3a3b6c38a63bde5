"""Grids, fits, claims, merging and rasters on structures."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assign, claims, fit, grid, octree, raster, spatial
from ..operators.components import cell_components, decode
from ..params import SegParams
from ..plans import cylinders as cyl_plan
from ..plans import planes as plane_plan
from ..plans import post
from ..plans.book import stack
from ..session import stage
from ..sinks import tables
from .common import LAYER, P, SIZE, TRUE_CYLINDER, TRUE_PLANES, eigen_parts, moments_sql, r, rounded, rs
from .registry import part, query
from .views import load

KEY = ["scan_id", "plane_id"]
# plane coordinates of the three true planes (same frames as plane_frame_roundtrip)
part("plane_uv", """select scan_id, plane_id, pid, x, y, z, case plane_id when 0 then -x when 1 then -z else x end as u,
  case plane_id when 0 then y when 1 then y else -z end as v,
  case plane_id when 0 then -z-0.9e0 when 1 then x-1.6e0 else y-1.6e0 end as w from plane_points""")
part("plane_ext", """select scan_id, plane_id, count(*) as members, min(u) as umin, max(u) as umax, min(v) as vmin, max(v) as vmax,
  min(w) as wmin, max(w) as wmax from plane_uv group by all""")


def plane_cells_part(name: str, size: float) -> None:
    part(name, f"""select p.scan_id, p.plane_id, p.pid, p.u, p.v, cast(floor((p.u-e.umin)/{size!r}e0) as bigint) as cx,
      cast(floor((p.v-e.vmin)/{size!r}e0) as bigint) as cy from plane_uv p join plane_ext e on p.scan_id=e.scan_id and p.plane_id=e.plane_id""")


plane_cells_part("fine_cells", 0.03)
plane_cells_part("mid_cells", 0.25)


def true_planes(points, *, thr=0.05):
    """True planes of every scan as a small table."""
    # stored, so that joins see how few they are and points are not dealt by plane
    return stage(points.select("scan_id").distinct().selectExpr("scan_id", TRUE_PLANES).withColumn("thr", F.lit(thr)))


def local(spark, sf):
    pts = load(spark, sf, "plane_points")
    return fit.in_plane(pts, true_planes(pts), KEY)


def placed(spark, sf, size):
    d = local(spark, sf)
    return grid.with_cells(d, grid.origins(d, KEY), KEY, size)


part("cell_set", "select scan_id, plane_id, cx, cy, count(*) as n from fine_cells group by all")


@query("grid_components", """with recursive walk as (
    select scan_id, plane_id, cx, cy, cx as rx, cy as ry from cell_set
    union select w.scan_id, w.plane_id, c.cx, c.cy, w.rx, w.ry from walk w join cell_set c on c.scan_id=w.scan_id and c.plane_id=w.plane_id
      and abs(c.cx-w.cx) <= 1 and abs(c.cy-w.cy) <= 1)
  select c.scan_id, c.plane_id, c.cx, c.cy, c.n, l.root.a as root_x, l.root.b as root_y from cell_set c join (
    select scan_id, plane_id, cx, cy, min({'a': rx, 'b': ry}) as root from walk group by all) l
  on c.scan_id=l.scan_id and c.plane_id=l.plane_id and c.cx=l.cx and c.cy=l.cy""")
def grid_components(spark, sf):
    d = cell_components(grid.populate(placed(spark, sf, 0.03), KEY), KEY)
    rx, ry = decode("comp")
    return d.selectExpr("scan_id", "plane_id", "cx", "cy", "n", f"{rx} as root_x", f"{ry} as root_y")


@query("connected_parts", """with recursive walk as (
    select scan_id, plane_id, cx, cy, cx as rx, cy as ry from cell_set
    union select w.scan_id, w.plane_id, c.cx, c.cy, w.rx, w.ry from walk w join cell_set c on c.scan_id=w.scan_id and c.plane_id=w.plane_id
      and abs(c.cx-w.cx) <= 1 and abs(c.cy-w.cy) <= 1),
  label as (select scan_id, plane_id, cx, cy, min({'a': rx, 'b': ry}) as root from walk group by all),
  size as (select l.scan_id, l.plane_id, l.root, sum(c.n) as nodes from label l join cell_set c
    on c.scan_id=l.scan_id and c.plane_id=l.plane_id and c.cx=l.cx and c.cy=l.cy group by all),
  home as (select scan_id, plane_id, min(root) as root from label group by all)
  select f.scan_id, f.plane_id, f.pid, l.root.a as root_x, l.root.b as root_y from fine_cells f join label l
    on f.scan_id=l.scan_id and f.plane_id=l.plane_id and f.cx=l.cx and f.cy=l.cy
  join size s on s.scan_id=l.scan_id and s.plane_id=l.plane_id and s.root=l.root
  join home h on h.scan_id=l.scan_id and h.plane_id=l.plane_id
  where s.nodes > case when h.root = l.root then 12 else 5 end""")
def connected_parts(spark, sf):
    kept, _ = grid.connected_parts(local(spark, sf), KEY, 0.03, 12, 5)
    rx, ry = decode("comp")
    return kept.selectExpr("scan_id", "plane_id", "pid", f"{rx} as root_x", f"{ry} as root_y")


part("old_cells", """select distinct scan_id, plane_id, cx*2+i.k as cx, cy*2+j.l as cy from (select f.scan_id, f.plane_id, cast(floor((f.u-e.umin)/0.06e0) as bigint) as cx,
  cast(floor((f.v-e.vmin)/0.06e0) as bigint) as cy from fine_cells f join plane_ext e on f.scan_id=e.scan_id and f.plane_id=e.plane_id where f.u < -0.8e0) t
  cross join (select unnest([0,1]) as k) i cross join (select unnest([0,1]) as l) j""")


@query("grid_refine", "select scan_id, plane_id, cx, cy from old_cells")
def grid_refine(spark, sf):
    old = grid.populate(placed(spark, sf, 0.06).filter("u < -0.8"), KEY)
    return grid.refine(old.select(*KEY, "cx", "cy"), 2)


part("new_cells", "select * from fine_cells where u >= -0.8e0")
part("all_cells", "select scan_id, plane_id, cx, cy from old_cells union select scan_id, plane_id, cx, cy from new_cells")


@query("grid_grow", """with recursive walk as (
    select scan_id, plane_id, s.a as cx, s.b as cy from (select scan_id, plane_id, min({'a': cx, 'b': cy}) as s from old_cells group by all) h
    union select w.scan_id, w.plane_id, c.cx, c.cy from walk w join all_cells c on c.scan_id=w.scan_id and c.plane_id=w.plane_id
      and abs(c.cx-w.cx) <= 1 and abs(c.cy-w.cy) <= 1),
  hit as (select n.scan_id, n.plane_id, n.pid from new_cells n join walk w on n.scan_id=w.scan_id and n.plane_id=w.plane_id and n.cx=w.cx and n.cy=w.cy)
  select * from hit where (select count(*) from hit h where h.scan_id=hit.scan_id and h.plane_id=hit.plane_id) > 3""")
def grid_grow(spark, sf):
    own = local(spark, sf)
    o = grid.origins(own, KEY)
    old = grid.refine(grid.populate(grid.with_cells(own.filter("u < -0.8"), o, KEY, 0.06), KEY).select(*KEY, "cx", "cy"), 2)
    new = grid.with_cells(own.filter("u >= -0.8"), o, KEY, 0.03).select(*KEY, "pid", "cx", "cy")
    return grid.attached(old, new, KEY, 3).select(*KEY, "pid")


part("noise_cells", """select s.scan_id, t.plane_id, s.pid, cast(floor((case t.plane_id when 0 then -s.x when 1 then -s.z else s.x end-e.umin)/0.25e0) as bigint) as cx,
  cast(floor((case t.plane_id when 0 then s.y when 1 then s.y else -s.z end-e.vmin)/0.25e0) as bigint) as cy
  from scene_points s cross join true_planes t join plane_ext e on e.scan_id=s.scan_id and e.plane_id=t.plane_id where s.surf = 4""")
part("mid_set", "select distinct scan_id, plane_id, cx, cy from mid_cells")


@query("grid_contact", """select n.scan_id, n.plane_id, n.pid from noise_cells n where exists (select 1 from mid_set c where c.scan_id=n.scan_id
  and c.plane_id=n.plane_id and c.cx between n.cx-2 and n.cx+1 and c.cy between n.cy-2 and n.cy+1)""")
def grid_contact(spark, sf):
    own = local(spark, sf)
    o = grid.origins(own, KEY)
    cells = grid.populate(grid.with_cells(own, o, KEY, 0.25), KEY)
    pts = load(spark, sf, "scene_points").filter("surf = 4").selectExpr("scan_id", "pid", "x", "y", "z", "inline(array(struct(0 as plane_id), struct(1 as plane_id), struct(2 as plane_id)))")
    probe = grid.with_cells(fit.in_plane(pts, true_planes(own), KEY), o, KEY, 0.25)
    return grid.touching(probe, cells, KEY, 2).select(*KEY, "pid")


# fits
part("plane_moments", moments_sql("scan_id, plane_id", "plane_points"))
eigen_parts("plane_eig", "plane_moments")


@query("plane_pca_fit", """select scan_id, plane_id, n, round(case when s < 0e0 then -ex else ex end,4)+0.0e0 as nx,
  round(case when s < 0e0 then -ey else ey end,4)+0.0e0 as ny, round(case when s < 0e0 then -ez else ez end,4)+0.0e0 as nz, round(abs(s),5)+0.0e0 as d,
  round(mx,5)+0.0e0 as cgx, round(my,5)+0.0e0 as cgy, round(mz,5)+0.0e0 as cgz from (select *, ex*mx+ey*my+ez*mz as s from plane_eig) t""")
def plane_pca_fit(spark, sf):
    d = fit.pca_planes(load(spark, sf, "plane_points"), KEY).select(*KEY, "n", "nx", "ny", "nz", "d", "cgx", "cgy", "cgz")
    return rounded(rounded(d, ["nx", "ny", "nz"]), ["d", "cgx", "cgy", "cgz"], 5)


EXT = "umin umax vmin vmax wmin wmax"


@query("plane_extents", f"select scan_id, plane_id, members, {rs(EXT, 6)} from plane_ext")
def plane_extents(spark, sf):
    pts = load(spark, sf, "plane_points")
    return rounded(fit.extents(pts, true_planes(pts), KEY), EXT.split(), 6)


@query("centroids", "select scan_id, plane_id, count(*) as n, round(avg(x),6)+0.0e0 as cx, round(avg(y),6)+0.0e0 as cy, round(avg(z),6)+0.0e0 as cz from plane_points group by all")
def centroids(spark, sf):
    return rounded(fit.centroids(load(spark, sf, "plane_points"), KEY), ["cx", "cy", "cz"], 6)


def described(spark, sf):
    pts = load(spark, sf, "plane_points")
    return plane_plan.describe(true_planes(pts), pts, SIZE)


@query("plane_rectangle", """select scan_id, plane_id, round((umax-umin)*(vmax-vmin),5)+0.0e0 as area,
  round(case plane_id when 0 then -umin when 1 then 1.6e0 else umin end,5)+0.0e0 as x0,
  round(case plane_id when 0 then vmin when 1 then vmin else 1.6e0 end,5)+0.0e0 as y0, round(case plane_id when 0 then -0.9e0 when 1 then -umin else -vmin end,5)+0.0e0 as z0,
  round(case plane_id when 0 then -umax when 1 then 1.6e0+wmax else umax end,5)+0.0e0 as bx,
  cast(row_number() over (partition by scan_id order by (umax-umin)*(vmax-vmin) desc, plane_id) as bigint) as rank from plane_ext""")
def plane_rectangle(spark, sf):
    d = assign.by_area(fit.with_outline(described(spark, sf)[0]))
    return d.select(*KEY, r("area", 5).alias("area"), r(F.col("rectangle")[0]["x"], 5).alias("x0"), r(F.col("rectangle")[0]["y"], 5).alias("y0"),
                    r(F.col("rectangle")[0]["z"], 5).alias("z0"), r(F.col("box")[5]["x"], 5).alias("bx"), "rank")


# robust fit: pool in draw order, different triples, truncated squares, refit on the inliers
DRAW = "((((pid % 2147483647)*48271) % 2147483647) * 69621) % 2147483629"
part("pool", f"""select * from (select *, row_number() over (partition by scan_id, plane_id order by {DRAW}, pid) as rank,
  least(count(*) over (partition by scan_id, plane_id), 300) as ps from plane_points) t where rank <= 300""")
part("triple_numbers", f"""select scan_id, plane_id, ps, k, (k*({fit.STRIDE} % c)) % c as r from (
  select scan_id, plane_id, ps, c, unnest(range(0, least(100, c))) as k from (select distinct scan_id, plane_id, ps, ps*(ps-1)//2*(ps-2)//3 as c from pool) g where c > 0) t""")
# positions of combination r: the largest t with t over 3 <= r, then the same for the rest
part("triple_keys", """select scan_id, plane_id, k, 1+rest-k2*(k2-1)//2 as ra, 1+k2 as rb, 1+k3 as rc from (
  select *, list_max(list_filter(range(1, ps), lambda t: t*(t-1)//2 <= rest)) as k2 from (select *, r-k3*(k3-1)*(k3-2)//6 as rest from (
    select *, list_max(list_filter(range(2, ps), lambda t: t*(t-1)*(t-2)//6 <= r)) as k3 from triple_numbers) a) b) c""")
part("triples", """select t.scan_id, t.plane_id, t.k, a.x, a.y, a.z, b.x-a.x as x1, b.y-a.y as y1, b.z-a.z as z1, c.x-a.x as x2, c.y-a.y as y2, c.z-a.z as z2
  from triple_keys t join pool a on a.scan_id=t.scan_id and a.plane_id=t.plane_id and a.rank=t.ra
  join pool b on b.scan_id=t.scan_id and b.plane_id=t.plane_id and b.rank=t.rb
  join pool c on c.scan_id=t.scan_id and c.plane_id=t.plane_id and c.rank=t.rc""")
part("raw_hyps", """select *, sqrt(rx*rx+ry*ry+rz*rz) as rr from (select *, y1*z2-z1*y2 as rx, z1*x2-x1*z2 as ry, x1*y2-y1*x2 as rz from triples) t""")
part("hyps", """select scan_id, plane_id, k, rx/rr as nx, ry/rr as ny, rz/rr as nz, (rx*x+ry*y+rz*z)/rr as d from raw_hyps where rr > 1e-12""")
part("hyp_scores", """select h.scan_id, h.plane_id, h.k, h.nx, h.ny, h.nz, h.d, round(sum(least(pow(h.nx*p.x+h.ny*p.y+h.nz*p.z-h.d,2), 0.0004e0)),9) as cost
  from hyps h join plane_points p on p.scan_id=h.scan_id and p.plane_id=h.plane_id group by all""")
part("best_hyp", "select * from (select *, row_number() over (partition by scan_id, plane_id order by cost, k) as rn from hyp_scores) t where rn = 1")
part("hyp_inliers", """select p.* from plane_points p join best_hyp h on p.scan_id=h.scan_id and p.plane_id=h.plane_id
  where abs(h.nx*p.x+h.ny*p.y+h.nz*p.z-h.d) < 0.02e0""")
part("inlier_moments", moments_sql("scan_id, plane_id", "hyp_inliers"))
eigen_parts("inlier_eig", "inlier_moments")
part("refined", """select scan_id, plane_id, case when s < 0e0 then -ex else ex end as nx, case when s < 0e0 then -ey else ey end as ny,
  case when s < 0e0 then -ez else ez end as nz, abs(s) as d from (select *, ex*mx+ey*my+ez*mz as s from inlier_eig) t""")


@query("msac_plane", """select f.scan_id, f.plane_id, round(f.nx,4)+0.0e0 as nx, round(f.ny,4)+0.0e0 as ny, round(f.nz,4)+0.0e0 as nz, round(f.d,5)+0.0e0 as d,
  count(*) as inliers from refined f join plane_points p on p.scan_id=f.scan_id and p.plane_id=f.plane_id
  where abs(f.nx*p.x+f.ny*p.y+f.nz*p.z-f.d) < 0.02e0 group by f.scan_id, f.plane_id, f.nx, f.ny, f.nz, f.d""")
def msac_plane(spark, sf):
    planes, inliers = fit.msac_planes(load(spark, sf, "plane_points"), KEY, "0.02D", 100)
    counts = inliers.groupBy(*KEY).agg(F.count("*").alias("inliers"))
    d = planes.join(counts, KEY).select(*KEY, "nx", "ny", "nz", "d", "inliers")
    return rounded(rounded(d, ["nx", "ny", "nz"]), ["d"], 5)


part("hyp_votes", """select s.scan_id, t.plane_id, t.nx, t.ny, t.nz, t.d, count(*) as total, sum(cast(abs(t.nx*s.x+t.ny*s.y+t.nz*s.z-t.d) <= 0.2e0 as int)) as members
  from plane_points s join true_planes t on s.plane_id=t.plane_id group by all""")


@query("plane_acceptance", """select v.scan_id, v.plane_id, cast(v.members as bigint) as members, v.total, abs(v.nx*r.nx+v.ny*r.ny+v.nz*r.nz) > cos(2e0*0.3141592653589793e0)
  and abs(v.d-r.d) < 0.4e0 and v.members >= 20 and cast(v.members as double)/v.total >= 0.6e0 as accepted from hyp_votes v join refined r on v.scan_id=r.scan_id and v.plane_id=r.plane_id""")
def plane_acceptance(spark, sf):
    pts = load(spark, sf, "plane_points")
    truth = true_planes(pts).drop("thr")
    inside = fit.plane_inliers(pts, truth, KEY, "0.2D", strict=False)
    counts = pts.groupBy(*KEY).agg(F.count("*").alias("total")).join(inside.groupBy(*KEY).agg(F.count("*").alias("members")), KEY)
    fits, _ = fit.msac_planes(pts, KEY, "0.02D", 100)
    # one hypothesis per plane: the plane id stands in for the scan of a round
    one = truth.withColumnRenamed("scan_id", "scan").withColumn("scan_id", F.struct("scan", "plane_id"))
    keyed = fits.select(F.struct(F.col("scan_id").alias("scan"), "plane_id").alias("scan_id"), "nx", "ny", "nz", "d", F.col("scan_id").alias("s"), "plane_id")
    c = counts.select(F.struct(F.col("scan_id").alias("scan"), "plane_id").alias("scan_id"), "members", "total")
    good = plane_plan.accepted(keyed, one, c, P, LAYER, ["scan_id"]).selectExpr("s as scan_id", "plane_id", "true as ok")
    return counts.join(good, KEY, "left").select(*KEY, "members", "total", F.coalesce("ok", F.lit(False)).alias("accepted"))


def found_surfaces(points: DataFrame, assignment: DataFrame, label: str, surfaces: str, share: float) -> DataFrame:
    """Scan and true surface: its points, and whether one label holds at least ``share`` of them and little else."""
    rows = points.select("scan_id", "pid", "surf").join(assignment.select("scan_id", "pid", F.col(label).alias("label")), ["scan_id", "pid"], "left")
    held = rows.groupBy("scan_id", "surf", "label").agg(F.count("*").alias("n"))
    whole = held.groupBy("scan_id", "label").agg(F.sum("n").alias("of_label"))
    best = (held.filter("label is not null").join(whole, ["scan_id", "label"]).filter(f"n >= {share!r}D*of_label")
            .groupBy("scan_id", "surf").agg(F.max("n").alias("most")))
    total = held.groupBy("scan_id", "surf").agg(F.sum("n").alias("points")).filter(surfaces)
    return total.join(best, ["scan_id", "surf"], "left").select(
        "scan_id", F.col("surf").cast("bigint").alias("surface"), "points", F.expr(f"coalesce(most >= {share!r}D*points, false)").alias("found"))


TRUE_SURFACES = "select scan_id, cast(surf as bigint) as surface, count(*) as points, true as found from scene_points where surf {} group by 1, 2"


def found_planes(points: DataFrame, assignment: DataFrame | None, structures: DataFrame | None, share: float) -> DataFrame:
    """Scan and true plane: its points, the found plane that holds most of them, and whether that is ``share`` of them."""
    if structures is None:
        structures = points.limit(0).selectExpr("scan_id", "pid as plane_id", "x as nx", "y as ny", "z as nz", "x as d")
        assignment = points.limit(0).selectExpr("scan_id", "pid", "pid as plane_id")
    rows = points.filter("surf < 3").select("scan_id", "pid", "surf").join(assignment.select("scan_id", "pid", "plane_id"), ["scan_id", "pid"], "left")
    held = rows.groupBy("scan_id", "surf", "plane_id").agg(F.count("*").alias("n"))
    own = F.when(F.col("plane_id").isNotNull(), F.col("n"))
    most = held.groupBy("scan_id", "surf").agg(F.sum("n").alias("points"), F.max_by("plane_id", own).alias("plane_id"), F.max(own).alias("most"))
    named = most.join(structures.select("scan_id", "plane_id", "nx", "ny", "nz", "d"), ["scan_id", "plane_id"], "left")
    named = named.selectExpr("scan_id", "cast(surf as bigint) as surface", "points", f"coalesce(most >= {share!r}D*points, false) as found", "nx", "ny", "nz", "d")
    return rounded(named, ["nx", "ny", "nz", "d"], 1)


FOUND_PLANES = """select s.scan_id, cast(t.plane_id as bigint) as surface, count(*) as points, true as found, t.nx, t.ny, t.nz, t.d
  from scene_points s join true_planes t on s.surf = t.plane_id group by all"""


@query("ransac_peel_planes", FOUND_PLANES)
def ransac_peel_planes(spark, sf):
    pts = load(spark, sf, "scene_points")
    book = plane_plan.peel_planes(pts, P.but(min_sac_distance=0.05, min_points_in_cc=SegParams().min_points_in_cc))
    return found_planes(pts, stack(book.assignment), book.structures, 0.95)


# neighbourhoods
part("near_pairs", """select a.scan_id, a.pid, b.x, b.y, b.z from scene_points a join scene_points b on a.scan_id=b.scan_id
  and b.x between a.x-0.1e0 and a.x+0.1e0 and b.y between a.y-0.1e0 and a.y+0.1e0 and b.z between a.z-0.1e0 and a.z+0.1e0
  and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.010000000000000002e0""")
part("near_moments", moments_sql("scan_id, pid", "near_pairs"))
eigen_parts("near_eig", "near_moments")


# a direction is told only where the two smaller spreads differ, so that it does not hang on the order of a sum
FLAT = "n >= 3 and l1 - l0 > 1e-5"


@query("radius_normals", f"""select e.scan_id, e.pid, e.n, {', '.join(f"""case when {FLAT.replace('1e-5', '1e-5::double')} then
  round(case when e.ex*p.x+e.ey*p.y+e.ez*p.z > 0e0 then -e.e{a} else e.e{a} end,3)+0.0e0 end as n{a}""" for a in 'xyz')}
  from near_eig e join scene_points p on p.scan_id=e.scan_id and p.pid=e.pid""")
def radius_normals(spark, sf):
    pts = load(spark, sf, "scene_points").select("scan_id", "pid", "x", "y", "z")
    d = spatial.radius_normals(pts, pts, 0.1, keep=["l0", "l1"])
    d = d.selectExpr("scan_id", "pid", "n", *(f"if({FLAT}, n{a}, cast(null as double)) as n{a}" for a in "xyz"))
    return rounded(d, ["nx", "ny", "nz"], 3)


@query("voxel_downsample", """select scan_id, cast(floor(x/0.2e0) as bigint) as vx, cast(floor(y/0.2e0) as bigint) as vy, cast(floor(z/0.2e0) as bigint) as vz,
  count(*) as n, round(avg(x),5)+0.0e0 as x, round(avg(y),5)+0.0e0 as y, round(avg(z),5)+0.0e0 as z from scene_points group by 1,2,3,4""")
def voxel_downsample(spark, sf):
    return rounded(spatial.voxel_downsample(load(spark, sf, "scene_points"), 0.2), "xyz", 5)


@query("voxel_map_back", """select scan_id, pid from (select scan_id, pid, count(*) over (partition by scan_id, floor(x/0.2e0), floor(y/0.2e0), floor(z/0.2e0)) as n
  from scene_points) t where n >= 10""")
def voxel_map_back(spark, sf):
    pts = load(spark, sf, "scene_points")
    return spatial.map_back(pts, spatial.voxel_downsample(pts, 0.2).filter("n >= 10"), 0.2).select("scan_id", "pid")


# claims
part("claim_rows", f"""select s.scan_id, s.ix, s.iy, s.iz, s.n, s.mx, s.my, s.mz, t.plane_id, abs(t.nx*s.mx+t.ny*s.my+t.nz*s.mz-t.d) as dist,
  abs(t.nx*s.nx+t.ny*s.ny+t.nz*s.nz) as agree from scene_surfels s cross join true_planes t""")


@query("node_plane_claims", f"""select scan_id, ix, iy, iz, cast(plane_id as bigint) as plane_id from (select *, row_number() over (partition by scan_id, ix, iy, iz order by plane_id) as rn
  from claim_rows where dist <= 0.05e0 and agree > {math.cos(P.angle_eps)!r}e0) t where rn = 1""")
def node_plane_claims(spark, sf):
    nodes = octree.build(load(spark, sf, "scene_points"), P, [LAYER])
    d = claims.near_planes(nodes.filter("nx is not null"), true_planes(nodes), P, SIZE, P.angle_eps)
    d = claims.first_match(d, ["scan_id", "ix", "iy", "iz"], "plane_id")
    return d.select("scan_id", "ix", "iy", "iz", F.col("plane_id").cast("bigint").alias("plane_id"))


@query("node_coverage", """select k.scan_id, k.ix, k.iy, k.iz, cast(c.plane_id as bigint) as plane_id, count(*) as points,
  round(avg(cast(abs(t.nx*k.x+t.ny*k.y+t.nz*k.z-t.d) <= 0.025e0 as int)),6)+0.0e0 as share from scene_keys k join claim_rows c
  on k.scan_id=c.scan_id and k.ix=c.ix and k.iy=c.iy and k.iz=c.iz and c.dist <= 0.05e0 join true_planes t on t.plane_id=c.plane_id
  group by 1,2,3,4,5 having avg(cast(abs(t.nx*k.x+t.ny*k.y+t.nz*k.z-t.d) <= 0.025e0 as int)) >= 0.9e0""")
def node_coverage(spark, sf):
    pts = load(spark, sf, "scene_points")
    keyed = octree.with_keys(pts, P)
    nodes = octree.roll_up(octree.leaf_moments(keyed), [LAYER]).selectExpr("*", "sx/n as mx", "sy/n as my", "sz/n as mz")
    planes = true_planes(pts)
    near = claims.near_planes(nodes.select("scan_id", "depth", "ix", "iy", "iz", "mx", "my", "mz"), planes, P, SIZE)
    under = octree.points_under(near, keyed, LAYER, keep=["plane_id"]).join(planes, KEY)
    hit = F.expr("abs(nx*x + ny*y + nz*z - d) <= 0.025D")
    d = claims.coverage(under, ["scan_id", "ix", "iy", "iz", "plane_id"], hit, 0.9)
    return d.select("scan_id", "ix", "iy", "iz", F.col("plane_id").cast("bigint").alias("plane_id"), "points", r("share", 6).alias("share"))


part("spread_rows", f"""select c.*, m.u, m.v, m.w, cast(floor((m.u-e.umin)/0.25e0) as bigint) as cx, cast(floor((m.v-e.vmin)/0.25e0) as bigint) as cy,
  sqrt(pow(greatest(e.umin-m.u,m.u-e.umax,0e0),2)+pow(greatest(e.vmin-m.v,m.v-e.vmax,0e0),2)+pow(greatest(e.wmin-m.w,m.w-e.wmax,0e0),2)) as gap,
  sqrt((e.umax-e.umin)*(e.vmax-e.vmin)) as side from claim_rows c join (select scan_id, ix, iy, iz, plane_id,
    case plane_id when 0 then -mx when 1 then -mz else mx end as u, case plane_id when 0 then my when 1 then my else -mz end as v,
    case plane_id when 0 then -mz-0.9e0 when 1 then mx-1.6e0 else my-1.6e0 end as w from claim_rows) m
  on c.scan_id=m.scan_id and c.ix=m.ix and c.iy=m.iy and c.iz=m.iz and c.plane_id=m.plane_id
  join plane_ext e on e.scan_id=c.scan_id and e.plane_id=c.plane_id where c.dist <= 0.25e0""")
part("spread_hits", """select s.* from spread_rows s where gap < side*0.2e0 and exists (select 1 from mid_set k where k.scan_id=s.scan_id and k.plane_id=s.plane_id
  and k.cx between s.cx-2 and s.cx+1 and k.cy between s.cy-2 and s.cy+1)""")


def spread_rows(spark, sf):
    pts = load(spark, sf, "scene_points")
    planes, cells = described(spark, sf)
    nodes = octree.build(pts, P, [LAYER]).select("scan_id", "layer", "depth", "ix", "iy", "iz", "mx", "my", "mz")
    near = claims.near_planes(nodes, planes.withColumn("thr", F.lit(0.25)).select(*KEY, "nx", "ny", "nz", "d", "thr"), P, SIZE)
    return claims.box_and_grid(near, planes, cells, P)


@query("spread_candidates", "select scan_id, ix, iy, iz, cast(plane_id as bigint) as plane_id from spread_hits")
def spread_candidates(spark, sf):
    return spread_rows(spark, sf).select("scan_id", "ix", "iy", "iz", F.col("plane_id").cast("bigint").alias("plane_id"))


part("nearest_rows", """select scan_id, ix, iy, iz, max(case when rn=1 then plane_id end) as first_plane, max(case when rn=2 then plane_id end) as second_plane,
  max(case when rn=1 then dist end) as first_dist, max(case when rn=2 then dist end) as second_dist from (select *,
  row_number() over (partition by scan_id, ix, iy, iz order by dist, plane_id) as rn from spread_hits) t group by scan_id, ix, iy, iz""")


@query("two_nearest_planes", f"""select scan_id, ix, iy, iz, cast(first_plane as bigint) as first_plane, cast(second_plane as bigint) as second_plane,
  {rs('first_dist second_dist', 6)} from nearest_rows""")
def two_nearest_planes(spark, sf):
    d = claims.nearest_two(spread_rows(spark, sf), ["scan_id", "ix", "iy", "iz"])
    d = d.withColumns({c: F.col(c).cast("bigint") for c in ("first_plane", "second_plane")})
    return rounded(d, ["first_dist", "second_dist"], 6)


# bisecting planes of the true planes; their centroids are the members' means
part("plane_cg", "select scan_id, plane_id, avg(x) as gx, avg(y) as gy, avg(z) as gz from plane_points group by all")
part("mid0", """select q.*, a.nx as ax, a.ny as ay, a.nz as az, a.d as ad, b.nx as bx, b.ny as bjy, b.nz as bz, b.d as bd, g.gx, g.gy, g.gz, h.gx as hx0, h.gy as hy0, h.gz as hz0,
  case when a.nx*g.gx+a.ny*g.gy+a.nz*g.gz > 0e0 then -1e0 else 1e0 end as sa, case when b.nx*h.gx+b.ny*h.gy+b.nz*h.gz > 0e0 then -1e0 else 1e0 end as sb
  from (select distinct scan_id, first_plane, second_plane from nearest_rows where second_plane is not null) q
  join true_planes a on a.plane_id=q.first_plane join true_planes b on b.plane_id=q.second_plane
  join plane_cg g on g.scan_id=q.scan_id and g.plane_id=q.first_plane join plane_cg h on h.scan_id=q.scan_id and h.plane_id=q.second_plane""")
part("mid5", """select *, (sa*ax-sb*bx)/len as mx, (sa*ay-sb*bjy)/len as my, (sa*az-sb*bz)/len as mz, (sa*ad-sb*bd)/len as md
  from (select *, sqrt(2e0-2e0*sa*sb*(ax*bx+ay*bjy+az*bz)) as len from mid0) t""")
part("middles", """select scan_id, first_plane, second_plane, case when md<0e0 then -mx else mx end as hx, case when md<0e0 then -my else my end as hy,
  case when md<0e0 then -mz else mz end as hz, abs(md) as hd, gx, gy, gz, hx0, hy0, hz0 from mid5""")
part("middle_sides", "select *, hx*gx+hy*gy+hz*gz-hd as s1, hx*hx0+hy*hy0+hz*hz0-hd as s2 from middles")


@query("middle_plane_split", """select k.scan_id, k.pid, cast(case when m.s1*m.s2 > 0e0 or (m.s1 < 0e0 and m.hx*k.x+m.hy*k.y+m.hz*k.z-m.hd < 0e0)
    or (m.s1 >= 0e0 and m.hx*k.x+m.hy*k.y+m.hz*k.z-m.hd > 0e0) then m.first_plane else m.second_plane end as bigint) as plane_id
  from scene_keys k join nearest_rows q on k.scan_id=q.scan_id and k.ix=q.ix and k.iy=q.iy and k.iz=q.iz
  join middle_sides m on m.scan_id=q.scan_id and m.first_plane=q.first_plane and m.second_plane=q.second_plane""")
def middle_plane_split(spark, sf):
    planes, _ = described(spark, sf)
    two = stage(claims.nearest_two(spread_rows(spark, sf), ["scan_id", "depth", "ix", "iy", "iz"])).filter("second_plane is not null")
    keyed = octree.with_keys(load(spark, sf, "scene_points"), P)
    edge = octree.points_under(two.select("scan_id", "depth", "ix", "iy", "iz", "first_plane", "second_plane"), keyed, LAYER, keep=["first_plane", "second_plane"])
    d = claims.split_points(edge, claims.middle_planes(two, planes))
    return d.select("scan_id", "pid", F.col("plane_id").cast("bigint").alias("plane_id"))


# merging: every true plane is cut in two halves that should merge again
part("half_points", "select scan_id, plane_id*2+cast(u > 0e0 as int) as plane_id, pid, x, y, z from plane_uv")
part("half_moments", moments_sql("scan_id, plane_id", "half_points"))
eigen_parts("half_eig", "half_moments")
part("half_planes", """select scan_id, plane_id, n, mx, my, mz, case when s<0e0 then -ex else ex end as nx, case when s<0e0 then -ey else ey end as ny,
  case when s<0e0 then -ez else ez end as nz, abs(s) as d from (select *, ex*mx+ey*my+ez*mz as s from half_eig) t""")


def halves(spark, sf):
    return local(spark, sf).selectExpr("scan_id", "plane_id*2 + cast(u > 0 as int) as plane_id", "pid", "x", "y", "z")


def half_planes(spark, sf):
    d = fit.pca_planes(halves(spark, sf), KEY)
    return d.withColumns({"thr": F.lit(0.05), "rank": F.col("plane_id")})


@query("merge_candidates", f"""select a.scan_id, cast(a.plane_id as bigint) as a_id, cast(b.plane_id as bigint) as b_id from half_planes a join half_planes b on a.scan_id=b.scan_id and a.plane_id < b.plane_id
  and abs(a.nx*b.nx+a.ny*b.ny+a.nz*b.nz) > {math.cos(P.angle_eps)!r}e0 and abs(a.nx*b.mx+a.ny*b.my+a.nz*b.mz-a.d) <= 0.05e0
  and abs(b.nx*a.mx+b.ny*a.my+b.nz*a.mz-b.d) <= 0.05e0""")
def merge_candidates(spark, sf):
    d = claims.merge_candidates(half_planes(spark, sf), P)
    return d.select("scan_id", F.col("a_id").cast("bigint").alias("a_id"), F.col("b_id").cast("bigint").alias("b_id"))


@query("merged_planes", """select scan_id, cast(plane_id*2 as bigint) as plane_id, n as members, round(case when s < 0e0 then -ex else ex end,4)+0.0e0 as nx,
  round(case when s < 0e0 then -ey else ey end,4)+0.0e0 as ny, round(case when s < 0e0 then -ez else ez end,4)+0.0e0 as nz, round(abs(s),4)+0.0e0 as d
  from (select *, ex*mx+ey*my+ez*mz as s from plane_eig) t""")
def merged_planes(spark, sf):
    pts = halves(spark, sf)
    fitted = half_planes(spark, sf).select(*KEY, "nx", "ny", "nz", "d", "thr")
    table, cells = plane_plan.describe(fitted, pts, SIZE)
    book = plane_plan.Book()
    # equal areas would leave the order open; the id decides which half is the centre
    table = table.withColumns({"layer": F.lit(LAYER), "area": -F.col("plane_id").cast("double")})
    book.add_structures(table, cells)
    book.assignment.append(stage(pts.select("scan_id", "pid", "plane_id")))
    merged = post.merge_planes(book, pts, P).structures
    d = merged.select("scan_id", F.col("plane_id").cast("bigint").alias("plane_id"), "members", "nx", "ny", "nz", "d")
    return rounded(d, ["nx", "ny", "nz", "d"])


@query("merged_planes_fixpoint", """select scan_id, cast(plane_id as bigint) as surface, n as members, round(case when s < 0e0 then -ex else ex end,4)+0.0e0 as nx,
  round(case when s < 0e0 then -ey else ey end,4)+0.0e0 as ny, round(case when s < 0e0 then -ez else ez end,4)+0.0e0 as nz, round(abs(s),4)+0.0e0 as d
  from (select *, ex*mx+ey*my+ez*mz as s from plane_eig) t""")
def merged_planes_fixpoint(spark, sf):
    """Every plane cut into five strips, of which only neighbours touch; merging goes on until the plane is whole."""
    along = "if(plane_id = 0, x, if(plane_id = 1, y, x))"
    pts = load(spark, sf, "plane_points").selectExpr(
        "scan_id", f"cast(plane_id*8 + least(4, floor(({along} + 1)*2.5D)) as bigint) as plane_id", "pid", "x", "y", "z")
    pts = stage(pts)
    fitted = fit.pca_planes(pts, KEY).select(*KEY, "nx", "ny", "nz", "d").withColumn("thr", F.lit(0.05))
    table, cells = plane_plan.describe(fitted, pts, SIZE)
    book = plane_plan.Book()
    # equal areas would leave the order open; the id decides
    book.add_structures(table.withColumns({"layer": F.lit(LAYER), "area": -F.col("plane_id").cast("double")}), cells)
    book.assignment.append(pts.select("scan_id", "pid", "plane_id"))
    merged = post.merge_to_fixpoint(book, pts, P).structures
    merged = merged.selectExpr("scan_id", "plane_id div 8 as surface", "members", "nx", "ny", "nz", "d")
    return rounded(merged, ["nx", "ny", "nz", "d"])


@query("cylinder_claims", f"""select scan_id, ix, iy, iz from scene_surfels where nx is not null and abs(sqrt((mx-0.3e0)*(mx-0.3e0)+(my+0.2e0)*(my+0.2e0))-0.3e0) < 0.05e0
  and abs(((mx-0.3e0)*nx+(my+0.2e0)*ny)/sqrt((mx-0.3e0)*(mx-0.3e0)+(my+0.2e0)*(my+0.2e0))) >= {math.cos(P.angle_eps)!r}e0 and mz < 1.4e0 and mz > -1.4e0""")
def cylinder_claims(spark, sf):
    nodes = octree.build(load(spark, sf, "scene_points"), P, [LAYER]).filter("nx is not null")
    cyl = nodes.select("scan_id").distinct().selectExpr("scan_id", *TRUE_CYLINDER, "-1D as axis_min", "1D as axis_max", "0.05D as thr", "3 as crank")
    d = claims.first_match(claims.near_cylinders(nodes, cyl, P, SIZE), ["scan_id", "ix", "iy", "iz"], "crank")
    return d.select("scan_id", "ix", "iy", "iz")


# consensus cylinder: radius normals, different pairs in draw order, weighted error of every point
part("tube_points", "select scan_id, pid, x, y, z from scene_points where surf = 3")
part("tube_near", """select a.scan_id, a.pid, b.x, b.y, b.z from tube_points a join tube_points b on a.scan_id=b.scan_id
  and b.z between a.z-0.25e0 and a.z+0.25e0 and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.0625e0""")
part("tube_moments", moments_sql("scan_id, pid", "tube_near"))
eigen_parts("tube_eig", "tube_moments")
part("tube_normals", """select * from (select p.*, case when e.ex*p.x+e.ey*p.y+e.ez*p.z > 0e0 then -e.ex else e.ex end as nx,
  case when e.ex*p.x+e.ey*p.y+e.ez*p.z > 0e0 then -e.ey else e.ey end as ny, case when e.ex*p.x+e.ey*p.y+e.ez*p.z > 0e0 then -e.ez else e.ez end as nz
  from tube_points p join tube_eig e using (scan_id, pid) where e.n >= 3) t where nx is not null""")
part("tube_pool", f"""select * from (select *, row_number() over (partition by scan_id order by {DRAW}, pid) - 1 as place,
  least(count(*) over (partition by scan_id), 20000) as ps from tube_normals) t where place < 20000""")
part("tube_pairs", f"""select scan_id, k, r-k2*(k2-1)//2 as ra, k2 as rb from (select *, list_max(list_filter(range(1, ps), lambda t: t*(t-1)//2 <= r)) as k2 from (
  select scan_id, ps, k, (k*({fit.STRIDE} % c)) % c as r from (select scan_id, ps, c, unnest(range(0, least(10000, c))) as k from (
    select distinct scan_id, ps, ps*(ps-1)//2 as c from tube_pool) g where c > 0) t) u) w""")
part("tube_axes", """select *, sqrt(rx*rx+ry*ry+rz*rz) as r from (select p.scan_id, p.k, f.x as fx, f.y as fy, f.z as fz, f.nx as fnx, f.ny as fny, f.nz as fnz,
  g.x as gx, g.y as gy, g.z as gz, g.nx as gnx, g.ny as gny, g.nz as gnz, f.ny*g.nz-f.nz*g.ny as rx, f.nz*g.nx-f.nx*g.nz as ry, f.nx*g.ny-f.ny*g.nx as rz
  from tube_pairs p join tube_pool f on f.scan_id=p.scan_id and f.place=p.ra join tube_pool g on g.scan_id=p.scan_id and g.place=p.rb) t""")
part("tube_units", """select *, s*rx/r as ux, s*ry/r as uy, s*rz/r as uz from (select *,
  case when rz < 0e0 or (rz = 0e0 and (ry < 0e0 or (ry = 0e0 and rx < 0e0))) then -1e0 else 1e0 end as s from tube_axes where r > 1e-3) t""")
# the normal lines seen along the axis meet at f + t*fn
part("tube_meets", """select *, fx+t*fnx as px, fy+t*fny as py, fz+t*fnz as pz from (select *,
  ((gx-fx)*(gny*uz-gnz*uy)+(gy-fy)*(gnz*ux-gnx*uz)+(gz-fz)*(gnx*uy-gny*ux))/nullif(fnx*(gny*uz-gnz*uy)+fny*(gnz*ux-gnx*uz)+fnz*(gnx*uy-gny*ux),0e0) as t from tube_units) a""")
part("tube_hyps", """select * from (select *, (abs(t)+sqrt(pow(gx-px-h*ux,2)+pow(gy-py-h*uy,2)+pow(gz-pz-h*uz,2)))/2e0 as radius from (
  select *, (gx-px)*ux+(gy-py)*uy+(gz-pz)*uz as h from tube_meets) a) b where radius >= 0.001e0 and radius <= 10e0""")
part("tube_seen", """select scan_id, k, px, py, ux, uy, uz, radius, nx, ny, nz, qx-h*ux as ox, qy-h*uy as oy, qz-h*uz as oz from (
  select c.*, p.nx, p.ny, p.nz, p.x-c.px as qx, p.y-c.py as qy, p.z-c.pz as qz, (p.x-c.px)*c.ux+(p.y-c.py)*c.uy+(p.z-c.pz)*c.uz as h
  from (select scan_id, k, px, py, pz, ux, uy, uz, radius from tube_hyps) c join tube_normals p using (scan_id)) a""")
part("tube_scores", f"""select scan_id, k, px, py, ux, uy, uz, radius, count(*) filter ({1 - P.normal_distance_weight!r}e0*abs(dist-radius)
  +{P.normal_distance_weight!r}e0*least(acos(c), pi()-acos(c)) < 0.05e0) as inliers from (
  select *, least(1e0, greatest(-1e0, coalesce((ox*nx+oy*ny+oz*nz)/nullif(dist,0e0),0e0))) as c from (select *, sqrt(ox*ox+oy*oy+oz*oz) as dist from tube_seen) a) b group by all""")


@query("ransac_cylinder", f"""select scan_id, inliers, {rs('px py ax ay az radius', 2)} from (select scan_id, inliers, px, py, ux as ax, uy as ay, uz as az, radius,
  row_number() over (partition by scan_id order by inliers desc, k) as rn from tube_scores) t where rn = 1""")
def ransac_cylinder(spark, sf):
    pts = load(spark, sf, "scene_points").filter("surf = 3").select("scan_id", "pid", "x", "y", "z")
    oriented = stage(spatial.radius_normals(pts, pts, 0.25))
    best, inliers = fit.ransac_cylinders(oriented, ["scan_id"], "0.05D", P.normal_distance_weight, 0.001, 10.0)
    got = inliers.groupBy("scan_id").agg(F.count("*").alias("inliers"))
    return best.drop("inliers").join(got, "scan_id").select("scan_id", "inliers", *(r(c, 2).alias(c) for c in ("px", "py", "ax", "ay", "az", "radius")))


@query("ransac_peel_cylinders", TRUE_SURFACES.format("= 3"))
def ransac_peel_cylinders(spark, sf):
    pts = load(spark, sf, "scene_points")
    p = P.but(min_sac_distance=0.05, max_cylinder_radius=0.5, occupied_ratio=0.1)
    book = cyl_plan.peel_cylinders(pts, p)
    return found_surfaces(pts, stack(book.assignment), "cylinder_id", "surf = 3", 0.6)


@query("cylinder_pose", """select scan_id, 0.6e0 as diameter, round(max(z)-min(z),6)+0.0e0 as height, 0e0 as qx, 0e0 as qy, 0e0 as qz, 1e0 as qw, 0.3e0 as mid_x, -0.2e0 as mid_y,
  round((max(z)+min(z))/2e0,6)+0.0e0 as mid_z, round(min(z),6)+0.0e0 as box_low, round(max(z),6)+0.0e0 as box_high from scene_points where surf = 3 group by scan_id""")
def cylinder_pose(spark, sf):
    pts = load(spark, sf, "scene_points").filter("surf = 3").withColumn("cylinder_id", F.lit(3))
    cyl = pts.select("scan_id").distinct().selectExpr("scan_id", *TRUE_CYLINDER)
    ends = fit.axis_ranges(pts, cyl, ["scan_id", "cylinder_id"]).select("scan_id", "cylinder_id", "axis_min", "axis_max")
    d = tables.cylinder_poses(cyl.join(ends, ["scan_id", "cylinder_id"]))
    d = d.withColumns({"box_low": F.col("box")[0]["z"], "box_high": F.col("box")[5]["z"]}).drop("box", "cylinder_id")
    return rounded(d, [c for c in d.columns if c != "scan_id"], 6)


@query("plane_outline", """select scan_id, plane_id, cast(k as bigint) as corner, round(case plane_id when 0 then -u when 1 then 1.6e0 else u end,5)+0.0e0 as x,
  round(case plane_id when 0 then v when 1 then v else 1.6e0 end,5)+0.0e0 as y, round(case plane_id when 0 then -0.9e0 when 1 then -u else -v end,5)+0.0e0 as z, round(tip_z,5)+0.0e0 as tip_z from (
  select e.scan_id, e.plane_id, k.k, case when k.c in (0,1) then umin else umax end as u, case when k.c in (0,3) then vmin else vmax end as v,
    g.gz+0.1e0*t.nz as tip_z from plane_ext e join (values (0,0),(1,1),(2,2),(3,2),(4,3),(5,0)) k(k, c) on true
  join plane_cg g on g.scan_id=e.scan_id and g.plane_id=e.plane_id join true_planes t on t.plane_id=e.plane_id) q""")
def plane_outline(spark, sf):
    d = tables.plane_outlines(described(spark, sf)[0]).select(*KEY, "corner", "x", "y", "z", "tip_z")
    return rounded(d, ["x", "y", "z", "tip_z"], 5)


# rasters
part("tex_size", """select *, floor((umax-umin)/texel)+1 as width, floor((vmax-vmin)/texel)+1 as height from (
  select *, 2e0*sqrt((umax-umin)*(vmax-vmin)/members) as texel from plane_ext) t""")
part("tex_pot", """select *, cast(greatest(2, pow(2, ceil(log2(width)))) as bigint) as w_pot, cast(greatest(2, pow(2, ceil(log2(height)))) as bigint) as h_pot from tex_size""")
part("tex_rows", """select c.scan_id, c.plane_id, c.rgb, c.intensity, p.w, cast(floor(abs(p.u-s.umin)/s.texel) as bigint) as tx, cast(floor(abs(p.v-s.vmin)/s.texel) as bigint) as ty
  from (select *, surf as plane_id from colored_points where surf < 3) c join plane_uv p on p.scan_id=c.scan_id and p.pid=c.pid
  join tex_pot s on s.scan_id=c.scan_id and s.plane_id=c.plane_id""")


def texels(spark, sf):
    pts = load(spark, sf, "colored_points").filter("surf < 3").withColumnRenamed("surf", "plane_id")
    planes = true_planes(pts)
    size = raster.sizes(pts, planes, P.texel_size_factor)
    return size, raster.place(pts, planes, size)


@query("raster_size", """select scan_id, plane_id, round(texel,6)+0.0e0 as texel, cast(width as bigint) as width, cast(height as bigint) as height, w_pot, h_pot,
  round(width/w_pot,6)+0.0e0 as width_ratio, round(height/h_pot,6)+0.0e0 as height_ratio from tex_pot""")
def raster_size(spark, sf):
    d = texels(spark, sf)[0].select(*KEY, "texel", "width", "height", "w_pot", "h_pot", "width_ratio", "height_ratio")
    return rounded(d, ["texel", "width_ratio", "height_ratio"], 6)


part("tex_rgb", """select scan_id, plane_id, tx, ty, avg(((rgb >> 16) & 255)/255e0) as red, avg(((rgb >> 8) & 255)/255e0) as green, avg((rgb & 255)/255e0) as blue, 1e0 as alpha
  from tex_rows group by all""")


@query("texture_rgb", f"select scan_id, plane_id, tx, ty, {rs('red green blue', 5)}, alpha from tex_rgb")
def texture_rgb(spark, sf):
    return rounded(raster.colours(texels(spark, sf)[1]), ["red", "green", "blue"], 5)


@query("texture_intensity", "select scan_id, plane_id, tx, ty, round(avg(intensity),5)+0.0e0 as intensity, 1e0 as alpha from tex_rows group by all")
def texture_intensity(spark, sf):
    return rounded(raster.intensities(texels(spark, sf)[1]), ["intensity"], 5)


@query("texture_alpha", "select distinct scan_id, plane_id, tx, ty, 1e0 as alpha from tex_rows")
def texture_alpha(spark, sf):
    return raster.alphas(texels(spark, sf)[1])


part("tex_h", "select scan_id, plane_id, tx, ty, avg(0.5e0*w/0.05e0+0.5e0) as h from tex_rows group by all")


@query("height_map", "select scan_id, plane_id, tx, ty, round(h,5)+0.0e0 as h from tex_h")
def height_map(spark, sf):
    return rounded(raster.heights(texels(spark, sf)[1], 0.05), ["h"], 5)


part("tex_grid", """select s.scan_id, s.plane_id, s.w_pot, s.h_pot, gx.i as tx, gy.i as ty from tex_pot s join (select unnest(range(0, 4096)) as i) gx on gx.i < s.w_pot
  join (select unnest(range(0, 4096)) as i) gy on gy.i < s.h_pot""")
part("tex_dense", "select g.*, coalesce(t.h, 0e0) as h from tex_grid g left join tex_h t on t.scan_id=g.scan_id and t.plane_id=g.plane_id and t.tx=g.tx and t.ty=g.ty")
A, B = raster.SIDE_WEIGHT, raster.CENTRE_WEIGHT


def blur_part(name: str, source: str, cols: str) -> None:
    vals = ", ".join(f"sum(i.w*j.w*s.{c}) as {c}" for c in cols.split())
    part(name, f"""select g.scan_id, g.plane_id, g.tx, g.ty, {vals} from tex_grid g
      join (values (-1, {A!r}e0), (0, {B!r}e0), (1, {A!r}e0)) i(o, w) on true join (values (-1, {A!r}e0), (0, {B!r}e0), (1, {A!r}e0)) j(o, w) on true
      join {source} s on s.scan_id=g.scan_id and s.plane_id=g.plane_id
       and s.tx = case when g.tx+i.o < 0 then 1 when g.tx+i.o >= g.w_pot then g.w_pot-2 else g.tx+i.o end
       and s.ty = case when g.ty+j.o < 0 then 1 when g.ty+j.o >= g.h_pot then g.h_pot-2 else g.ty+j.o end group by all""")


blur_part("tex_blur", "tex_dense", "h")


@query("blur", "select scan_id, plane_id, tx, ty, round(h,5)+0.0e0 as h from tex_blur where h > 1e-9")
def blur(spark, sf):
    size, rows = texels(spark, sf)
    d = raster.blur(raster.heights(rows, 0.05), size, ["h"]).filter("h > 1e-9")
    return rounded(d, ["h"], 5)


@query("dilate", """select g.scan_id, g.plane_id, g.tx, g.ty, round(max(t.h),5)+0.0e0 as h from tex_grid g join tex_h t on t.scan_id=g.scan_id and t.plane_id=g.plane_id
  and abs(t.tx-g.tx) <= 1 and abs(t.ty-g.ty) <= 1 group by all""")
def dilate(spark, sf):
    size, rows = texels(spark, sf)
    return rounded(raster.dilate(raster.heights(rows, 0.05), size, ["h"], 1), ["h"], 5)


part("tex_nm0", """select g.scan_id, g.plane_id, g.tx, g.ty, g.w_pot, g.h_pot, coalesce(o.h,0e0)-coalesce(u.h,0e0) as a, coalesce(o.h,0e0)-coalesce(v.h,0e0) as c from tex_grid g
  left join tex_blur o on o.scan_id=g.scan_id and o.plane_id=g.plane_id and o.tx=g.tx and o.ty=g.ty
  left join tex_blur u on u.scan_id=g.scan_id and u.plane_id=g.plane_id and u.tx=g.tx and u.ty=g.ty+1
  left join tex_blur v on v.scan_id=g.scan_id and v.plane_id=g.plane_id and v.tx=g.tx+1 and v.ty=g.ty""")
part("tex_nm", """select scan_id, plane_id, tx, ty, case when tx+1 < w_pot and ty+1 < h_pot then (a/sqrt(a*a+0.09e0+c*c)+1e0)*0.5e0 else 0e0 end as mx,
  case when tx+1 < w_pot and ty+1 < h_pot then (0.3e0/sqrt(a*a+0.09e0+c*c)+1e0)*0.5e0 else 0e0 end as my,
  case when tx+1 < w_pot and ty+1 < h_pot then (c/sqrt(a*a+0.09e0+c*c)+1e0)*0.5e0 else 0e0 end as mz from tex_nm0""")
blur_part("tex_nmb", "tex_nm", "mx my mz")


@query("normal_map", f"select scan_id, plane_id, tx, ty, {rs('mx my mz')} from tex_nmb")
def normal_map(spark, sf):
    size, rows = texels(spark, sf)
    size = stage(size)
    high = raster.blur(raster.heights(rows, 0.05), size, ["h"])
    return rounded(raster.normal_map(high, size), ["mx", "my", "mz"])


@query("quantized_raster", """select t.scan_id, t.plane_id, t.tx, t.ty, cast(floor(round(t.red*255e0,6)+0.5e0) as integer) as red, cast(floor(round(t.green*255e0,6)+0.5e0) as integer) as green,
  cast(floor(round(t.blue*255e0,6)+0.5e0) as integer) as blue from tex_rgb t join tex_pot s on s.scan_id=t.scan_id and s.plane_id=t.plane_id where t.tx < s.width and t.ty < s.height""")
def quantized_raster(spark, sf):
    size, rows = texels(spark, sf)
    return raster.cropped_bytes(raster.colours(rows), size, ["red", "green", "blue"]).drop("alpha")


@query("plane_records", """select t.scan_id, t.plane_id, t.ty, count(*) as texels, cast(sum(floor(round(t.red*255e0,6)+0.5e0)) as bigint) as red,
  cast(sum(floor(round(t.green*255e0,6)+0.5e0)) as bigint) as green, cast(sum(floor(round(t.blue*255e0,6)+0.5e0)) as bigint) as blue, count(*) as touched,
  cast(sum(cast(floor(round(h.h*255e0,6)+0.5e0) as bigint)) as bigint) as height, p.nx, p.ny, p.nz, p.d
  from tex_rgb t join tex_h h on h.scan_id=t.scan_id and h.plane_id=t.plane_id and h.tx=t.tx and h.ty=t.ty join true_planes p on p.plane_id=t.plane_id
  join tex_pot s on s.scan_id=t.scan_id and s.plane_id=t.plane_id where t.tx < s.width and t.ty < s.height group by all""")
def plane_records(spark, sf):
    size, rows = texels(spark, sf)
    planes, _ = described(spark, sf)
    d = tables.plane_records(planes, size, raster.colours(rows), raster.heights(rows, 0.05))
    total = lambda c: F.expr(f"aggregate(texels, 0L, (a, t) -> a + t.{c})")
    return d.select(*KEY, "ty", F.size("texels").cast("bigint").alias("texels"), *(total(c).alias(c) for c in ("red", "green", "blue")),
                    F.expr("cast(size(filter(texels, t -> t.alpha)) as bigint)").alias("touched"), total("h").alias("height"), "nx", "ny", "nz", "d")
