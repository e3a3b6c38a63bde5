"""Octree queries: moments, roll-up, surfels, finest normals, pairs."""

from pyspark.sql import functions as F

from ..operators import octree
from ..params import SegParams
from .common import LAYER, P, moments_sql, r, rounded, rs, surfel_parts
from .registry import part, query
from .views import load

SUMS = "sx sy sz sxx sxy sxz syy syz szz"


@query("voxel_moments", f"select scan_id, ix, iy, iz, n, node_min, {rs(SUMS)} from "
       + "(select *, (select 0) as zero from scene_moments) m join "
       + "(select scan_id as s, ix as a, iy as b, iz as c, min(pid) as node_min from scene_keys group by all) k "
       + "on scan_id=s and ix=a and iy=b and iz=c")
def voxel_moments(spark, sf):
    leaves = octree.leaf_moments(octree.with_keys(load(spark, sf, "scene_points"), P))
    df = leaves.select("scan_id", F.col("lx").alias("ix"), F.col("ly").alias("iy"), F.col("lz").alias("iz"),
                       "n", "node_min", *SUMS.split())
    return rounded(df, SUMS.split())


part("layer_keys", "select *, cast(d.layer as bigint) as lay from scene_keys cross join "
     f"(select unnest(range(0, {LAYER + 1})) as layer) d")
part("layer_cells", f"""select scan_id, lay, x, y, z, ix // cast(pow(2, {LAYER}-lay) as bigint) as ix,
  iy // cast(pow(2, {LAYER}-lay) as bigint) as iy, iz // cast(pow(2, {LAYER}-lay) as bigint) as iz from layer_keys""")
part("layer_moments", moments_sql("scan_id, lay, ix, iy, iz", "layer_cells"))


@query("octree_rollup", f"select scan_id, lay as layer, ix, iy, iz, n, {rs(SUMS, 3)} from layer_moments")
def octree_rollup(spark, sf):
    leaves = octree.leaf_moments(octree.with_keys(load(spark, sf, "scene_points"), P))
    df = octree.roll_up(leaves, P.layers(), P).withColumn("layer", F.col("layer").cast("bigint"))
    return rounded(df.select("scan_id", "layer", "ix", "iy", "iz", "n", *SUMS.split()), SUMS.split(), 3)


ADAPTIVE = SegParams(min_octree_resolution=0.05, sq_dist_factor=0.05, rho_max=6.4)
_sizes = [(d, ADAPTIVE.cell_size(d)) for d in range(ADAPTIVE.depth, -1, -1)]
_case = " ".join(f"when {s!r}e0 >= greatest(0.05e0, 0.05e0*(x*x+y*y+z*z)) then {d}" for d, s in _sizes)
part("leaf_depths", f"select scan_id, pid, x, y, z, cast(case {_case} else 0 end as bigint) as ld from scene_points")


@query("leaf_depth", """select scan_id, ld as leaf_depth, count(*) as points, count(distinct (kx, ky, kz)) as cells,
  max(max(ld)) over (partition by scan_id) as max_depth from (select *,
  cast(floor((x+6.4e0)/0.05e0) as bigint) // cast(pow(2, 8-ld) as bigint) as kx,
  cast(floor((y+6.4e0)/0.05e0) as bigint) // cast(pow(2, 8-ld) as bigint) as ky,
  cast(floor((z+6.4e0)/0.05e0) as bigint) // cast(pow(2, 8-ld) as bigint) as kz from leaf_depths) t
  group by scan_id, ld""")
def leaf_depth(spark, sf):
    keyed = octree.with_keys(load(spark, sf, "scene_points"), ADAPTIVE)
    cells = octree.leaf_moments(keyed)
    per = cells.groupBy("scan_id", "leaf_depth").agg(F.sum("n").alias("points"), F.count("*").alias("cells"))
    per = per.withColumn("leaf_depth", F.col("leaf_depth").cast("bigint"))
    deepest = per.groupBy("scan_id").agg(F.max("leaf_depth").alias("max_depth"))
    return per.join(deepest, "scan_id")


SURF = "mx my mz curv curv2 nx ny nz"


@query("surfels", f"select scan_id, ix, iy, iz, n, {rs(SURF)}, stable from scene_surfels where stable")
def surfels(spark, sf):
    df = octree.build(load(spark, sf, "scene_points"), P, [LAYER]).filter("stable")
    return rounded(df.select("scan_id", "ix", "iy", "iz", "n", *SURF.split(), "stable"), SURF.split())


surfel_parts("layer_surfels", "layer_moments")


@query("stable_by_depth", """select scan_id, lay as layer, count(*) as nodes,
  cast(sum(cast(stable as int)) as bigint) as stable_nodes, cast(sum(n) as bigint) as points
  from layer_surfels group by scan_id, lay""")
def stable_by_depth(spark, sf):
    nodes = octree.build(load(spark, sf, "scene_points"), P)
    return nodes.groupBy("scan_id", F.col("layer").cast("bigint").alias("layer")).agg(
        F.count("*").alias("nodes"), F.sum(F.col("stable").cast("bigint")).alias("stable_nodes"),
        F.sum("n").alias("points"))


@query("finest_normal", f"""select pid, scan_id, normal_depth, {rs('nx ny nz')} from (
  select k.pid, k.scan_id, s.lay as normal_depth, s.nx, s.ny, s.nz,
    row_number() over (partition by k.scan_id, k.pid order by s.lay desc) as rn
  from (select pid, scan_id, lay, ix // cast(pow(2, 8-lay) as bigint) as a, iy // cast(pow(2, 8-lay) as bigint) as b,
          iz // cast(pow(2, 8-lay) as bigint) as c from layer_keys) k
  join layer_surfels s on s.scan_id=k.scan_id and s.lay=k.lay and s.ix=k.a and s.iy=k.b and s.iz=k.c and s.stable) t
  where rn = 1""")
def finest_normal(spark, sf):
    keyed = octree.with_keys(load(spark, sf, "scene_points"), P)
    nodes = octree.surfels(octree.roll_up(octree.leaf_moments(keyed), P.layers(), P), P)
    df = octree.finest_normals(keyed, nodes).filter("nx is not null")
    df = df.select("pid", "scan_id", F.col("normal_depth").cast("bigint").alias("normal_depth"), "nx", "ny", "nz")
    return rounded(df, ["nx", "ny", "nz"])


# pairs: half of the 5x5x5 offset cube, oracle by plain inequality join
part("pair_nodes", "select * from scene_surfels where stable")
part("node_pair_rows", """select a.scan_id, a.ix as a_ix, a.iy as a_iy, a.iz as a_iz, b.ix as b_ix, b.iy as b_iy, b.iz as b_iz,
  a.n+b.n as n, greatest(a.curv, b.curv) as curv, a.mx as amx, a.my as amy, a.mz as amz, b.mx as bmx, b.my as bmy, b.mz as bmz,
  a.nx as anx_, a.ny as any_, a.nz as anz_, b.nx as bnx_, b.ny as bny_, b.nz as bnz_,
  a.ny*b.nz-a.nz*b.ny as rx, a.nz*b.nx-a.nx*b.nz as ry, a.nx*b.ny-a.ny*b.nx as rz,
  a.nx*b.nx+a.ny*b.ny+a.nz*b.nz as cosab
  from pair_nodes a join pair_nodes b on a.scan_id=b.scan_id and abs(a.ix-b.ix)<=2 and abs(a.iy-b.iy)<=2
   and abs(a.iz-b.iz)<=2 and (a.ix, a.iy, a.iz) < (b.ix, b.iy, b.iz)""")
part("node_pair_axes", """select *, sqrt(rx*rx+ry*ry+rz*rz) as rn, rx/nullif(sqrt(rx*rx+ry*ry+rz*rz),0e0) as cross_x,
  ry/nullif(sqrt(rx*rx+ry*ry+rz*rz),0e0) as cross_y, rz/nullif(sqrt(rx*rx+ry*ry+rz*rz),0e0) as cross_z from node_pair_rows""")


@query("node_pairs", f"""select scan_id, a_ix, a_iy, a_iz, b_ix, b_iy, b_iz, n, {rs('curv')},
  case when rn > 1e-2 then round(cross_x, 4)+0.0e0 end as cross_x, case when rn > 1e-2 then round(cross_y, 4)+0.0e0 end as cross_y,
  case when rn > 1e-2 then round(cross_z, 4)+0.0e0 end as cross_z from node_pair_axes""")
def node_pairs(spark, sf):
    nodes = octree.build(load(spark, sf, "scene_points"), P, [LAYER])
    df = octree.neighbour_pairs(nodes, 2)
    cos = sum((F.col(f"a_n{a}") * F.col(f"b_n{a}") for a in "yz"), F.col("a_nx") * F.col("b_nx"))
    clear = 1 - cos * cos > 1e-4
    return df.select("scan_id", *(f"{s}_i{a}" for s in "ab" for a in "xyz"), "n", r("curv").alias("curv"),
                     *(F.when(clear, r(f"cross_{a}")).alias(f"cross_{a}") for a in "xyz"))


surfel_parts("loose_surfels", "layer_moments", SegParams(curv_threshold=1e9, curv2_threshold=0.0), 20)


@query("surfel_geometry", f"""select l.scan_id, l.lay as depth, l.ix, l.iy, l.iz, l.n, 0.25e0*pow(2, 8-l.lay) as size,
  (l.ix+0.5e0)*0.25e0*pow(2,8-l.lay)-32e0 as cx, (l.iy+0.5e0)*0.25e0*pow(2,8-l.lay)-32e0 as cy,
  (l.iz+0.5e0)*0.25e0*pow(2,8-l.lay)-32e0 as cz,
  round(l.mx,4)+0.0e0 as mx, round(l.my,4)+0.0e0 as my, round(l.mz,4)+0.0e0 as mz, s.stable
  from loose_surfels l join layer_surfels s on l.scan_id=s.scan_id and l.lay=s.lay and l.ix=s.ix and l.iy=s.iy and l.iz=s.iz""")
def surfel_geometry(spark, sf):
    nodes = octree.roll_up(octree.leaf_moments(octree.with_keys(load(spark, sf, "scene_points"), P)), P.layers(), P)
    df = octree.surfel_geometry(nodes, P).drop("tx", "ty", "tz")
    return rounded(df.withColumn("depth", F.col("depth").cast("bigint")), ["mx", "my", "mz"])


@query("points_under_nodes", """select k.scan_id, k.pid, k.ix, k.iy, k.iz from scene_keys k join scene_surfels s
  on k.scan_id=s.scan_id and k.ix=s.ix and k.iy=s.iy and k.iz=s.iz where s.stable and k.surf <> 3""")
def points_under_nodes(spark, sf):
    points = load(spark, sf, "scene_points")
    keyed = octree.with_keys(points, P)
    nodes = octree.build(points, P, [LAYER]).filter("stable")
    taken = points.filter("surf = 3")
    df = octree.points_under(nodes, keyed, LAYER, free_of=taken, keep=["stable"])
    return df.select("scan_id", "pid", "ix", "iy", "iz")
