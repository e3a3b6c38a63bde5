"""Orientation votes, histograms, detection rounds."""

import math

from pyspark.sql import functions as F

from ..operators import hist, octree, sphere
from ..plans import cylinders as cyl_plan
from ..plans import planes as plane_plan
from .common import LAYER, P, r, rounded, rs
from .registry import part, query
from ..session import stage
from .views import load

R, EPS = P.phi_resolution, P.angle_eps
_rows = ", ".join(f"({i}, {j}, {x!r}e0, {y!r}e0, {z!r}e0)".replace("e-05e0", "e-5").replace("e-17e0", "e-17").replace("e-16e0", "e-16")
                  for i, j, x, y, z in sphere.bin_rows(R))
part("sphere_bins", f"select cast(bi as bigint) as bi, cast(bj as bigint) as bj, bx, bjy, bz from (values {_rows}) t(bi, bj, bx, bjy, bz)")
COS = math.cos(EPS)


def vote_part(name: str, source: str, direction: tuple, fold: bool) -> None:
    dx, dy, dz = direction
    dot = f"(b.bx*s.{dx}+b.bjy*s.{dy}+b.bz*s.{dz})"
    side = f"abs{dot}" if fold else dot
    part(name, f"""select s.*, b.bi, b.bj, b.bx, b.bjy, b.bz, s.n*(1e0-s.curv/0.1e0)*least(1e0, greatest(0.001e0,
      (abs{dot}-{COS!r}e0)/{COS!r}e0)) as w from {source} s join sphere_bins b on {side} >= {COS!r}e0""")


part("stable_surfels", "select * from scene_surfels where stable")
vote_part("plane_votes", "stable_surfels", ("nx", "ny", "nz"), True)
part("bin_sums", "select scan_id, bi, bj, bx, bjy, bz, sum(w) as w, count(*) as members from plane_votes group by all")
part("bin_peaks", """select * from (select *, row_number() over (partition by scan_id order by round(w,9) desc, bi, bj) as rn from bin_sums) t
  where rn = 1""")


def stable(spark, sf):
    return octree.build(load(spark, sf, "scene_points"), P, [LAYER]).filter("stable")


def votes(spark, sf):
    return stage(sphere.votes(stable(spark, sf), R, EPS, P.curv_threshold, True))


@query("sphere_bin_index", """select scan_id, ix, iy, iz, bi, cast(floor((case when th < 0e0 then th + 6.283185307179586e0 else th end)/6.283185307179586e0
  *floor(50e0*sin(3.141592653589793e0*bi/25e0)+1.5e0)+0.5e0) as bigint) as bj from (select scan_id, ix, iy, iz, atan2(ny,nx) as th,
  cast(floor(acos(nz)/3.141592653589793e0*25e0+0.5e0) as bigint) as bi from stable_surfels) t""")
def sphere_bin_index(spark, sf):
    d = stable(spark, sf).selectExpr("scan_id", "ix", "iy", "iz", "acos(nz) as phi",
                                     "if(atan2(ny, nx) < 0, atan2(ny, nx) + 2*pi(), atan2(ny, nx)) as theta")
    return sphere.bin_of(d, R).select("scan_id", "ix", "iy", "iz", "bi", "bj")


@query("sphere_votes", "select scan_id, bi, bj, members, round(w,5)+0.0e0 as w from bin_sums")
def sphere_votes(spark, sf):
    return rounded(sphere.bin_weights(votes(spark, sf)).select("scan_id", "bi", "bj", "members", "w"), ["w"], 5)


@query("sphere_peak", "select scan_id, bi, bj, round(bx,6)+0.0e0 as bx, round(bjy,6)+0.0e0 as by, round(bz,6)+0.0e0 as bz, round(w,5)+0.0e0 as w from bin_peaks")
def sphere_peak(spark, sf):
    d = sphere.peak(sphere.bin_weights(votes(spark, sf)))
    return rounded(rounded(d, ["bx", "by", "bz"], 6), ["w"], 5)


part("bin_smooth", f"""select s.scan_id, b.bi, b.bj, sum(s.w) as w from bin_sums s join sphere_bins b
  on abs(s.bx*b.bx+s.bjy*b.bjy+s.bz*b.bz) >= {math.cos(0.2)!r}e0 group by all""")


@query("sphere_peak_smoothed", """select scan_id, bi, bj, round(w,4)+0.0e0 as w from (select *, row_number() over
  (partition by scan_id order by round(w,6) desc, bi, bj) as rn from bin_smooth) t where rn = 1""")
def sphere_peak_smoothed(spark, sf):
    d = sphere.smoothed(sphere.bin_weights(votes(spark, sf)), R, 0.2, True)
    return rounded(sphere.peak(d, digits=6).select("scan_id", "bi", "bj", "w"), ["w"])


part("peak_members", """select v.* from plane_votes v join bin_peaks p on v.scan_id=p.scan_id and v.bi=p.bi and v.bj=p.bj""")


@query("bin_members", "select scan_id, bi, bj, ix, iy, iz, round(w,5)+0.0e0 as w from peak_members")
def bin_members(spark, sf):
    rows = votes(spark, sf)
    d = sphere.members(rows, sphere.peak(sphere.bin_weights(rows)))
    return rounded(d.select("scan_id", "bi", "bj", "ix", "iy", "iz", "w"), ["w"], 5)


@query("members_near", f"select scan_id, bi, bj, ix, iy, iz from plane_votes where abs(bz) >= {math.cos(0.15)!r}e0")
def members_near(spark, sf):
    return sphere.members_near(votes(spark, sf), (0, 0, 1), 0.15, True).select("scan_id", "bi", "bj", "ix", "iy", "iz")


part("mean_normals", "select scan_id, sum(nx*w)/sum(w) as wnx, sum(ny*w)/sum(w) as wny, sum(nz*w)/sum(w) as wnz from peak_members group by scan_id")


@query("weighted_normal", f"select scan_id, {rs('wnx wny wnz', 6)} from mean_normals")
def weighted_normal(spark, sf):
    rows = votes(spark, sf)
    d = sphere.mean_direction(sphere.members(rows, sphere.peak(sphere.bin_weights(rows))))
    return rounded(d, ["wnx", "wny", "wnz"], 6)


@query("vote_removal", """select v.scan_id, v.bi, v.bj, count(*) as members, round(sum(v.w),5)+0.0e0 as w from plane_votes v
  where not exists (select 1 from peak_members m where m.scan_id=v.scan_id and m.ix=v.ix and m.iy=v.iy and m.iz=v.iz) group by all""")
def vote_removal(spark, sf):
    rows = votes(spark, sf)
    gone = sphere.members(rows, sphere.peak(sphere.bin_weights(rows)))
    left = sphere.remove_members(rows, gone, ["scan_id", "depth", "ix", "iy", "iz"])
    return rounded(sphere.bin_weights(left).select("scan_id", "bi", "bj", "members", "w"), ["w"], 5)


@query("orientation_cloud", """select s.scan_id, s.bi, s.bj, round(s.bx*0.1e0+0.5e0,6)+0.0e0 as x, round(s.bjy*0.1e0,6)+0.0e0 as y,
  round(s.bz*0.1e0+0.5e0,6)+0.0e0 as z, cast(floor(255e0*s.w/t.w) as bigint)*65793 as rgb from bin_sums s join bin_peaks t on s.scan_id=t.scan_id""")
def orientation_cloud(spark, sf):
    return rounded(sphere.as_cloud(sphere.bin_weights(votes(spark, sf)), 0.1, (0.5, 0.0, 0.5)), "xyz", 6)


# rho histogram of the peak bin: bins of 0.2 m over +-20 m, kernel half width 0.2 m
part("rho_rows", "select m.*, m.mx*q.wnx+m.my*q.wny+m.mz*q.wnz as rho from peak_members m join mean_normals q on m.scan_id=q.scan_id")
part("rho_votes", """select * from (select r.scan_id, r.ix, r.iy, r.iz, r.bx, r.bjy, r.bz, r.rho, cast(b.bin as bigint) as bin,
  (0.2e0-abs(b.bin*0.2e0-20e0-r.rho))/0.2e0 as rw from rho_rows r
  join (select unnest(range(0, 200)) as bin) b on b.bin between floor((r.rho-0.2e0+20e0)/0.2e0) and ceil((r.rho+0.2e0+20e0)/0.2e0)-1) t where rw > 0e0""")
part("rho_sums", "select scan_id, bin, sum(rw) as w, count(*) as members from rho_votes group by all")
part("rho_peaks", "select * from (select *, row_number() over (partition by scan_id order by round(w,9) desc, bin) as rn from rho_sums) t where rn = 1")


@query("rho_histogram", "select scan_id, bin, members, round(w,5)+0.0e0 as w from rho_sums")
def rho_histogram(spark, sf):
    rows = votes(spark, sf)
    mem = sphere.members(rows, sphere.peak(sphere.bin_weights(rows)))
    d = plane_plan.rho_votes(mem, sphere.mean_direction(mem), P, LAYER)
    return rounded(hist.total(d, ["scan_id"]).select("scan_id", "bin", "members", "w"), ["w"], 5)


@query("plane_hough_round", """select k.scan_id, k.bin, count(*) as nodes, cast(sum(s.n) as bigint) as points,
  round(max(abs(k.bin*0.2e0-20e0)),6)+0.0e0 as d, round(max(case when k.bin*0.2e0-20e0 < 0e0 then -v.bx else v.bx end),6)+0.0e0 as nx,
  round(max(case when k.bin*0.2e0-20e0 < 0e0 then -v.bjy else v.bjy end),6)+0.0e0 as ny,
  round(max(case when k.bin*0.2e0-20e0 < 0e0 then -v.bz else v.bz end),6)+0.0e0 as nz
  from rho_peaks k join rho_votes v on k.scan_id=v.scan_id and k.bin=v.bin
  join stable_surfels s on s.scan_id=v.scan_id and s.ix=v.ix and s.iy=v.iy and s.iz=v.iz group by k.scan_id, k.bin""")
def plane_hough_round(spark, sf):
    hyp, inliers = plane_plan.hough_round(votes(spark, sf), P, LAYER)
    got = inliers.groupBy("scan_id").agg(F.count("*").alias("nodes"), F.sum("n").alias("points"))
    d = hyp.join(got, "scan_id").select("scan_id", "bin", "nodes", "points", "d", "nx", "ny", "nz")
    return rounded(d, ["d", "nx", "ny", "nz"], 6)


# plain histograms
@query("hist_1d", """select scan_id, least(cast(floor((z+1.5e0)/0.25e0) as bigint), 11) as bin, count(*) as n from scene_points
  where z >= -1.5e0 and z <= 1.5e0 group by all""")
def hist_1d(spark, sf):
    return hist.hist_1d(load(spark, sf, "scene_points"), ["scan_id"], "z", -1.5, 1.5, 0.25)


@query("hist_2d", """select scan_id, cast(floor((x+2e0)/0.5e0) as bigint) as bin_x, cast(floor((y+2e0)/0.5e0) as bigint) as bin_y,
  count(*) as n from scene_points group by all""")
def hist_2d(spark, sf):
    return hist.hist_2d(load(spark, sf, "scene_points"), ["scan_id"], "x", "y", -2.0, -2.0, 0.5)


part("tri_votes", """select * from (select p.scan_id, p.pid, cast(b.bin as bigint) as bin, (0.3e0-abs(b.bin*0.25e0-1.5e0-p.z))/0.3e0 as w from scene_points p
  join (select unnest(range(0, 12)) as bin) b on b.bin between floor((p.z-0.3e0+1.5e0)/0.25e0) and ceil((p.z+0.3e0+1.5e0)/0.25e0)-1
  where p.z between -1.5e0 and 1.5e0) t where w > 0e0""")
part("tri_peaks", """select * from (select *, row_number() over (partition by scan_id order by round(w,9) desc, bin) as rn from
  (select scan_id, bin, sum(w) as w from tri_votes group by all) s) t where rn = 1""")


@query("hist_triangle", "select scan_id, bin, count(*) as members, round(sum(w),4)+0.0e0 as w from tri_votes group by scan_id, bin")
def hist_triangle(spark, sf):
    d = load(spark, sf, "scene_points").filter("z between -1.5 and 1.5")
    d = hist.triangle_1d(d, "z", "-1.5D", "0.25D", "12", "0.3D")
    return rounded(hist.total(d, ["scan_id"]), ["w"])


@query("hist_remove", """select scan_id, bin, count(*) as members, round(sum(w),4)+0.0e0 as w from tri_votes v where not exists (
  select 1 from tri_votes o join tri_peaks p on o.scan_id=p.scan_id and o.bin=p.bin where o.scan_id=v.scan_id and o.pid=v.pid) group by scan_id, bin""")
def hist_remove(spark, sf):
    d = load(spark, sf, "scene_points").filter("z between -1.5 and 1.5")
    d = hist.triangle_1d(d, "z", "-1.5D", "0.25D", "12", "0.3D")
    d = hist.drop_members(d, hist.peak(hist.total(d, ["scan_id"]), ["scan_id"]), ["scan_id"], ["pid"])
    return rounded(hist.total(d, ["scan_id"]), ["w"])


part("tri2_votes", """select * from (select p.scan_id, cast(a.bin as bigint) as bin_x, cast(b.bin as bigint) as bin_y,
  (0.3e0-sqrt(pow(a.bin*0.25e0-2e0-p.x,2)+pow(b.bin*0.25e0-2e0-p.y,2)))/0.3e0 as w from scene_points p
  join (select unnest(range(0, 17)) as bin) a on a.bin between floor((p.x-0.3e0+2e0)/0.25e0) and ceil((p.x+0.3e0+2e0)/0.25e0)-1
  join (select unnest(range(0, 17)) as bin) b on b.bin between floor((p.y-0.3e0+2e0)/0.25e0) and ceil((p.y+0.3e0+2e0)/0.25e0)-1) t where w > 0e0""")


@query("hist_triangle_2d", "select scan_id, bin_x, bin_y, count(*) as members, round(sum(w),4)+0.0e0 as w from tri2_votes group by scan_id, bin_x, bin_y")
def hist_triangle_2d(spark, sf):
    d = hist.triangle_2d(load(spark, sf, "scene_points"), "x", "y", "-2D", "-2D", "2D", "2D", "0.25D", "0.3D")
    return rounded(hist.total(d, ["scan_id"], ["bin_x", "bin_y"]), ["w"])


# cylinder votes from pairs; parallel pairs have no axis of their own and are left out here
part("axis_pairs", "select *, cross_x as cx, cross_y as cy, cross_z as cz from node_pair_axes where rn > 1e-2")
vote_part("axis_votes", "axis_pairs", ("cx", "cy", "cz"), False)
part("axis_sums", "select scan_id, bi, bj, bx, bjy, bz, sum(w) as w, count(*) as members from axis_votes group by all")


def axis_votes(spark, sf):
    nodes = stage(octree.build(load(spark, sf, "scene_points"), P, [LAYER]))
    pairs = octree.neighbour_pairs(nodes, P.cylinder_pair_neighbors)
    pairs = pairs.filter("1 - pow(a_nx*b_nx + a_ny*b_ny + a_nz*b_nz, 2) > 1e-4D")
    return stage(sphere.votes(pairs, R, EPS, P.curv_threshold, False, "cross_"))


@query("cylinder_votes", "select scan_id, bi, bj, members, round(w,4)+0.0e0 as w from axis_sums")
def cylinder_votes(spark, sf):
    return rounded(sphere.bin_weights(axis_votes(spark, sf)).select("scan_id", "bi", "bj", "members", "w"), ["w"])


part("axis_peaks", "select * from (select *, row_number() over (partition by scan_id order by round(w,9) desc, bi, bj) as rn from axis_sums) t where rn = 1")
part("axis_members", "select v.* from axis_votes v join axis_peaks p on v.scan_id=p.scan_id and v.bi=p.bi and v.bj=p.bj")
part("axis_mean", """select scan_id, ax/l as ax, ay/l as ay, az/l as az from (select *, sqrt(ax*ax+ay*ay+az*az) as l from (
  select scan_id, sum(cx*w)/sum(w) as ax, sum(cy*w)/sum(w) as ay, sum(cz*w)/sum(w) as az from axis_members group by scan_id) q) t""")
# rotation of the axis onto z, first two rows; the axes of this scene are away from -z
part("axis_frame", """select *, az+ay*ay/(1e0+az) as f00, -ax*ay/(1e0+az) as f01, -ax as f02, -ax*ay/(1e0+az) as f10, az+ax*ax/(1e0+az) as f11, -ay as f12
  from axis_mean""")
part("flat_pairs0", """select m.scan_id, m.a_ix, m.a_iy, m.a_iz, m.b_ix, m.b_iy, m.b_iz,
  f00*amx+f01*amy+f02*amz as pax, f10*amx+f11*amy+f12*amz as pay, f00*bmx+f01*bmy+f02*bmz as pbx, f10*bmx+f11*bmy+f12*bmz as pby,
  f00*anx_+f01*any_+f02*anz_ as nax, f10*anx_+f11*any_+f12*anz_ as nay, f00*bnx_+f01*bny_+f02*bnz_ as nbx, f10*bnx_+f11*bny_+f12*bnz_ as nby
  from axis_members m join axis_frame f on f.scan_id=m.scan_id""")
part("flat_pairs", """select scan_id, a_ix, a_iy, a_iz, b_ix, b_iy, b_iz, pax, pay, pbx, pby, nax/sqrt(nax*nax+nay*nay) as nax, nay/sqrt(nax*nax+nay*nay) as nay,
  nbx/sqrt(nbx*nbx+nby*nby) as nbx, nby/sqrt(nbx*nbx+nby*nby) as nby from flat_pairs0""")
# the normal lines nay*x - nax*y = c, solved by Cramer's rule with the first point as origin
part("flat_meets", """select *, nax*c/nullif(det,0e0)+pax as cx, nay*c/nullif(det,0e0)+pay as cy from (
  select *, nby*(pbx-pax)-nbx*(pby-pay) as c, nax*nby-nay*nbx as det from flat_pairs) t""")
part("flat_circles", """select *, (ra+rb)/2e0 as radius from (
  select *, sqrt(pow(cx-pax,2)+pow(cy-pay,2)) as ra, sqrt(pow(cx-pbx,2)+pow(cy-pby,2)) as rb from flat_meets) t""")


@query("pair_circles", f"""select scan_id, a_ix, a_iy, a_iz, b_ix, b_iy, b_iz, {rs('cx cy radius', 3)} from flat_circles
  where radius >= 0.125e0 and radius <= 2.5e0 and abs(ra-radius) < 0.025e0""")
def pair_circles(spark, sf):
    rows = axis_votes(spark, sf)
    mem = sphere.members(rows, sphere.peak(sphere.bin_weights(rows)))
    d = cyl_plan.circles(mem, sphere.mean_direction(mem, direction="cross_"), P, LAYER)
    cols = [f"{s}_i{a}" for s in "ab" for a in "xyz"]
    return rounded(d.select("scan_id", *cols, "cx", "cy", "radius"), ["cx", "cy", "radius"], 3)


# radius and midpoint histograms of the circles: 30 radius bins, midpoint bins of 0.05 m
_lo, _hi = P.radius_limits(LAYER)
_step = (_hi - _lo) / P.cylinder_bins
_dev = P.radius_dev_factor * _step
_mid = P.ht_distance(LAYER) * P.midpoint_bin_size_factor
_mdev = P.radius_dev_factor * _mid
part("good_circles", f"select * from flat_circles where radius >= {_lo!r}e0 and radius <= {_hi!r}e0 and abs(ra-radius) < {P.sac_distance(LAYER)!r}e0")
part("radius_votes", f"""select * from (select c.*, b.bin, ({_dev!r}e0-abs(b.bin*{_step!r}e0+{_lo!r}e0-c.radius))/{_dev!r}e0 as rw from good_circles c
  join (select unnest(range(0, {P.cylinder_bins})) as bin) b on b.bin between floor((c.radius-{_dev!r}e0-{_lo!r}e0)/{_step!r}e0)
   and ceil((c.radius+{_dev!r}e0-{_lo!r}e0)/{_step!r}e0)-1) t where rw > 0e0""")
part("radius_peaks", """select * from (select *, row_number() over (partition by scan_id order by round(w,9) desc, bin) as rn from
  (select scan_id, bin, sum(rw) as w from radius_votes group by all) s) t where rn = 1""")
part("radius_members", """select v.*, min(v.cx) over (partition by v.scan_id) as x0, max(v.cx) over (partition by v.scan_id) as x1,
  min(v.cy) over (partition by v.scan_id) as y0, max(v.cy) over (partition by v.scan_id) as y1 from radius_votes v
  join radius_peaks p on p.scan_id=v.scan_id and p.bin=v.bin where abs(v.cx) <= 40e0 and abs(v.cy) <= 40e0""")
part("spot_votes", f"""select * from (select m.*, i.k as kx, j.k as ky, ({_mdev!r}e0-sqrt(pow(i.k*{_mid!r}e0+x0-cx,2)+pow(j.k*{_mid!r}e0+y0-cy,2)))/{_mdev!r}e0 as sw
  from radius_members m join (select unnest(range(0, 2000)) as k) i on i.k between floor((cx-{_mdev!r}e0-x0)/{_mid!r}e0) and ceil((cx+{_mdev!r}e0-x0)/{_mid!r}e0)-1
   and i.k <= floor((x1-x0)/{_mid!r}e0)
  join (select unnest(range(0, 2000)) as k) j on j.k between floor((cy-{_mdev!r}e0-y0)/{_mid!r}e0) and ceil((cy+{_mdev!r}e0-y0)/{_mid!r}e0)-1
   and j.k <= floor((y1-y0)/{_mid!r}e0)) t where sw > 0e0""")
part("spot_peaks", """select * from (select *, row_number() over (partition by scan_id order by round(w,9) desc, ky, kx) as rn from
  (select scan_id, bin, kx, ky, x0, y0, sum(sw) as w, count(*) as pairs from spot_votes group by all) s) t where rn = 1""")


@query("cylinder_hough_round", f"""select s.scan_id, s.pairs, round(s.bin*{_step!r}e0+{_lo!r}e0,4)+0.0e0 as radius, {rs('ax ay az', 4)},
  round(f00*(x0+kx*{_mid!r}e0)+f10*(y0+ky*{_mid!r}e0),4)+0.0e0 as px, round(f01*(x0+kx*{_mid!r}e0)+f11*(y0+ky*{_mid!r}e0),4)+0.0e0 as py,
  round(f02*(x0+kx*{_mid!r}e0)+f12*(y0+ky*{_mid!r}e0),4)+0.0e0 as pz from spot_peaks s join axis_frame f on f.scan_id=s.scan_id""")
def cylinder_hough_round(spark, sf):
    hyp, pairs = cyl_plan.hough_round(axis_votes(spark, sf), P.but(min_nodes_in_cylinder=3), LAYER)
    got = pairs.groupBy("scan_id").agg(F.count("*").alias("pairs"))
    return hyp.join(got, "scan_id").select("scan_id", "pairs", r("radius").alias("radius"), *(r("a" + a).alias("a" + a) for a in "xyz"),
                                           *(r("p" + a).alias("p" + a) for a in "xyz"))
