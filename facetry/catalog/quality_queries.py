"""Evaluation, assignment tables, label images, whole extractions and the stream query."""

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assign, evaluate, octree
from ..params import SegParams
from ..plans import pipeline
from ..session import shared_folder
from ..sinks import tables
from ..streaming import streams
from .common import P, r, rounded, rs
from .registry import part, query
from .structure_queries import FOUND_PLANES, found_planes, found_surfaces
from .views import STREAM, load

T = 0.8
part("overlap", "select cast(image_id as bigint) as image_id, ms, gt, count(*) as pixels from label_pixels group by all")
part("ratios", """select *, cast(pixels as double)/gt_size as gs, cast(pixels as double)/ms_size as mshare from (select *, sum(pixels) over (partition by image_id, gt) as gt_size,
  sum(pixels) over (partition by image_id, ms) as ms_size from overlap) t where gt >= 10 and ms >= 10""")
part("pair_ok", "select image_id, gt, ms, gs as c1, mshare as c2 from ratios where gs >= 0.8e0 and mshare >= 0.8e0")
part("over_ok", """select * from (select image_id, gt, sum(pixels)/cast(max(gt_size) as double) as o1, sum(pixels)/cast(sum(ms_size) as double) as o2, count(*) as k
  from ratios where mshare >= 0.8e0 group by all) t where k > 1 and o1 >= 0.8e0 and o2 >= 0.8e0""")
part("under_ok", """select * from (select image_id, ms, sum(pixels)/cast(sum(gt_size) as double) as u1, sum(pixels)/cast(max(ms_size) as double) as u2, count(*) as k
  from ratios where gs >= 0.8e0 group by all) t where k > 1 and u1 >= 0.8e0 and u2 >= 0.8e0""")
part("gt_list", "select image_id, gt, cast(sum(pixels) as bigint) as size from overlap where gt >= 10 group by all")
part("ms_list", "select image_id, ms, cast(sum(pixels) as bigint) as size from overlap where ms >= 10 group by all")
part("gt_over", """select l.image_id, l.gt, l.size, c.ms as c_ms, c1, c2, o1, o2, o1 is not null and (c1 is null or (o1+o2)/2e0 > (c1+c2)/2e0) as ow
  from gt_list l left join pair_ok c on c.image_id=l.image_id and c.gt=l.gt left join over_ok o on o.image_id=l.image_id and o.gt=l.gt""")
part("ms_over", """select l.image_id, l.ms, l.size, c.gt as c_gt, c.c1, c.c2, g.gt as o_gt, g.o1, g.o2 from ms_list l left join pair_ok c on c.image_id=l.image_id and c.ms=l.ms
  left join ratios s on s.image_id=l.image_id and s.ms=l.ms and s.mshare >= 0.8e0 left join gt_over g on g.image_id=s.image_id and g.gt=s.gt and g.ow""")
part("ms_class", """select m.*, u1, u2, u1 is not null and (coalesce(o1,c1) is null or (u1+u2)/2e0 > (coalesce(o1,c1)+coalesce(o2,c2))/2e0) as uw from ms_over m
  left join under_ok u on u.image_id=m.image_id and u.ms=m.ms""")
part("gt_class", """select g.*, w.ms as u_ms, w.u1, w.u2 from gt_over g left join ratios s on s.image_id=g.image_id and s.gt=g.gt and s.gs >= 0.8e0
  left join ms_class w on w.image_id=s.image_id and w.ms=s.ms and w.uw""")
part("gt_final", """select image_id, gt, size, case when u1 is not null then 'under' when ow then 'over' when c1 is not null then 'correct' else 'missed' end as class,
  case when u1 is not null then u_ms when ow then null else c_ms end as partner, case when u1 is not null then u1 when ow then o1 else c1 end as m1,
  case when u1 is not null then u2 when ow then o2 else c2 end as m2 from gt_class""")
part("ms_final", """select image_id, ms, size, case when uw then 'under' when o1 is not null then 'over' when c1 is not null then 'correct' else 'noise' end as class,
  case when uw then u1 else coalesce(o1,c1) end as m1, case when uw then u2 else coalesce(o2,c2) end as m2 from ms_class""")


def overlap(spark, sf):
    d = evaluate.overlap_table(load(spark, sf, "label_pixels"))
    return d.withColumn("image_id", F.col("image_id").cast("bigint"))


def classes(spark, sf):
    return evaluate.classify(overlap(spark, sf), T)


@query("overlap_table", "select image_id, cast(ms as bigint) as ms, cast(gt as bigint) as gt, pixels from overlap")
def overlap_table(spark, sf):
    d = overlap(spark, sf)
    return d.withColumns({c: F.col(c).cast("bigint") for c in ("ms", "gt")})


@query("region_classes", """select image_id, 'gt' as side, cast(gt as bigint) as region, size, class, round(m1,6)+0.0e0 as m1, round(m2,6)+0.0e0 as m2 from gt_final
  union all select image_id, 'ms', cast(ms as bigint), size, class, round(m1,6)+0.0e0, round(m2,6)+0.0e0 from ms_final""")
def region_classes(spark, sf):
    g, m = classes(spark, sf)
    rows = [d.select("image_id", F.lit(s).alias("side"), F.col(s).cast("bigint").alias("region"), "size", "class",
                     r("m1", 6).alias("m1"), r("m2", 6).alias("m2")) for d, s in ((g, "gt"), (m, "ms"))]
    return rows[0].unionByName(rows[1])


@query("comparison_report", """select image_id, class, cast(gt as varchar) as gt_labels, coalesce(case when class = 'correct' then cast(partner as varchar) when class = 'over' then
    (select string_agg(cast(ms as varchar), ',' order by ms) from ratios q where q.image_id=g.image_id and q.gt=g.gt and q.mshare >= 0.8e0) end, '') as ms_labels
  from gt_final g where class <> 'under' union all select image_id, class, coalesce(case when class = 'under' then (select string_agg(cast(gt as varchar), ',' order by gt)
    from ratios q where q.image_id=m.image_id and q.ms=m.ms and q.gs >= 0.8e0) end, ''), cast(ms as varchar) from ms_final m where class in ('under', 'noise')""")
def comparison_report(spark, sf):
    g, m = classes(spark, sf)
    d = evaluate.report(g, m, overlap(spark, sf), T)
    return d.selectExpr("image_id", "class", *(f"array_join(cast({c} as array<string>), ',') as {c}" for c in ("gt_labels", "ms_labels")))


part("angle_rows", """select a.image_id, a.region1, a.region2, abs(case when a.deg > 90e0 then abs(a.deg-180e0) else a.deg end -
  case when abs(arc) < 1e0 then degrees(acos(abs(arc))) when arc >= 1e0 then 0e0 else 180e0 end) as err from (
  select a.*, (n.nx*k.nx+n.ny*k.ny+n.nz*k.nz)/(sqrt(n.nx*n.nx+n.ny*n.ny+n.nz*n.nz)*sqrt(k.nx*k.nx+k.ny*k.ny+k.nz*k.nz)) as arc from gt_angles a
  join gt_final g on g.image_id=a.image_id and g.gt=a.region1 and g.class='correct' join gt_final h on h.image_id=a.image_id and h.gt=a.region2 and h.class='correct'
  join ms_normals n on n.image_id=a.image_id and n.region=g.partner join ms_normals k on k.image_id=a.image_id and k.region=h.partner) a""")


@query("angle_errors", "select cast(image_id as bigint) as image_id, count(*) as angles, round(avg(err),4)+0.0e0 as mean_error, round(stddev_pop(err),4)+0.0e0 as std_error from angle_rows group by image_id")
def angle_errors(spark, sf):
    g, _ = classes(spark, sf)
    e = evaluate.angle_errors(g, load(spark, sf, "gt_angles"), load(spark, sf, "ms_normals"))
    d = evaluate.angle_summary(e).withColumn("image_id", F.col("image_id").cast("bigint"))
    return rounded(d, ["mean_error", "std_error"])


COUNTS = "gt_regions correct over under missed noise"
part("per_image", """select g.image_id, gt_regions, correct, over_, missed, coalesce(under_,0) as under_, coalesce(noise,0) as noise, gt_pixels, coalesce(correct_pixels,0) as correct_pixels,
  coalesce(wrong,0) as wrong from (select image_id, count(*) as gt_regions, sum(cast(class='correct' as int)) as correct, sum(cast(class='over' as int)) as over_,
    sum(cast(class='missed' as int)) as missed from gt_final group by image_id) g
  left join (select image_id, sum(cast(class='under' as int)) as under_, sum(cast(class='noise' as int)) as noise from ms_final group by image_id) m on m.image_id=g.image_id
  left join (select image_id, sum(size) as gt_pixels from gt_list group by image_id) p on p.image_id=g.image_id
  left join (select image_id, sum(pixels) as correct_pixels, sum(ms_size-pixels) as wrong from ratios where gs >= 0.8e0 and mshare >= 0.8e0 group by image_id) c on c.image_id=g.image_id""")


@query("sequence_averages", """select count(*) as images, round(avg(gt_regions),4)+0.0e0 as gt_regions, round(avg(correct),4)+0.0e0 as correct, round(avg(over_),4)+0.0e0 as over,
  round(avg(under_),4)+0.0e0 as under, round(avg(missed),4)+0.0e0 as missed, round(avg(noise),4)+0.0e0 as noise, round(avg(correct_pixels),4)+0.0e0 as correct_pixels,
  round(avg(gt_pixels),4)+0.0e0 as gt_pixels, round(100e0*sum(correct_pixels)/sum(gt_pixels),4)+0.0e0 as percent, round(avg(gt_pixels-correct_pixels),4)+0.0e0 as missed_pixels,
  round(avg(wrong),4)+0.0e0 as wrong_ms_pixels, round(avg(a.mean_error),4)+0.0e0 as mean_error, round(avg(a.std_error),4)+0.0e0 as std_error from per_image p
  left join (select image_id, avg(err) as mean_error, stddev_pop(err) as std_error from angle_rows group by image_id) a on a.image_id=p.image_id""")
def sequence_averages(spark, sf):
    g, m = classes(spark, sf)
    angles = evaluate.angle_summary(evaluate.angle_errors(g, load(spark, sf, "gt_angles"), load(spark, sf, "ms_normals")))
    d = evaluate.sequence_averages(evaluate.image_scores(g, m, evaluate.correct_pixels(overlap(spark, sf), T), angles))
    return rounded(d, [c for c in d.columns if c != "images"])


@query("label_validation", """select cast(image_id as bigint) as image_id, count(distinct case when gt >= 10 then gt end) as regions, cast(max(case when gt >= 10 then gt end) as bigint) as top_label,
  count(distinct case when gt < 10 and gt not in (0,1,2,3) then gt end) as bad_noise, max(gt)-9 = count(distinct case when gt >= 10 then gt end) as consecutive,
  count(distinct case when gt >= 10 then gt end) = 0 as empty from label_pixels group by 1""")
def label_validation(spark, sf):
    d = evaluate.validate(load(spark, sf, "label_pixels"), "gt")
    return d.withColumns({c: F.col(c).cast("bigint") for c in ("image_id", "top_label")})


@query("region_borders", """select cast(p.image_id as bigint) as image_id, p.r, p.c, cast(p.gt as bigint) as label from label_pixels p where p.gt >= 10 and exists (
  select 1 from label_pixels q where q.image_id=p.image_id and abs(q.r-p.r)+abs(q.c-p.c) = 1 and q.gt <> p.gt)""")
def region_borders(spark, sf):
    d = load(spark, sf, "label_pixels").selectExpr("bigint(image_id) as image_id", "r", "c", "bigint(gt) as label")
    return evaluate.borders(d)


part("class_codes", """select cast(p.image_id as bigint) as image_id, p.r, p.c, (exists (select 1 from label_pixels q where q.image_id=p.image_id and abs(q.r-p.r)+abs(q.c-p.c) = 1
  and q.gt <> p.gt)) and p.gt >= 10 as border, case when p.gt < 10 then 'noise pixel' else g.class end as class,
  case when p.gt < 10 then 0 when g.class = 'correct' then 1 when g.class = 'over' then 2 when g.class = 'under' then 3 when g.class = 'missed' then 5 end as code
  from label_pixels p left join gt_final g on g.image_id=p.image_id and g.gt=p.gt""")


@query("class_image", """select p.image_id, p.r, p.c, p.border, p.class, count(s.code) as value from class_codes p
  left join (select distinct image_id, code from class_codes) s on s.image_id=p.image_id and s.code < case when p.border then 6 else p.code end group by all""")
def class_image(spark, sf):
    px = load(spark, sf, "label_pixels").selectExpr("bigint(image_id) as image_id", "r", "c", "bigint(gt) as gt")
    g, _ = classes(spark, sf)
    g = g.withColumn("gt", F.col("gt").cast("bigint"))
    d = evaluate.class_image(px, g, "gt").join(px, ["image_id", "r", "c"]).join(g.select("image_id", "gt", "class"), ["image_id", "gt"], "left")
    return d.select("image_id", "r", "c", "border", F.coalesce("class", F.lit("noise pixel")).alias("class"), "value")


@query("region_centroids", """select cast(image_id as bigint) as image_id, cast(gt as bigint) as gt, cast(sum(r)//count(*) as bigint) as centre_r, cast(sum(c)//count(*) as bigint) as centre_c,
  count(*) as pixels from label_pixels where gt >= 10 group by 1, 2""")
def region_centroids(spark, sf):
    return evaluate.region_centroids(load(spark, sf, "label_pixels").selectExpr("bigint(image_id) as image_id", "r", "c", "bigint(gt) as gt"), "gt")


# the structure number painted as a colour, black and white among them
part("painted", """select cast(image_id as bigint) as image_id, r, c, case gt when 0 then 0 when 10 then 16777215 else gt*1000+cast(image_id as bigint) end as rgb from label_pixels""")


@query("relabel_colors", """select p.image_id, p.r, p.c, cast(case p.rgb when 0 then 0 when 16777215 then 1 else k.label end as bigint) as label from painted p left join (
  select image_id, rgb, row_number() over (partition by image_id order by f)+9 as label from (select image_id, rgb, min(r*128+c) as f from painted where rgb not in (0, 16777215)
  group by image_id, rgb) t) k on k.image_id=p.image_id and k.rgb=p.rgb""")
def relabel_colors(spark, sf):
    px = load(spark, sf, "label_pixels").selectExpr("bigint(image_id) as image_id", "r", "c",
                                                    "case gt when 0 then 0L when 10 then 16777215L else gt*1000L + image_id end as rgb")
    return evaluate.colour_labels(px, 128).select("image_id", "r", "c", "label")


# assignment tables: structures 0..2 are planes, 3 the cylinder, 4 stays unsegmented
part("owned", "select scan_id, pid, surf as structure_id from scene_points where surf < 4")


def owned(spark, sf):
    return load(spark, sf, "scene_points").filter("surf < 4").selectExpr("scan_id", "pid", "surf as structure_id")


@query("assignment_update", """select o.scan_id, o.pid, cast(o.structure_id as bigint) as old_id, cast(3 as bigint) as new_id from owned o join scene_points p on p.scan_id=o.scan_id and p.pid=o.pid
  where p.z > 0.5e0 and o.structure_id <> 3 union all select scan_id, pid, null, 3 from scene_points where z > 0.5e0 and surf = 4""")
def assignment_update(spark, sf):
    high = load(spark, sf, "scene_points").filter("z > 0.5").selectExpr("scan_id", "pid", "3 as structure_id")
    _, changed = assign.update(owned(spark, sf), high)
    return changed.select("scan_id", "pid", F.col("old_id").cast("bigint").alias("old_id"), F.col("new_id").cast("bigint").alias("new_id"))


part("double_claims", "select scan_id, pid, structure_id, 1 as turn from owned union all select scan_id, pid, 9, 2 from scene_points where z > 0.5e0")


@query("duplicate_claims", """select scan_id, pid, count(*) as claims, cast(max(case when turn=2 then structure_id end) as bigint) as winner from double_claims group by all having count(*) > 1""")
def duplicate_claims(spark, sf):
    late = load(spark, sf, "scene_points").filter("z > 0.5").selectExpr("scan_id", "pid", "9 as structure_id", "2 as turn")
    rows = owned(spark, sf).withColumn("turn", F.lit(1)).unionByName(late)
    final, overlaps = assign.rebuild(rows, "turn")
    return overlaps.join(final, ["scan_id", "pid"]).select("scan_id", "pid", "claims", F.col("structure_id").cast("bigint").alias("winner"))


@query("merged_members", "select scan_id, cast(case when structure_id in (0, 1) then 0 else structure_id end as bigint) as structure_id, count(*) as members from owned group by 1, 2")
def merged_members(spark, sf):
    rows = owned(spark, sf)
    groups = rows.select("scan_id", "structure_id").distinct().withColumn("group_id", F.expr("if(structure_id in (0, 1), 0, structure_id)"))
    return assign.merge_members(rows, groups).groupBy("scan_id", F.col("structure_id").cast("bigint").alias("structure_id")).agg(F.count("*").alias("members"))


@query("dense_ids", """select scan_id, cast(structure_id as bigint) as structure_id, members, row_number() over (partition by scan_id order by members desc, structure_id)+9 as label
  from (select scan_id, structure_id, count(*) as members from owned group by all) t""")
def dense_ids(spark, sf):
    d = owned(spark, sf).groupBy("scan_id", F.col("structure_id").cast("bigint").alias("structure_id")).agg(F.count("*").alias("members"))
    return assign.dense_labels(d, [F.col("members").desc(), "structure_id"])


@query("segment_summary", """select s.scan_id, count(*) as points, count(o.structure_id) as segmented, count(*)-count(o.structure_id) as unsegmented, max(coalesce(u.k, 0)) as undefined
  from scene_points s left join owned o on o.scan_id=s.scan_id and o.pid=s.pid
  left join (select scan_id, count(*) as k from raw_points where isnan(x) or isinf(z) or z >= 20e0 group by scan_id) u on u.scan_id=s.scan_id group by s.scan_id""")
def segment_summary(spark, sf):
    from ..operators import clean
    _, lost = clean.split_valid(load(spark, sf, "raw_points"), 20.0, -20.0)
    return assign.summary(load(spark, sf, "scene_points"), owned(spark, sf), lost)


PIXELS = "bigint(scan_id) as image_id", "pid div 256 as r", "pid % 256 as c", "pid"


@query("label_image", """select scan_id as image_id, s.pid // 256 as r, s.pid % 256 as c, case when surf < 4 then cast(surf as bigint)+10 else 0 end as label from scene_points s""")
def label_image(spark, sf):
    rows = owned(spark, sf)
    px = load(spark, sf, "scene_points").selectExpr(*PIXELS)
    return tables.label_image(px, rows, rows.select("scan_id", "structure_id").distinct())


@query("segmented_cloud", """select scan_id, pid, cast(case surf when 0 then 255 when 1 then 127 when 3 then 127 else 0 end as bigint) as red,
  cast(case when surf in (1, 2) then 255 else 0 end as bigint) as green, cast(case when surf in (2, 3) then 255 else 0 end as bigint) as blue, round(x,6)+0.0e0 as x, round(y,6)+0.0e0 as y, round(z,6)+0.0e0 as z from scene_points""")
def segmented_cloud(spark, sf):
    rows = owned(spark, sf)
    d = tables.segmented_cloud(load(spark, sf, "scene_points"), rows, rows.select("scan_id", "structure_id").distinct())
    d = d.selectExpr("scan_id", "pid", "shiftright(rgb, 16) & 255 as red", "shiftright(rgb, 8) & 255 as green", "rgb & 255 as blue", "x", "y", "z")
    return rounded(d, "xyz", 6)


@query("unsegmented", "select scan_id, pid from scene_points where surf = 4")
def unsegmented(spark, sf):
    return tables.unsegmented(load(spark, sf, "scene_points"), owned(spark, sf)).select("scan_id", "pid")


@query("chunked_points", """select scan_id, chunk, count(*) as size, min(pid) as first_pid, max(pid) as last_pid from (select scan_id, pid,
  (row_number() over (partition by scan_id order by pid)-1)//100 as chunk from scene_points) t group by all""")
def chunked_points(spark, sf):
    d = tables.chunks(load(spark, sf, "scene_points").select("scan_id", "pid", "x", "y", "z"))
    return d.selectExpr("scan_id", "chunk", "size", "points[0].pid as first_pid", "points[cast(size as int) - 1].pid as last_pid")


@query("bulk_moments", """select scan_id, cast(floor((x+16e0)/0.5e0) as bigint) as ix, cast(floor((y+16e0)/0.5e0) as bigint) as iy, cast(floor((z+16e0)/0.5e0) as bigint) as iz,
  count(*) as n, round(sum(x*z),2)+0.0e0 as sxz from big_points group by 1,2,3,4""")
def bulk_moments(spark, sf):
    p = SegParams(rho_max=16.0, min_octree_resolution=0.5, sq_dist_factor=-1.0)
    d = octree.leaf_moments(octree.with_keys(load(spark, sf, "big_points"), p))
    return d.select("scan_id", F.col("lx").alias("ix"), F.col("ly").alias("iy"), F.col("lz").alias("iz"), "n", r("sxz", 2).alias("sxz"))


STREAM_P = SegParams(rho_max=4.0, min_octree_resolution=0.25, sq_dist_factor=-1.0)
S = "sx sy sz sxx sxy sxz syy syz szz"


@query("stream_moments", f"""select day, scan_id, ix, iy, iz, n, {rs(S, 9)} from (select strftime(ts, '%Y-%m-%d') as day, scan_id, cast(floor((x+4e0)/0.25e0) as bigint) as ix,
  cast(floor((y+4e0)/0.25e0) as bigint) as iy, cast(floor((z+4e0)/0.25e0) as bigint) as iz, count(*) as n, sum(x) as sx, sum(y) as sy, sum(z) as sz, sum(x*x) as sxx, sum(x*y) as sxy,
  sum(x*z) as sxz, sum(y*y) as syy, sum(y*z) as syz, sum(z*z) as szz from stream_points group by 1,2,3,4,5) t""")
def stream_moments(spark, sf):
    arriving = streams.point_stream(spark, sf, spark.read.parquet(f"{sf}/events.parquet").schema, name="events.parquet")
    points = spark.sql(STREAM.replace("from events", "from {events}"), events=arriving)
    d = streams.drained(points, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", STREAM_P)
    d = d.selectExpr("date_format(w.start, 'yyyy-MM-dd') as day", "scan_id", "lx as ix", "ly as iy", "lz as iz", "n", *S.split())
    return rounded(d, S.split(), 9)


# one layer without retries, for quick checks
EXTRACT = P.but(only_depth=P.depth, tries_on_each_depth=0, min_octree_nodes=8, min_nodes_in_cc=3)

# all layers, published number of tries, merge, spread and merge again
WHOLE = P.but(tries_on_each_depth=SegParams().tries_on_each_depth, post_processing=7)


def whole_planes(spark, sf, p: SegParams, share: float = 0.9) -> DataFrame:
    pts = load(spark, sf, "scene_points")
    seg = pipeline.segment_planes(pts, p)
    owned_by = None if seg.assignment is None else seg.assignment.withColumnRenamed("structure_id", "plane_id")
    return found_planes(pts, owned_by, seg.structures, share)


@query("extract_planes", FOUND_PLANES)
def extract_planes(spark, sf):
    return whole_planes(spark, sf, WHOLE)


@query("extract_planes_threshold_fit", """select s.scan_id, cast(t.plane_id as bigint) as surface, count(*) as points, true as found, true as agrees
  from scene_points s join true_planes t on s.surf = t.plane_id group by all""")
def extract_planes_threshold_fit(spark, sf):
    """Without the consensus step a hypothesis keeps its direction bin and its points within the vote distance.

    So a found plane is only near the true one: within the limits by which a fit is accepted.
    """
    got = whole_planes(spark, sf, WHOLE.but(no_ransac_step=True, post_processing=0), 0.6)
    true = load(spark, sf, "true_planes").selectExpr("cast(plane_id as bigint) as surface", "nx as tx", "ny as ty", "nz as tz", "d as td")
    agrees = (F.expr("abs(nx*tx + ny*ty + nz*tz)") > math.cos(2 * P.angle_eps)) & (F.expr("abs(d - td)") < 2 * P.max_ht_distance)
    return got.join(true, "surface").select("scan_id", "surface", "points", "found", F.coalesce(agrees, F.lit(False)).alias("agrees"))


@query("extract_cylinders", """select scan_id, cast(surf as bigint) as surface, count(*) as points, true as found, true as agrees
  from scene_points where surf = 3 group by 1, 2""")
def extract_cylinders(spark, sf):
    """All layers with the published tries and hypotheses: the true cylinder and its shape in each scan."""
    p = WHOLE.but(min_octree_nodes=8, min_nodes_in_cc=3, min_nodes_in_cylinder=12, max_cylinder_radius=0.6, occupied_ratio=0.1)
    pts = load(spark, sf, "scene_points")
    seg = pipeline.segment_cylinders(pts, p)
    if seg.structures is None:
        return pts.filter("surf = 3").groupBy("scan_id", F.expr("cast(surf as bigint) as surface")).agg(
            F.count("*").alias("points"), F.lit(False).alias("found"), F.lit(False).alias("agrees"))
    got = found_surfaces(pts, seg.assignment.withColumnRenamed("structure_id", "cylinder_id"), "cylinder_id", "surf = 3", 0.6)
    true = load(spark, sf, "true_cylinders").selectExpr("cast(cylinder_id as bigint) as surface", "px as tx", "py as ty", "radius as tr")
    # the true axis is parallel to z, so its distance is that in x and y at the height 0
    near = (F.abs("az") > math.cos(P.angle_eps)) & (F.hypot(F.expr("px - pz*ax/az - tx"), F.expr("py - pz*ay/az - ty")) < 2 * F.col("thr")) & (
        F.abs(F.col("radius") - F.col("tr")) < 2 * F.col("thr"))
    good = seg.structures.withColumn("surface", F.lit(3).cast("bigint")).join(true, "surface").filter(near).select("scan_id", "surface").distinct()
    return got.join(good.withColumn("agrees", F.lit(True)), ["scan_id", "surface"], "left").fillna(False, ["agrees"])
