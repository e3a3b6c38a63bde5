"""Scene views over the driver's tables, as SQL that Spark and DuckDB both run."""

# scene geometry is known by construction: floor, two walls, a cylinder and noise
SCENE = """select pid, scan_id, surf,
  case surf when 0 then u when 1 then 1.6e0+e when 2 then u when 3 then 0.3e0+(0.3e0+e)*cos(th) else u*1.5e0 end as x,
  case surf when 0 then v when 1 then u when 2 then 1.6e0+e when 3 then -0.2e0+(0.3e0+e)*sin(th) else v*1.5e0 end as y,
  case surf when 0 then -0.9e0+e when 1 then v when 2 then v when 3 then v else w*1.5e0 end as z
from (
  select o_orderkey as pid, o_orderkey % 2 as scan_id, cast(substr(o_orderpriority,1,1) as int)-1 as surf,
    ((o_orderkey*7919)%2003)/1001.5e0-1.0e0 as u, ((o_orderkey*104729)%1999)/999.5e0-1.0e0 as v,
    ((o_orderkey*15485863)%997)/498.5e0-1.0e0 as w, (((o_orderkey*611953)%401)/200.5e0-1.0e0)*0.005e0 as e,
    6.283185307179586e0*((o_orderkey*7919)%2003)/2003.0e0 as th
  from orders) t"""

RAW = """select pid, scan_id,
  case when pid % 97 = 0 then cast('NaN' as double) else x end as x, y,
  case when pid % 89 = 0 then cast('Infinity' as double) when pid % 83 = 0 then 25.0e0 else z end as z
from scene_points"""

COLORED = """select pid, scan_id, surf, x, y, z,
  ((pid*31)%256)*65536 + ((pid*57)%256)*256 + (pid*91)%256 as rgb, ((pid*13)%101)/100.0e0 as intensity
from scene_points"""

RANGE_IMAGE = """select cast(floor(o_orderkey/262144e0) as bigint) as image_id,
  cast(floor(o_orderkey/512e0) as bigint) % 512 as r, o_orderkey % 512 as c,
  (o_orderkey*7919)%256 as v
from orders"""

LABELS = """select scan_id as image_id, cast(floor(floor(pid/2e0)/128e0) as bigint) as r,
  cast(floor(pid/2e0) as bigint) % 128 as c,
  case surf when 0 then 10 when 1 then 11 when 2 then 12 when 3 then 13 else case when x <= 0 then 14 else 0 end end as gt,
  case surf when 0 then case when x < 0 then 10 else 11 end when 1 then 12 when 2 then 12 when 3 then 13
    else case when x > 0 then 14 else 0 end end as ms
from scene_points"""

TRUE_PLANES = """select * from (values (0, 0.0e0, 0.0e0, -1.0e0, 0.9e0), (1, 1.0e0, 0.0e0, 0.0e0, 1.6e0),
  (2, 0.0e0, 1.0e0, 0.0e0, 1.6e0)) t(plane_id, nx, ny, nz, d)"""

TRUE_CYLINDERS = """select * from (values (3, 0.3e0, -0.2e0, 0.0e0, 0.0e0, 0.0e0, 1.0e0, 0.3e0))
  t(cylinder_id, px, py, pz, ax, ay, az, radius)"""

GT_ANGLES = """select * from (values (0, 10, 13, 90.0e0), (0, 11, 13, 120.0e0), (1, 10, 13, 90.0e0),
  (1, 13, 13, 0.0e0)) t(image_id, region1, region2, deg)"""

MS_NORMALS = """select * from (values (0, 12, 1.0e0, 0.0e0, 0.0e0), (0, 13, 0.6e0, 0.8e0, 0.0e0),
  (1, 13, 0.0e0, 0.0e0, -1.0e0)) t(image_id, region, nx, ny, nz)"""

PLANE_POINTS = "select scan_id, surf as plane_id, pid, x, y, z from scene_points where surf < 3"

STREAM = """select event_id as pid, ts, user_id % 4 as scan_id, (user_id % 50)/25.0e0-1.0e0 as x,
  (event_id % 64)/32.0e0-1.0e0 as y, least(value, 200.0e0)/100.0e0-1.0e0 as z
from events"""

BIG = """select l_partkey % 8 as scan_id, l_quantity/5.0e0 as x, l_extendedprice/10500.0e0 as y,
  (l_suppkey % 100)/10.0e0 as z from lineitem"""

VIEWS = {
    "scene_points": SCENE, "raw_points": RAW, "colored_points": COLORED, "range_image": RANGE_IMAGE,
    "label_pixels": LABELS, "true_planes": TRUE_PLANES, "true_cylinders": TRUE_CYLINDERS,
    "gt_angles": GT_ANGLES, "ms_normals": MS_NORMALS, "plane_points": PLANE_POINTS,
    "stream_points": STREAM, "big_points": BIG,
}

# Which table or view each view reads.
READS = {
    "scene_points": "orders", "raw_points": "scene_points", "colored_points": "scene_points",
    "range_image": "orders", "label_pixels": "scene_points", "plane_points": "scene_points",
    "stream_points": "events", "big_points": "lineitem",
}


def load(spark, sf_dir: str, view: str):
    """A view as a Spark DataFrame over the Parquet tables in ``sf_dir``."""
    source = READS.get(view)
    if source is None:
        return spark.sql(VIEWS[view])
    inner = load(spark, sf_dir, source) if source in VIEWS else spark.read.parquet(f"{sf_dir}/{source}.parquet")
    text = VIEWS[view].replace(f"from {source}", "from {src}")
    return spark.sql(text, src=inner)
