"""Helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import SegParams
from .registry import part

# Parameters of the scene checks (cell 0.25 on the finest layer, 8).
P = SegParams(min_octree_resolution=0.25, sq_dist_factor=-1.0, min_points_in_cc=20,
              tries_on_each_depth=2, max_sac_distance=0.05, min_sac_distance=0.02)
LAYER = P.depth
SIZE = P.cell_size(LAYER)


def r(c: Column | str, digits: int = 4) -> Column:
    """Rounded double without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, names, digits: int = 4) -> DataFrame:
    return df.withColumns({n: r(n, digits) for n in names})


def rs(names: str, digits: int = 4) -> str:
    """The same rounding as SQL for a blank-separated list."""
    return ", ".join(f"round({n}, {digits}) + 0.0e0 as {n}" for n in names.split())


def moments_sql(keys: str, source: str) -> str:
    return f"""select {keys}, count(*) as n, sum(x) as sx, sum(y) as sy, sum(z) as sz, sum(x*x) as sxx,
  sum(x*y) as sxy, sum(x*z) as sxz, sum(y*y) as syy, sum(y*z) as syz, sum(z*z) as szz
from {source} group by {keys}"""


def eigen_parts(name: str, source: str) -> None:
    """Oracle blocks: closed-form eigen solution of moment rows, ending in ``name``."""
    part(f"{name}_a", f"select *, sx/n as mx, sy/n as my, sz/n as mz from {source}")
    part(f"{name}_b", f"""select *, sxx/n-mx*mx as cxx, sxy/n-mx*my as cxy, sxz/n-mx*mz as cxz,
  syy/n-my*my as cyy, syz/n-my*mz as cyz, szz/n-mz*mz as czz from {name}_a""")
    part(f"{name}_c", f"select *, (cxx+cyy+czz)/3e0 as q from {name}_b")
    part(f"{name}_d", f"""select *, sqrt(((cxx-q)*(cxx-q)+(cyy-q)*(cyy-q)+(czz-q)*(czz-q)
  +2e0*(cxy*cxy+cxz*cxz+cyz*cyz))/6e0) as p from {name}_c""")
    part(f"{name}_e", f"""select *, acos(least(greatest(coalesce(((cxx-q)*((cyy-q)*(czz-q)-cyz*cyz)
  -cxy*(cxy*(czz-q)-cyz*cxz)+cxz*(cxy*cyz-(cyy-q)*cxz))/nullif(2e0*p*p*p,0e0),0e0),-1e0),1e0))/3e0 as phi from {name}_d""")
    part(f"{name}_f", f"""select *, q+2e0*p*cos(phi) as l2, q+2e0*p*cos(phi+2.0943951023931953e0) as l0 from {name}_e""")
    part(f"{name}_g", f"""select *, 3e0*q-l0-l2 as l1,
  cxy*cyz-cxz*(cyy-l0) as ux, cxz*cxy-(cxx-l0)*cyz as uy, (cxx-l0)*(cyy-l0)-cxy*cxy as uz,
  cxy*(czz-l0)-cxz*cyz as wx, cxz*cxz-(cxx-l0)*(czz-l0) as wy, (cxx-l0)*cyz-cxy*cxz as wz,
  (cyy-l0)*(czz-l0)-cyz*cyz as tx, cyz*cxz-cxy*(czz-l0) as ty, cxy*cyz-(cyy-l0)*cxz as tz from {name}_f""")
    part(f"{name}_h", f"""select *, sqrt(ux*ux+uy*uy+uz*uz) as un, sqrt(wx*wx+wy*wy+wz*wz) as wn,
  sqrt(tx*tx+ty*ty+tz*tz) as tn from {name}_g""")
    pick = ", ".join(f"""case when un>=wn and un>=tn then u{a}/nullif(un,0e0) when wn>=tn then w{a}/nullif(wn,0e0)
  else t{a}/nullif(tn,0e0) end as e{a}""" for a in "xyz")
    part(name, f"select *, {pick} from {name}_h")


def surfel_parts(name: str, source: str, p: SegParams = P, min_points: int | None = None) -> None:
    """Oracle blocks: surfels of moment rows, ending in ``name``."""
    eigen_parts(f"{name}_eig", source)
    m = min_points or p.min_points_for_normal
    flip = ", ".join(f"case when n>={m} then case when ex*mx+ey*my+ez*mz>0e0 then -e{a} else e{a} end end as n{a}"
                     for a in "xyz")
    part(name, f"""select *, case when n>={m} then l0/nullif(l2,0e0) end as curv,
  case when n>={m} then l1/nullif(l2,0e0) end as curv2, {flip},
  coalesce(n>={m} and l0/nullif(l2,0e0)<={p.curv_threshold!r}e0 and l1/nullif(l2,0e0)>={p.curv2_threshold!r}e0
    and l2>=0e0, false) as stable from {name}_eig""")


# scene points with the key of their cell on the finest layer
part("scene_keys", f"""select *, cast(floor((x+32e0)/{SIZE!r}e0) as bigint) as ix,
  cast(floor((y+32e0)/{SIZE!r}e0) as bigint) as iy, cast(floor((z+32e0)/{SIZE!r}e0) as bigint) as iz from scene_points""")
part("scene_moments", moments_sql("scan_id, ix, iy, iz", "scene_keys"))
surfel_parts("scene_surfels", "scene_moments")


# The three true planes and the true cylinder of the scene, as row generators.
TRUE_PLANES = ("inline(array(struct(0 as plane_id, 0D as nx, 0D as ny, -1D as nz, 0.9D as d),"
               " struct(1 as plane_id, 1D as nx, 0D as ny, 0D as nz, 1.6D as d),"
               " struct(2 as plane_id, 0D as nx, 1D as ny, 0D as nz, 1.6D as d)))")
TRUE_CYLINDER = ("3 as cylinder_id", "0.3D as px", "-0.2D as py", "0D as pz", "0D as ax", "0D as ay", "1D as az",
                 "0.3D as radius")
