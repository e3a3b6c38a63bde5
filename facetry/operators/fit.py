"""Least-squares and robust fits of planes and cylinders, many groups per job.

Robust fits draw a pool of points per group in a seeded hash order, build different
hypotheses from it, and score every hypothesis against every point of the group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import (box_vertices, frame_columns, frame_from, from_frame, rectangle_vertices,
                                  to_frame, to_plane)
from ..functions.moments import SUMS, moment_aggs, with_eigen
from ..functions.vec import V, settle, v
from ..session import stage
from .spatial import _along_curve, _filled


# --- least squares ---------------------------------------------------------

def centroids(points: DataFrame, keys) -> DataFrame:
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(a).alias("c" + a) for a in "xyz"))


def pca_planes(points: DataFrame, keys, min_points: int = 3) -> DataFrame:
    """Plane through the centroid along the smallest principal axis, turned to d >= 0."""
    keys = list(keys)
    return planes_of_moments(points.groupBy(*keys).agg(*moment_aggs()), keys, min_points)


def planes_of_moments(moments: DataFrame, keys, min_points: int = 3) -> DataFrame:
    d = with_eigen(moments.filter(F.col("n") >= min_points)).drop(*SUMS)
    d = d.selectExpr(*keys, "n", "mx as cgx", "my as cgy", "mz as cgz", "ex", "ey", "ez", "l0", "l1", "l2",
                     "ex*mx + ey*my + ez*mz as _d")
    sign = "if(_d < 0, -1D, 1D)"
    return d.filter("_d is not null").selectExpr(
        *keys, "n", *(f"{sign}*e{a} as n{a}" for a in "xyz"), "abs(_d) as d", "cgx", "cgy", "cgz", "l0", "l1", "l2")


def with_frames(planes: DataFrame) -> DataFrame:
    """Nine rotation columns r00..r22 of each plane."""
    return planes.withColumns(frame_columns(v("n")))


def in_plane(points: DataFrame, planes: DataFrame, keys) -> DataFrame:
    """Points with plane coordinates u, v and height w of their plane."""
    need = [*keys, "nx", "ny", "nz", "d", *(f"r{i}{j}" for i in range(3) for j in range(3))]
    side = with_frames(planes) if "r00" not in planes.columns else planes
    d = points.join(side.select(*need), list(keys))
    q = to_plane(v("x", "y", "z"), v("n"), F.col("d"), frame_from())
    return d.withColumns({"u": q[0], "v": q[1], "w": q[2]}).drop(*(c for c in need if c not in keys))


def extents(points: DataFrame, planes: DataFrame, keys) -> DataFrame:
    """Ranges of the members in plane coordinates."""
    return in_plane(points, planes, keys).groupBy(*keys).agg(
        F.count("*").alias("members"), *(f(c).alias(c + n) for c in "uvw" for n, f in (("min", F.min), ("max", F.max))))


def merge_extents(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Extents grown by further points."""
    both = a.unionByName(b)
    return both.groupBy(*keys).agg(F.sum("members").alias("members"), *(
        f(c + n).alias(c + n) for c in "uvw" for n, f in (("min", F.min), ("max", F.max))))


def with_outline(planes: DataFrame) -> DataFrame:
    """Rectangle area, rectangle vertices and box vertices of planes that carry extents."""
    d = planes if "r00" in planes.columns else with_frames(planes)
    n, rows = v("n"), frame_from()
    lo, hi = v("umin", "vmin", "wmin"), v("umax", "vmax", "wmax")
    return d.withColumns({
        "area": (hi[0] - lo[0]) * (hi[1] - lo[1]),
        "rectangle": rectangle_vertices(n, F.col("d"), rows, lo[0], hi[0], lo[1], hi[1]),
        "box": box_vertices(n, F.col("d"), rows, lo, hi)})


def axis_ranges(points: DataFrame, cylinders: DataFrame, keys) -> DataFrame:
    """Axis range, height, top and middle point of each cylinder from its members."""
    side = cylinders.select(*keys, "px", "py", "pz", "ax", "ay", "az").withColumns(frame_columns(v("a")))
    d = points.join(side, list(keys))
    h = to_frame(v("x", "y", "z"), v("p"), frame_from())[2]
    got = d.withColumn("h", h).groupBy(*keys).agg(
        F.count("*").alias("members"), F.min("h").alias("axis_min"), F.max("h").alias("axis_max"))
    return axis_points(got.join(side, list(keys)), keys)


def axis_points(d: DataFrame, keys) -> DataFrame:
    lo, hi, zero = F.col("axis_min"), F.col("axis_max"), F.lit(0.0)
    top = from_frame(V(zero, zero, hi), v("p"), frame_from())
    mid = from_frame(V(zero, zero, (lo + hi) * 0.5), v("p"), frame_from())
    return d.select(*keys, "members", "axis_min", "axis_max", F.abs(hi - lo).alias("height"),
                    *(c.alias("top_" + a) for a, c in zip("xyz", top)), *(c.alias("mid_" + a) for a, c in zip("xyz", mid)))


# --- robust fits -----------------------------------------------------------

# Primes of the draw order. No pool size or number of combinations shares a factor with the first.
STRIDE, SHIFT = 2305843009213693951, 2971215073
POOL_SALTS = 32  # parts of a group that are ranked apart first
BLOCK_POINTS = 40_000  # points of a group that are scored together
SOME = {"plane": 1024, "cylinder": 16, "tiles": 2048}  # hypotheses that are scored together
BOX = 512  # points that a plane meets together
ROUGH = 2e-6  # relative to a box, far above the rounding of its distances in single precision
SLACK = 1e-7  # far above the rounding of an error, so that boxes decide only what the test of each point would
SET_PARTS = 16  # parts into which sets of hypotheses that share a group's points are dealt


def seed_text(seed: int | str) -> str:
    return f"{seed}L" if isinstance(seed, int) else seed


def draw_order(seed: int | str) -> str:
    """Hash of ``pid`` that orders the points of a group; each seed, a number or a key column, gives another order."""
    shift = f"{seed * 40503 % 2147483647}L" if isinstance(seed, int) else f"({seed}*40503L) % 2147483647L"
    return f"((((pid % 2147483647L)*48271L) % 2147483647L + {shift})*69621L) % 2147483629L"


def draw_numbers(pid: np.ndarray, seed: int) -> np.ndarray:
    """``draw_order`` of many points."""
    return np.fmod((np.fmod(np.fmod(pid, 2147483647) * 48271, 2147483647) + seed * 40503 % 2147483647) * 69621, 2147483629)


def sample_pools(points: DataFrame, keys, size: int, extra=(), seed: int | str = 0) -> DataFrame:
    """Per group: its first ``size`` points in draw order, as rows with their ``rank`` from 0.

    Parts of a group are ranked first, so that no task sorts a whole group.
    """
    keys = list(keys)
    order = [F.col("_o"), F.col("pid")]
    rows = points.select(*keys, "pid", "x", "y", "z", *extra, F.expr(draw_order(seed)).alias("_o"))
    rows = rows.withColumn("_s", F.pmod(F.xxhash64("pid"), F.lit(POOL_SALTS)))
    part = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(*order))).filter(F.col("rank") <= size)
    top = part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= size)
    return stage(top.select(*keys, (F.col("rank") - 1).cast("bigint").alias("rank"), "x", "y", "z", *extra))


def shared_pools(points: DataFrame, sets: DataFrame, own, keys, size: int, seed: str) -> DataFrame:
    """``sample_pools`` of groups that share their points: only a few more than ``size`` points of each are copied.

    Points with a low draw number are kept, unless these turn out to be too few; then all of the group are.
    """
    number = points.groupBy(*own).agg(F.count("*").alias("_n"))
    groups = sets.select(*keys).join(number, list(own)).selectExpr(*keys, f"1.1D*{size}*2147483629D/_n as _low")
    copies = points.join(groups, list(own))
    few = copies.filter(f"{draw_order(seed)} < _low").groupBy(*keys).agg(F.count("*").alias("_f"))
    enough = stage(groups.join(few, list(keys), "left").selectExpr(*keys, f"if(coalesce(_f, 0L) >= {size}, _low, double('Infinity')) as _low"))
    return sample_pools(points.join(enough, list(own)).filter(f"{draw_order(seed)} < _low"), keys, size, seed=seed)


def drawn(pool: DataFrame, keys, count: int, width: int, seed: int | str) -> DataFrame:
    """``count`` different combinations of ``width`` (2 or 3) pool points, or all there are: columns k, a, b[, c].

    Combinations are numbered; hypothesis k takes number (k * stride + shift) modulo their count, and the number
    is turned back into positions (combinatorial number system).
    """
    keys = list(keys)
    total = "_n*(_n-1) div 2" if width == 2 else "_n*(_n-1) div 2*(_n-2) div 3"
    d = pool.groupBy(*keys).agg(F.count("*").alias("_n")).filter(f"_n >= {width}").selectExpr(*keys, f"{total} as _c")
    d = d.selectExpr("*", f"explode(sequence(0L, least({count}L, _c) - 1)) as k")
    # every step that uses a number several times starts from a settled one, so that the code stays small
    d = settle(d.selectExpr(*keys, "k", f"(k*({STRIDE}L % _c) + ({seed_text(seed)}*{SHIFT}L) % _c) % _c as _r"), ["_r"], [*keys, "k"])
    if width == 3:
        d = settle(d.selectExpr(*keys, "k", "_r", "cast(floor(cbrt(6D*_r)) as bigint) as _f"), ["_f"], [*keys, "k", "_r"])
        d = d.selectExpr(*keys, "k", "_r", """case when (_f+2)*(_f+1)*_f <= 6*_r then _f+2
            when (_f+1)*_f*(_f-1) <= 6*_r then _f+1 else _f end as _c""")
        d = settle(d, ["_c"], [*keys, "k", "_r"])
        d = settle(d.selectExpr(*keys, "k", "_c", "_r - _c*(_c-1)*(_c-2) div 6 as _r"), ["_r"], [*keys, "k", "_c"])
    d = d.selectExpr("*", "cast(floor(sqrt(2D*_r)) as bigint) as _g")
    d = settle(d.selectExpr("*", "if((_g+1)*_g <= 2*_r, _g+1, _g) as _b").drop("_g"), ["_b"], [c for c in d.columns if c != "_g"])
    d = d.selectExpr("*", "_r - _b*(_b-1) div 2 as _a")
    for name in "abc"[:width]:
        member = pool.select(*keys, F.col("rank").alias(f"_{name}"), F.struct(*(c for c in pool.columns if c not in (*keys, "rank"))).alias(name))
        d = d.join(member, [*keys, f"_{name}"])
    return d.select(*keys, "k", *"abc"[:width])


def plane_hypotheses(pool: DataFrame, keys, count: int, seed: int | str = 0) -> DataFrame:
    """Planes through point triples of the pool, turned to d >= 0; collinear triples are skipped."""
    d = drawn(pool, keys, count, 3, seed)
    d = d.selectExpr(*keys, "k", "a", "b.x-a.x as x1", "b.y-a.y as y1", "b.z-a.z as z1",
                     "c.x-a.x as x2", "c.y-a.y as y2", "c.z-a.z as z2")
    d = d.selectExpr(*keys, "k", "a", "y1*z2-z1*y2 as rx", "z1*x2-x1*z2 as ry", "x1*y2-y1*x2 as rz")
    d = d.selectExpr("*", "nullif(sqrt(rx*rx + ry*ry + rz*rz), 0D) as r")
    d = d.selectExpr(*keys, "k", "r", "rx/r as nx", "ry/r as ny", "rz/r as nz", "(rx*a.x + ry*a.y + rz*a.z)/r as d")
    d = settle(d, ["nx", "ny", "nz", "d", "r"], [*keys, "k"]).filter("r > 1e-12D")
    s = "if(d < 0, -1D, 1D)"
    return d.selectExpr(*keys, "k", f"{s}*nx as nx", f"{s}*ny as ny", f"{s}*nz as nz", "abs(d) as d")


GRID = 16  # cells along the longest side of a large group; whole cells are scored together


def _dealt(points: DataFrame, keys, needs, limit: str):
    """Points (keys, needs, ``_t``) with their block ``_b``, and all blocks (keys, ``_b``).

    A block is made of whole cells of a coarse grid, so that its points are neighbours.  Groups of up to BLOCK_POINTS
    are one block; crowded cells are split by the hash of ``pid``.
    """
    size = points.groupBy(*keys).agg(F.count("*").alias("_n"), *(f(a).alias(f"_{e}{a}") for a in "xyz" for e, f in (("l", F.min), ("h", F.max))))
    size = stage(size.selectExpr(*keys, "_n", "_lx", "_ly", "_lz", "greatest(_hx - _lx, _hy - _ly, _hz - _lz) as _side"))
    # positions that are no numbers belong to no cell in particular
    cell = " + ".join(f"{GRID ** i}L*if({a} between _l{a} and _l{a} + _side, least({GRID - 1}L, cast(floor(({a} - _l{a})/_side*{GRID}) as bigint)), 0L)"
                      for i, a in enumerate("xyz"))
    cell = f"if(_n > {BLOCK_POINTS} and _side > 0 and _side < double('Infinity'), {cell}, 0L) as _c"
    load = stage(points.join(size, keys).selectExpr(*keys, "_n", cell).groupBy(*keys, "_n", "_c").agg(F.count("*").alias("_m")))
    shared = f"pmod(xxhash64(_c), cast(ceil(_n/{BLOCK_POINTS}) as bigint))"
    first, parts = f"-1L - _c - {GRID ** 3}L*", f"cast(ceil(_m/{BLOCK_POINTS}) as bigint)"
    blocks = load.selectExpr(*keys, f"explode(if(_m > {BLOCK_POINTS}, transform(sequence(0L, {parts} - 1), i -> {first}i), array({shared}))) as _b")
    d = points.join(size, keys).selectExpr(*keys, *needs, f"{limit} as _t", "xxhash64(pid) as _h", cell).join(load, [*keys, "_c"])
    return d.selectExpr(*keys, *needs, "_t", f"if(_m > {BLOCK_POINTS}, {first}pmod(_h, {parts}), {shared}) as _b"), blocks.distinct()


def scored(points: DataFrame, hypotheses: DataFrame, keys, cols, needs, limit: str, kernel, some: int, extra=()) -> DataFrame:
    """(keys, extra, k, cost): costs of ``kernel(points, limits)(hypotheses)`` summed over all points of each group.

    Points are scored in blocks of about BLOCK_POINTS, so that a group of any size spreads over tasks; each block
    gets the group's hypotheses, whose number is a parameter, and returns one partial sum for each.  Hypotheses may have
    ``extra`` keys: several sets of them then share the points of a group, a set at a time and without copies of the group.
    """
    keys, extra = list(keys), list(extra)
    rows, blocks = _dealt(points, keys, needs, limit)
    packs = hypotheses.select(*keys, *extra, "k", *cols).join(blocks, keys)
    group = [*keys, "_b"]
    if extra:
        sets = hypotheses.select(*keys, *extra).distinct()
        part = F.pmod(F.xxhash64(*extra), F.lit(SET_PARTS))
        rows = rows.join(sets.select(*keys, part.alias("_p")).distinct(), keys)
        packs, group = packs.withColumn("_p", part), [*group, "_p"]
    kinds = dict(hypotheses.dtypes)
    out = [*keys, *extra, "k", "cost"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, *extra]) + ", k bigint, cost double"

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in out})
        of = kernel(left[list(needs)].to_numpy(float), left["_t"].to_numpy(float))
        table = right[list(cols)].to_numpy(float)
        cost = np.concatenate([of(table[i:i + some]) for i in range(0, len(table), some)])
        return right[out[:-1]].assign(cost=cost)

    parts = rows.groupBy(*group).cogroup(packs.groupBy(*group)).applyInPandas(score, schema)
    return parts.groupBy(*keys, *extra, "k").agg(F.round(F.sum("cost"), 9).alias("cost"))


def plane_cost(mode: str):
    """Truncated squares (``msac``) or the negative number of inliers (``count``).

    For the number of inliers, points along the Morton curve form boxes; a plane meets only the points of boxes it may reach,
    in single precision around the box's centre first.  Where a point is too near the limit for that, the box is counted again.
    """
    def kernel(xyz, t):
        if mode == "msac":
            def cost(planes):
                off = np.abs(xyz @ planes[:, :3].T - planes[:, 3])
                return np.minimum(off * off, (t * t)[:, None]).sum(axis=0)

            return cost
        able = np.isfinite(xyz).all(axis=1)
        xyz, t = xyz[able], t[able]
        if not len(xyz):
            return lambda planes: -np.zeros(len(planes))
        order = _along_curve(xyz)
        boxes = [(xyz[order[i:i + BOX]], t[order[i:i + BOX]]) for i in range(0, len(order), BOX)]
        low, high = (np.array([f(b, axis=0) for b, _ in boxes]) for f in (np.min, np.max))
        centre, half, widest = (low + high) / 2, (high - low) / 2, np.array([limit.max() for _, limit in boxes])
        tiles = []
        for (points, limit), middle, reach in zip(boxes, centre, half.sum(axis=1)):
            fill = -len(points) % 8
            local = np.pad(np.column_stack((points - middle, np.ones(len(points)))), ((0, fill), (0, 0))).T.astype(np.float32)
            slack = ROUGH * (reach + np.abs(limit))
            tiles.append((local, *(np.pad(limit + s, (0, fill), constant_values=-np.inf).astype(np.float32) for s in (-slack, slack))))

        def held(mask):
            # a byte for each point: at most 64 of them are added up in each byte of a word
            return mask.view(np.uint64).sum(axis=1).view(np.uint8).reshape(-1, 8).sum(axis=1, dtype=np.int64)

        def count(planes):
            side = centre @ planes[:, :3].T - planes[:, 3]
            far = np.abs(side) - half @ np.abs(planes[:, :3]).T > widest[:, None] + SLACK
            found, normal, side = np.zeros(len(planes)), planes[:, :3].astype(np.float32), side.astype(np.float32)
            for at, (local, surely, maybe) in enumerate(tiles):
                met = np.flatnonzero(~far[at])
                off = np.column_stack((normal[met], side[at, met])) @ local
                np.abs(off, out=off)
                least, most = held(off < surely), held(off < maybe)
                found[met] += least
                unsure = np.flatnonzero(least != most)
                if len(unsure):
                    points, limit = boxes[at]
                    off = np.abs(points @ planes[met[unsure], :3].T - planes[met[unsure], 3])
                    found[met[unsure]] += np.count_nonzero(off < limit[:, None], axis=0) - least[unsure]
            return -found

        return count

    return kernel


def score_planes(points: DataFrame, hypotheses: DataFrame, keys, limit: str, mode: str, extra=()) -> DataFrame:
    """Best hypothesis per group: ``msac`` = least truncated squares, ``count`` = most inliers."""
    names = [*keys, *extra]
    costs = scored(points, hypotheses, keys, ["nx", "ny", "nz", "d"], ["x", "y", "z"], limit, plane_cost(mode), SOME["plane"] if mode == "count" else 64, extra)
    best = costs.groupBy(*names).agg(F.min_by("k", F.struct("cost", "k")).alias("k"), F.min("cost").alias("cost"))
    return hypotheses.join(best, [*names, "k"]).select(*names, "k", "nx", "ny", "nz", "d", "cost")


def plane_inliers(points: DataFrame, planes: DataFrame, keys, limit: str, strict: bool = True, extra=()) -> DataFrame:
    """Points of each group within ``limit`` of the group's plane; with ``extra`` keys, of each of its planes."""
    d = points.join(planes.select(*keys, *extra, *(F.col(c).alias("_" + c) for c in ("nx", "ny", "nz", "d"))), list(keys))
    sign = "<" if strict else "<="
    return d.filter(f"abs(_nx*x + _ny*y + _nz*z - _d) {sign} {limit}").drop("_nx", "_ny", "_nz", "_d")


def msac_planes(points: DataFrame, keys, limit: str, count: int = 100, mode: str = "msac", seed: int | str = 0, sets: DataFrame | None = None):
    """Robust planes: (planes, inliers).  The best hypothesis is refined by a least-squares
    fit to its inliers, and the inliers are taken again around the refined plane.

    ``seed`` may name a whole-number key column: then every group draws by its own seed.  ``sets`` names the groups
    (``keys``) where those that differ only in keys without a column in ``points`` have the same points: these are not copied."""
    keys = list(keys)
    own, extra = [k for k in keys if k in points.columns], [k for k in keys if k not in points.columns]
    pools = sample_pools(points, keys, 3 * count, seed=seed) if sets is None else shared_pools(points, sets, own, keys, 3 * count, seed)
    hyps = stage(plane_hypotheses(pools, keys, count, seed))
    best = stage(score_planes(points, hyps, own, limit, mode, extra))
    refined = stage(pca_planes(plane_inliers(points, best, own, limit, extra=extra), keys))
    return refined, plane_inliers(points, refined, own, limit, extra=extra)


def _drawn_triples(n: int, count: int, seed: int):
    """``drawn`` for one pool of ``n`` points and width 3: ranks a, b, c."""
    total = n * (n - 1) // 2 * (n - 2) // 3
    r = (np.arange(min(count, total)) * (STRIDE % total) + seed * SHIFT % total) % total
    f = np.floor(np.cbrt(6.0 * r)).astype(np.int64)
    c = np.where((f + 2) * (f + 1) * f <= 6 * r, f + 2, np.where((f + 1) * f * (f - 1) <= 6 * r, f + 1, f))
    r = r - c * (c - 1) * (c - 2) // 6
    g = np.floor(np.sqrt(2.0 * r)).astype(np.int64)
    b = np.where((g + 1) * g <= 2 * r, g + 1, g)
    return r - b * (b - 1) // 2, b, c


def _pca_plane(xyz: np.ndarray):
    """``pca_planes`` of one group of rows: (normal, distance), or None."""
    n = len(xyz)
    if n < 3:
        return None
    mean = xyz.sum(axis=0) / n
    c = xyz.T @ xyz / n - np.outer(mean, mean)
    q = np.trace(c) / 3
    dev = c - q * np.eye(3)
    spread = math.sqrt((dev * dev).sum() / 6)
    if not spread < math.inf:
        return None
    cube = 2 * spread * spread * spread
    phi = math.acos(min(max(np.linalg.det(dev) / cube if cube else 0.0, -1.0), 1.0)) / 3
    u = c - (q + 2 * spread * math.cos(phi + 2 * math.pi / 3)) * np.eye(3)
    ways = [np.cross(u[0], u[1]), np.cross(u[0], u[2]), np.cross(u[1], u[2])]
    lengths = [math.sqrt(w @ w) for w in ways]
    best = 0 if lengths[0] >= lengths[1] and lengths[0] >= lengths[2] else 1 if lengths[1] >= lengths[2] else 2
    if not lengths[best] > 0:
        return None
    normal = ways[best] / lengths[best]
    d = float(normal @ mean)
    return (-normal, -d) if d < 0 else (normal, d)


def count_plane(pid: np.ndarray, xyz: np.ndarray, limit: float, count: int, seed: int):
    """``msac_planes`` of one group in memory, by the number of inliers: (normal, distance, which points are members), or None."""
    order = draw_numbers(pid, seed)
    size = min(3 * count, len(pid))
    low = np.flatnonzero(order <= np.partition(order, size - 1)[size - 1]) if len(pid) else np.empty(0, int)
    pool = xyz[low[np.lexsort((pid[low], order[low]))][:size]]
    if len(pool) < 3:
        return None
    a, b, c = (pool[at] for at in _drawn_triples(len(pool), count, seed))
    ray = np.cross(b - a, c - a)
    r = np.sqrt((ray * ray).sum(axis=1))
    kept = r > 1e-12
    ray, r, a = ray[kept], r[kept], a[kept]
    if not len(r):
        return None
    d = (ray * a).sum(axis=1) / r
    planes = np.column_stack((ray / r[:, None], d)) * np.where(d < 0, -1.0, 1.0)[:, None]
    of = plane_cost("count")(xyz, np.full(len(xyz), limit))
    cost = np.concatenate([of(planes[i:i + SOME["plane"]]) for i in range(0, len(planes), SOME["plane"])])
    best = planes[cost.argmin()]
    refined = _pca_plane(xyz[np.abs(xyz @ best[:3] - best[3]) < limit])
    if refined is None:
        return None
    return *refined, np.abs(xyz @ refined[0] - refined[1]) < limit


def cylinder_hypotheses(pool: DataFrame, keys, count: int, r_min: float, r_max: float, seed: int | str = 0) -> DataFrame:
    """Cylinders through oriented point pairs: axis f_n x g_n, circle in the plane across it."""
    d = drawn(pool, keys, count, 2, seed).withColumnsRenamed({"a": "f", "b": "g"})
    d = d.selectExpr(*keys, "k", *(f"{s}.{c} as {s}{c}" for s in "fg" for c in ("x", "y", "z", "nx", "ny", "nz")))
    d = d.selectExpr("*", "fny*gnz - fnz*gny as rx", "fnz*gnx - fnx*gnz as ry", "fnx*gny - fny*gnx as rz")
    d = d.selectExpr("*", "sqrt(rx*rx + ry*ry + rz*rz) as r")
    # axis kept with a non-negative leading component
    d = d.selectExpr("*", "if(rz < 0 or (rz = 0 and (ry < 0 or (ry = 0 and rx < 0))), -1D, 1D)/nullif(r, 0D) as _s")
    d = d.selectExpr("*", "_s*rx as ux", "_s*ry as uy", "_s*rz as uz")
    # centre where the two normal lines meet, seen along the axis
    d = d.selectExpr("*", "gny*uz - gnz*uy as mx", "gnz*ux - gnx*uz as my", "gnx*uy - gny*ux as mz")
    d = d.selectExpr("*", "((gx-fx)*mx + (gy-fy)*my + (gz-fz)*mz)/nullif(fnx*mx + fny*my + fnz*mz, 0D) as s")
    d = d.selectExpr("*", "fx + s*fnx as px", "fy + s*fny as py", "fz + s*fnz as pz")
    d = d.selectExpr("*", "(gx-px)*ux + (gy-py)*uy + (gz-pz)*uz as t")
    d = d.selectExpr("*", "sqrt(pow(gx-px-t*ux, 2) + pow(gy-py-t*uy, 2) + pow(gz-pz-t*uz, 2)) as rg")
    d = d.selectExpr(*keys, "k", "px", "py", "pz", "ux as ax", "uy as ay", "uz as az", "(abs(s) + rg)/2 as radius", "r")
    d = settle(d, ["px", "py", "pz", "ax", "ay", "az", "radius", "r"], [*keys, "k"])
    return d.filter(f"r > 1e-3D and radius >= {r_min!r}D and radius <= {r_max!r}D").drop("r")


CYLINDER_ERROR = """(1 - {w}D)*abs(_dist - _radius) + {w}D*least(acos(_cos), pi() - acos(_cos))"""


def _cylinder_error(rows: DataFrame, keys, weight: float, extra=()) -> DataFrame:
    """Add ``err``: weighted surface distance and normal deviation; needs p*, a*, radius and normals."""
    d = rows.selectExpr(*extra, *keys, "px", "py", "pz", "ax", "ay", "az", "radius as _radius", "nx", "ny", "nz",
                        "x-px as qx", "y-py as qy", "z-pz as qz")
    d = d.selectExpr("*", "qx*ax + qy*ay + qz*az as h")
    d = d.selectExpr("*", "qx-h*ax as ox", "qy-h*ay as oy", "qz-h*az as oz")
    d = d.selectExpr("*", "sqrt(ox*ox + oy*oy + oz*oz) as _dist")
    d = d.selectExpr("*", "least(1D, greatest(-1D, coalesce((ox*nx + oy*ny + oz*nz)/nullif(_dist, 0D), 0D))) as _cos")
    d = d.selectExpr("*", f"{CYLINDER_ERROR.format(w=repr(float(weight)))} as err")
    keep = [c for c in d.columns if c not in ("err", "qx", "qy", "qz", "h", "ox", "oy", "oz", "_dist", "_cos")]
    return settle(d, ["err"], keep)


FAN = 8  # points of a leaf box, and boxes of a parent box


def _radial(xyz, shape, at, of):
    """Vectors from the axes of ``shape[of]`` to the points ``xyz[at]``, their lengths, and the distances from the surfaces."""
    q = [xyz[i][at] - shape[i][of] for i in range(3)]
    axis = [shape[3 + i][of] for i in range(3)]
    h = q[0] * axis[0] + q[1] * axis[1] + q[2] * axis[2]
    o = [q[i] - h * axis[i] for i in range(3)]
    dist = np.sqrt(o[0] * o[0] + o[1] * o[1] + o[2] * o[2])
    return o, dist, np.abs(dist - shape[6][of])


def _turn(o, dist, normal, at):
    """Angle between the lines along radial vectors and normals; a right one on the axis."""
    dot = o[0] * normal[0][at] + o[1] * normal[1][at] + o[2] * normal[2][at]
    turn = np.arccos(np.clip(np.divide(dot, dist, out=np.zeros(len(dist)), where=dist != 0), -1, 1))
    return np.minimum(turn, np.pi - turn)


def _normal_boxes(xyz, normal, t):
    """Boxes of consecutive points: centre, reach around it and along the mean normal, that normal, its widest deviation, limits, size."""
    size = xyz.shape[1]
    centre = (xyz.min(axis=1) + xyz.max(axis=1)) / 2
    reach = np.sqrt(((xyz - centre[:, None]) ** 2).sum(axis=2).max(axis=1))
    mean = normal.sum(axis=1)
    length = np.sqrt((mean * mean).sum(axis=1))
    mean = mean / np.where(length > 0, length, 1)[:, None]
    spread = np.arccos(np.clip((normal * mean[:, None]).sum(axis=2).min(axis=1), -1, 1))
    unit = (np.abs((normal * normal).sum(axis=2) - 1) < 1e-9).all(axis=1) & (length > 0)
    slab = np.abs(((xyz - centre[:, None]) * mean[:, None]).sum(axis=2)).max(axis=1)
    return np.ascontiguousarray(centre.T), reach, slab, np.ascontiguousarray(mean.T), np.where(unit, spread, np.pi), t.min(axis=1), t.max(axis=1), float(size)


def cylinder_cost(weight: float):
    """The negative number of inliers by surface distance and normal deviation."""
    counts = cylinder_counts(weight)

    def kernel(rows, t):
        of = counts(rows, t)
        return lambda shapes: -of(shapes)

    return kernel


def cylinder_bounds(weight: float):
    """Least and largest possible number of inliers by surface distance and normal deviation.

    Points along the Morton curve form nested boxes.  A box whose error is bounded below the limit is counted whole, one
    bounded above it is dropped; only the points of the others are tested one by one, so the counts are exact.  With
    ``closed`` levels of boxes left unopened, the boxes that stay undecided are the gap between both numbers.
    """
    def kernel(rows, t):
        order = _along_curve(rows[:, :3])
        n, rows, t = len(order), rows[order], t[order]
        padded, limit = _filled(rows, FAN), _filled(t, FAN)
        limit[n:] = -np.inf  # repeated points are no inliers
        levels, size = [], FAN
        while True:
            fill = -len(padded) % size
            p = _filled(padded, size) if fill else padded
            tt = np.concatenate((limit, np.full(fill, -np.inf))) if fill else limit
            levels.insert(0, _normal_boxes(p[:, :3].reshape(-1, size, 3), p[:, 3:].reshape(-1, size, 3), tt.reshape(-1, size)))
            if len(padded) <= 64 * size:
                break
            size *= FAN
        xyz, normal = np.ascontiguousarray(padded[:, :3].T), np.ascontiguousarray(padded[:, 3:].T)
        counts = [len(box[1]) for box in levels] + [len(padded)]
        near = 1 - weight

        def count(shapes, closed=0):
            found, columns = np.zeros(len(shapes)), np.ascontiguousarray(shapes.T)
            shape = np.repeat(np.arange(len(shapes)), counts[0])
            box = np.tile(np.arange(counts[0]), len(shapes))
            for level, (centre, reach, slab, mean, spread, low, high, held) in enumerate(levels):
                o, dist, off = _radial(centre, columns, box, shape)
                h = reach[box]
                open_ = ~(near * (off - h) > high[box] + SLACK)
                shape, box, o, dist, off, h = shape[open_], box[open_], [c[open_] for c in o], dist[open_], off[open_], h[open_]
                turn = _turn(o, dist, mean, box)
                clear = np.where(dist > h, dist, np.inf)
                angle = spread[box] + np.where(dist > h, np.arcsin(h / clear), np.pi)
                # a flat box across the radial direction changes the distance by its thickness, its tilt and its curvature
                h = np.where(dist > h, np.minimum(h, slab[box] * np.cos(turn) + h * np.sin(turn) + h * h / (2 * (clear - h))), h)
                least = near * np.maximum(off - h, 0) + weight * np.maximum(turn - angle, 0)
                most = near * (off + h) + weight * np.minimum(turn + angle, np.pi / 2)
                inside = most < low[box] - SLACK
                found += held * np.bincount(shape[inside], minlength=len(shapes))
                cut = ~inside & ~(least > high[box] + SLACK)
                if closed and level >= len(levels) - closed:
                    return found, found + held * np.bincount(shape[cut], minlength=len(shapes))
                shape = np.repeat(shape[cut], FAN)
                box = (box[cut][:, None] * FAN + np.arange(FAN)).ravel()
                real = box < counts[level + 1]
                shape, box = shape[real], box[real]
            o, dist, off = _radial(xyz, columns, box, shape)
            close = near * off < limit[box]
            shape, box, off = shape[close], box[close], off[close]
            err = near * off + weight * _turn([c[close] for c in o], dist[close], normal, box)
            found += np.bincount(shape[err < limit[box]], minlength=len(shapes))
            return found, found

        return count

    return kernel


TILE, TILE_SHAPES = 512, 64  # neighbouring points, and cylinders, that meet in one product of matrices
TOLD = 1e-8  # distances this near the limit, far above the rounding of products, are computed point by point


def cylinder_counts(weight: float):
    """The exact number of inliers by surface distance and normal deviation, as in ``cylinder_hits``.

    Neighbouring points form tiles; a tile is dropped where its distance from the surface allows it, and meets the other
    cylinders in products of matrices around its centre.  The angle is told by bounds of its cosine; pairs between the bounds,
    near the limit or near the axis are computed one by one.
    """
    near, part = 1 - weight, max(weight, 1e-300)

    def kernel(rows, t):
        able = np.isfinite(rows).all(axis=1)
        rows, t, tiles = rows[able], t[able], []
        if len(rows):
            order = _along_curve(rows[:, :3])
            rows, t = rows[order], t[order]
        for i in range(0, len(rows), TILE):
            xyz, normal, limit = rows[i:i + TILE, :3], rows[i:i + TILE, 3:], t[i:i + TILE]
            centre = (xyz.min(axis=0) + xyz.max(axis=0)) / 2
            local = xyz - centre
            square = (local * local).sum(axis=1)
            tiles.append((centre, np.sqrt(square.max()), np.column_stack((local, np.ones(len(local)), square)), np.column_stack((normal, (local * normal).sum(axis=1))),
                          limit, np.ascontiguousarray(xyz.T), np.ascontiguousarray(normal.T)))

        def count(shapes):
            found, columns = np.zeros(len(shapes)), np.ascontiguousarray(shapes.T)
            p, axis, radius = shapes[:, :3], shapes[:, 3:6], shapes[:, 6]
            for centre, reach, local, normal, limit, xyz, normals in tiles:
                o = centre - p
                o -= (o * axis).sum(axis=1)[:, None] * axis
                span = (o * o).sum(axis=1)
                met = np.flatnonzero(~(near * (np.abs(np.sqrt(span) - radius) - reach) > limit.max() + SLACK))
                for first in range(0, len(met), TILE_SHAPES):
                    some = met[first:first + TILE_SHAPES]
                    a, foot, scale = axis[some].T, o[some].T, span[some] + reach * reach
                    slack = TOLD * np.sqrt(scale)
                    h = local[:, :3] @ a
                    dist = local @ np.vstack((2 * foot, span[some], np.ones(len(some))))
                    dist -= h * h
                    close = dist <= 1e-4 * scale
                    np.sqrt(np.maximum(dist, 0, out=dist), out=dist)
                    h *= normal[:, :3] @ a
                    dot = normal @ np.vstack((foot, np.ones(len(some))))
                    dot -= h
                    np.abs(dot, out=dot)
                    turn = np.abs(dist - radius[some])
                    turn *= -near
                    turn += limit[:, None]
                    able = turn > -slack
                    with np.errstate(over="ignore", invalid="ignore"):
                        turn /= part
                        turn *= turn
                        # cos(t) lies between 1 - t^2/2 + t^4/24 - t^6/720 and the same without its last term
                        most = (turn / 24 - 0.5) * turn + 1
                        turn *= turn * turn / 720
                        least = most - turn
                        inside = able & (dot > most * dist + slack) & ~close
                        told = inside | ~(able | close) | (dot < least * dist - slack) & ~close
                    found[some] += np.count_nonzero(inside, axis=0)
                    at, of = np.nonzero(~told)
                    of = some[of]
                    ray, dist, off = _radial(xyz, columns, at, of)
                    hit = near * off + weight * _turn(ray, dist, normals, at) < limit[at]
                    found += np.bincount(of[hit], minlength=len(shapes))
            return found

        return count

    return kernel


def cylinder_hits(xyz, normal, shape, limit: float, weight: float):
    """Which points (rows of 3 x n) a cylinder accepts, by the same test as in ``cylinder_bounds``."""
    o, dist, off = _radial(xyz, np.asarray(shape, float)[:, None], slice(None), 0)
    return (1 - weight) * off + weight * _turn(o, dist, normal, slice(None)) < limit


def score_cylinders(points: DataFrame, hypotheses: DataFrame, keys, limit: str, weight: float) -> DataFrame:
    """Hypothesis with the most inliers per group."""
    keys = list(keys)
    cols = ["px", "py", "pz", "ax", "ay", "az", "radius"]
    costs = scored(points, hypotheses, keys, cols, ["x", "y", "z", "nx", "ny", "nz"], limit, cylinder_cost(weight), SOME["tiles"])
    best = costs.groupBy(*keys).agg(F.min_by("k", F.struct("cost", "k")).alias("k"), (-F.min("cost")).cast("bigint").alias("inliers"))
    return hypotheses.join(best, [*keys, "k"]).select(*keys, "k", *cols, "inliers")


def cylinder_inliers(points: DataFrame, cylinders: DataFrame, keys, limit: str, weight: float) -> DataFrame:
    """Points of each group accepted by the group's cylinder; needs pid and normals."""
    keys = list(keys)
    rows = points.join(cylinders.select(*keys, "px", "py", "pz", "ax", "ay", "az", "radius"), keys)
    carried = [c for c in points.columns if c not in keys and c not in ("nx", "ny", "nz")]
    err = _cylinder_error(rows, keys, weight, [*carried, f"{limit} as _t"])
    return err.filter("err < _t").select(*keys, *carried, "nx", "ny", "nz")


def ransac_cylinders(points: DataFrame, keys, limit: str, weight: float, r_min: float, r_max: float,
                     count: int = 10_000, seed: int | str = 0):
    """Robust cylinders from oriented points (pid, x, y, z, nx, ny, nz): (cylinders, inliers)."""
    keys = list(keys)
    usable = points.filter("nx is not null")
    pools = sample_pools(usable, keys, 2 * count, extra=("nx", "ny", "nz"), seed=seed)
    hyps = stage(cylinder_hypotheses(pools, keys, count, r_min, r_max, seed))
    best = stage(score_cylinders(usable, hyps, keys, limit, weight))
    return best, cylinder_inliers(usable, best, keys, limit, weight)
