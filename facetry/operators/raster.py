"""Rasters per plane as texel tables (keys, tx, ty, ...); untouched texels are zero."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import texture_size
from ..functions.vec import constant_rows
from .fit import extents, in_plane

KEYS = ["scan_id", "plane_id"]


def sizes(points: DataFrame, planes: DataFrame, factor: float, keys=KEYS) -> DataFrame:
    """Texel size, true raster size and its power-of-two padding per plane."""
    e = extents(points, planes, keys)
    got = texture_size(F.abs(F.col("umax") - F.col("umin")), F.abs(F.col("vmax") - F.col("vmin")), F.col("members"), factor)
    d = e.withColumn("texel", got["texel"]).withColumns({"width": got["width"], "height": got["height"]})
    d = d.withColumns({"w_pot": got["w_pot"], "h_pot": got["h_pot"]})
    d = d.withColumns({"width_ratio": F.col("width") / F.col("w_pot"), "height_ratio": F.col("height") / F.col("h_pot")})
    return d.select(*keys, "members", "umin", "vmin", "texel", "width", "height", "w_pot", "h_pot", "width_ratio", "height_ratio")


def place(points: DataFrame, planes: DataFrame, size: DataFrame, keys=KEYS) -> DataFrame:
    """Points with their texel (tx, ty) and height w over the plane."""
    d = in_plane(points, planes, keys).join(size.select(*keys, "umin", "vmin", "texel"), list(keys))
    t = F.when(F.col("texel") > 0, F.col("texel"))
    for out, c, lo in (("tx", "u", "umin"), ("ty", "v", "vmin")):
        d = d.withColumn(out, F.coalesce(F.floor(F.abs(F.col(c) - F.col(lo)) / t), F.lit(0)).cast("bigint"))
    return d.drop("umin", "vmin", "texel")


def colours(placed: DataFrame, keys=KEYS) -> DataFrame:
    """Mean red, green, blue in 0..1 and alpha per touched texel."""
    parts = [("red", 16), ("green", 8), ("blue", 0)]
    return placed.groupBy(*keys, "tx", "ty").agg(
        *(F.expr(f"avg((shiftright(rgb, {s}) & 255)/255D)").alias(c) for c, s in parts), F.lit(1.0).alias("alpha"))


def intensities(placed: DataFrame, keys=KEYS) -> DataFrame:
    return placed.groupBy(*keys, "tx", "ty").agg(F.avg("intensity").alias("intensity"), F.lit(1.0).alias("alpha"))


def alphas(placed: DataFrame, keys=KEYS) -> DataFrame:
    return placed.select(*keys, "tx", "ty").distinct().withColumn("alpha", F.lit(1.0))


def heights(placed: DataFrame, limit, keys=KEYS) -> DataFrame:
    """Mean of 0.5 * distance / limit + 0.5 per touched texel."""
    limit = F.lit(float(limit)) if isinstance(limit, (int, float)) else limit
    return placed.groupBy(*keys, "tx", "ty").agg(F.avg(0.5 * F.col("w") / limit + 0.5).alias("h"))


# 3-tap Gaussian with sigma 2, centre and side weight.
_SIDE = math.exp(-1 / 8)
CENTRE_WEIGHT = 1 / (1 + 2 * _SIDE)
SIDE_WEIGHT = _SIDE / (1 + 2 * _SIDE)


def blur(raster: DataFrame, size: DataFrame, values, keys=KEYS) -> DataFrame:
    """3 x 3 Gaussian, borders mirrored without repeating the edge texel.

    Every texel hands its weight to the texels it is seen from; mirrored views double
    the weight on the border.
    """
    d = raster.join(size.select(*keys, "w_pot", "h_pot"), list(keys))
    b, a = CENTRE_WEIGHT, SIDE_WEIGHT
    for t, n, w in (("tx", "w_pot", "_wx"), ("ty", "h_pot", "_wy")):
        d = d.selectExpr("*", f"""inline(filter(array(
            struct({t} as _t, {b!r}D as {w}), struct({t} - 1 as _t, if({t} = 1, {2 * a!r}D, {a!r}D) as {w}),
            struct({t} + 1 as _t, if({t} + 2 = {n}, {2 * a!r}D, {a!r}D) as {w})), s -> s._t >= 0 and s._t < {n}))""")
        d = d.drop(t).withColumnRenamed("_t", t)
    return d.groupBy(*keys, "tx", "ty").agg(*(F.sum(F.col(c) * F.col("_wx") * F.col("_wy")).alias(c) for c in values))


def dilate(raster: DataFrame, size: DataFrame, values, times: int = 1, keys=KEYS) -> DataFrame:
    """3 x 3 maximum, repeated; values are non-negative and untouched texels are zero."""
    cube = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    for _ in range(times):
        d = raster.join(size.select(*keys, "w_pot", "h_pot"), list(keys)).selectExpr("*", constant_rows("_i _j", cube))
        d = d.selectExpr(*keys, "w_pot", "h_pot", "tx + _i as tx", "ty + _j as ty", *values)
        d = d.filter("tx >= 0 and ty >= 0 and tx < w_pot and ty < h_pot")
        raster = d.groupBy(*keys, "tx", "ty").agg(*(F.max(c).alias(c) for c in values))
    return raster


def dense(size: DataFrame, keys=KEYS) -> DataFrame:
    """All texels of the padded raster."""
    return (size.selectExpr(*keys, "h_pot", "w_pot", "explode(sequence(0L, w_pot - 1)) as tx")
            .selectExpr(*keys, "h_pot", "w_pot", "tx", "explode(sequence(0L, h_pot - 1)) as ty"))


def normal_map(height: DataFrame, size: DataFrame, smooth: bool = True, keys=KEYS) -> DataFrame:
    """Normals from forward differences, shifted to 0..1; last row and column stay zero.

    Each touched texel contributes to itself and to its left and upper neighbour in one
    grouped pass, so no ordered window over a raster row is needed.
    """
    part = height.selectExpr(*keys, "inline(array(struct(tx, ty, h as h0, 0D as hu, 0D as hv),"
                             " struct(tx, ty - 1 as ty, 0D as h0, h as hu, 0D as hv),"
                             " struct(tx - 1 as tx, ty, 0D as h0, 0D as hu, h as hv)))")
    part = part.groupBy(*keys, "tx", "ty").agg(*(F.sum(c).alias(c) for c in ("h0", "hu", "hv")))
    d = dense(size, keys).join(part, [*keys, "tx", "ty"], "left").fillna(0.0, ["h0", "hu", "hv"])
    d = d.selectExpr("*", "h0 - hu as a", "h0 - hv as c").selectExpr("*", "sqrt(a*a + 0.09D + c*c) as _n")
    inner = "tx + 1 < w_pot and ty + 1 < h_pot"
    d = d.selectExpr(*keys, "tx", "ty", f"if({inner}, (a/_n + 1)*0.5D, 0D) as mx",
                     f"if({inner}, (0.3D/_n + 1)*0.5D, 0D) as my", f"if({inner}, (c/_n + 1)*0.5D, 0D) as mz")
    return blur(d, size, ["mx", "my", "mz"], keys) if smooth else d


def to_byte(c: Column) -> Column:
    """0..1 to 0..255, halves up; noise of the summation order is rounded away first."""
    return F.least(F.greatest(F.floor(F.round(c * 255, 6) + 0.5), F.lit(0)), F.lit(255)).cast("int")


def cropped_bytes(raster: DataFrame, size: DataFrame, values, keys=KEYS) -> DataFrame:
    """8-bit values of the true raster size."""
    d = raster.join(size.select(*keys, "width", "height"), list(keys)).filter("tx < width and ty < height")
    return d.withColumns({c: to_byte(F.col(c)) for c in values}).drop("width", "height")


def plane_textures(points: DataFrame, planes: DataFrame, factor: float, dilations: int, limit=None, keys=KEYS):
    """(sizes, colour raster, height raster, normal map) of planes."""
    size = sizes(points, planes, factor, keys)
    placed = place(points, planes, size, keys)
    if limit is None:
        placed = placed.join(planes.select(*keys, "thr"), list(keys))
        limit = F.col("thr")
    rgb, high = colours(placed, keys), heights(placed, limit, keys)
    if dilations:
        rgb = dilate(rgb, size, ["red", "green", "blue", "alpha"], dilations, keys)
        high = dilate(high, size, ["h"], dilations, keys)
    high = blur(high, size, ["h"], keys)
    return size, rgb, high, normal_map(high, size, True, keys)
