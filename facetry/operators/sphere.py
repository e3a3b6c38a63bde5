"""Orientation histograms on a sphere with near-uniform bins.

Ring i has int(2R sin(pi i / R) + 1.5) bins; rings run 0..R-1, so there is no bin at
the south pole.  A direction finds its bins by index arithmetic (ring range, then the
longitude range of the cap inside the ring); no table of bins is joined.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ring_size(i: int, resolution: int) -> int:
    return int(2 * resolution * math.sin(math.pi * i / resolution) + 1.5)


def bin_rows(resolution: int) -> list[tuple]:
    """All bins as (i, j, bx, by, bz); about 4 R² / pi of them."""
    out = []
    for i in range(resolution):
        size = ring_size(i, resolution)
        phi = math.pi * i / resolution
        for j in range(size):
            theta = 2 * math.pi * j / size
            out.append((i, j, math.cos(theta) * math.sin(phi), math.sin(theta) * math.sin(phi), math.cos(phi)))
    return out


def bin_table(spark, resolution: int) -> DataFrame:
    return spark.createDataFrame(bin_rows(resolution), "bi bigint, bj bigint, bx double, by double, bz double")


def bin_of(df: DataFrame, resolution: int, phi: str = "phi", theta: str = "theta") -> DataFrame:
    """Bin indices of given angles, rounding to the nearest ring and step."""
    df = df.selectExpr("*", f"cast(floor(least({phi}, pi())/pi()*{resolution} + 0.5D) as bigint) as bi")
    return df.selectExpr(
        "*", f"cast(floor(if({theta} >= 2*pi(), 0D, {theta})/(2*pi())"
        f"*floor(2*{resolution}*sin(pi()*bi/{resolution}) + 1.5D) + 0.5D) as bigint) as bj")


def cap_bins(df: DataFrame, resolution: int, angle: float, fold: bool, direction: str = "n") -> DataFrame:
    """One row per (input row, bin within ``angle`` of its direction): adds bi, bj, bx, by, bz, bdot.

    ``fold`` also takes the bins around the opposite direction.
    """
    cols = df.columns
    pad, eps, r = 1e-6, float(angle), resolution
    signs = "array(1D, -1D)" if fold else "array(1D)"
    d = df.filter(" and ".join(f"{direction}{a} is not null" for a in "xyz"))
    d = d.selectExpr("*", f"explode({signs}) as _s")
    d = d.selectExpr("*", f"acos(least(greatest(_s*{direction}z, -1D), 1D)) as _phi",
                     f"atan2(_s*{direction}y, _s*{direction}x) as _theta")
    d = d.selectExpr("*", f"cast(greatest(0D, ceil((_phi - {eps!r}D)*{r}/pi() - {pad}D)) as int) as _i0",
                     f"cast(least({r - 1}D, floor((_phi + {eps!r}D)*{r}/pi() + {pad}D)) as int) as _i1")
    d = d.selectExpr("*", "explode(if(_i0 <= _i1, sequence(_i0, _i1), cast(array() as array<int>))) as _i")
    d = d.selectExpr("*", f"cast(floor(2*{r}*sin(pi()*_i/{r}) + 1.5D) as int) as _n",
                     f"if(sin(_phi) > {math.sin(min(eps, math.pi / 2))!r}D and _phi > {eps!r}D and _phi < pi() - {eps!r}D,"
                     f" asin(least(1D, {math.sin(min(eps, math.pi / 2))!r}D/nullif(sin(_phi), 0D))), pi()) as _span")
    d = d.selectExpr("*", f"cast(ceil((_theta - _span)/(2*pi())*_n - {pad}D) as int) as _j0",
                     f"cast(floor((_theta + _span)/(2*pi())*_n + {pad}D) as int) as _j1")
    d = d.selectExpr("*", "explode(if(_j1 - _j0 + 1 >= _n, sequence(0, _n - 1),"
                     " if(_j0 <= _j1, sequence(_j0, _j1), cast(array() as array<int>)))) as _j")
    d = d.selectExpr("*", f"pi()*_i/{r} as _bphi", "2*pi()*pmod(_j, _n)/_n as _btheta")
    d = d.selectExpr(*cols, "_s", "cast(_i as bigint) as bi", "cast(pmod(_j, _n) as bigint) as bj",
                     "cos(_btheta)*sin(_bphi) as bx", "sin(_btheta)*sin(_bphi) as by", "cos(_bphi) as bz")
    d = d.selectExpr(*cols, "_s", "bi", "bj", "bx", "by", "bz",
                     f"bx*{direction}x + by*{direction}y + bz*{direction}z as bdot")
    return d.filter(f"_s*bdot >= {math.cos(eps)!r}D").drop("_s")


def votes(df: DataFrame, resolution: int, angle: float, curv_max: float, fold: bool,
          direction: str = "n") -> DataFrame:
    """Weighted orientation votes of nodes (or pairs) carrying n and curv."""
    c = abs(math.cos(angle))
    hit = cap_bins(df, resolution, angle, fold, direction)
    return hit.selectExpr("*", f"n*(1 - curv/{curv_max!r}D)*least(1D, greatest(0.001D,"
                          f" (abs(bdot) - {c!r}D)/{c!r}D)) as w").drop("bdot")


def bin_weights(vote_rows: DataFrame, keys=("scan_id",)) -> DataFrame:
    return vote_rows.groupBy(*keys, "bi", "bj", "bx", "by", "bz").agg(
        F.sum("w").alias("w"), F.count("*").alias("members"))


def peak(weights: DataFrame, keys=("scan_id",), digits: int = 9) -> DataFrame:
    """Heaviest bin per key, first bin on ties; rounding makes ties independent of summation order."""
    best = F.max_by(F.struct("bi", "bj", "bx", "by", "bz", "w"),
                    F.struct(F.round("w", digits), -F.col("bi"), -F.col("bj"))).alias("b")
    return weights.groupBy(*keys).agg(best).select(*keys, "b.*")


def smoothed(weights: DataFrame, resolution: int, angle: float, fold: bool, keys=("scan_id",)) -> DataFrame:
    """Weight summed over all bins within ``angle`` of each bin."""
    src = weights.select(*keys, "w", F.col("bx").alias("sx"), F.col("by").alias("sy"), F.col("bz").alias("sz"))
    return (cap_bins(src, resolution, angle, fold, "s").groupBy(*keys, "bi", "bj", "bx", "by", "bz")
            .agg(F.sum("w").alias("w")))


def members(vote_rows: DataFrame, peaks: DataFrame, keys=("scan_id",)) -> DataFrame:
    """Votes that fell into the peak bin of their key."""
    return vote_rows.join(peaks.select(*keys, "bi", "bj"), [*keys, "bi", "bj"], "left_semi")


def members_near(vote_rows: DataFrame, direction: tuple, angle: float, fold: bool) -> DataFrame:
    """Votes in all bins within ``angle`` of a fixed direction."""
    x, y, z = (float(c) for c in direction)
    dot = f"(bx*{x!r}D + by*{y!r}D + bz*{z!r}D)"
    return vote_rows.filter(f"{'abs' if fold else ''}{dot} >= {math.cos(angle)!r}D")


def remove_members(vote_rows: DataFrame, claimed: DataFrame, id_cols) -> DataFrame:
    """Votes without those of claimed voters."""
    return vote_rows.join(claimed.select(*id_cols).distinct(), list(id_cols), "left_anti")


def mean_direction(member_rows: DataFrame, keys=("scan_id",), direction: str = "n") -> DataFrame:
    """Weighted mean of the members' directions; not renormalised."""
    return member_rows.groupBy(*keys).agg(*(
        (F.sum(F.col(direction + a) * F.col("w")) / F.sum("w")).alias("w" + direction + a) for a in "xyz"))


def as_cloud(weights: DataFrame, scale: float, shift=(0.0, 0.0, 0.0), keys=("scan_id",)) -> DataFrame:
    """Bins as grey points, white at the heaviest bin of the key."""
    top = weights.groupBy(*keys).agg(F.max("w").alias("top"))
    grey = F.least(F.floor(255 * F.col("w") / F.col("top")), F.lit(255)).cast("bigint")
    df = weights.join(top, list(keys)).withColumn("grey", F.when(F.col("top") > 0, grey).otherwise(F.lit(0)))
    return df.select(*keys, "bi", "bj", *((F.col("b" + a) * scale + s).alias(a) for a, s in zip("xyz", shift)),
                     (F.col("grey") * 65793).alias("rgb"))
