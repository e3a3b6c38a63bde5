"""Mergeable second-order moments and the closed-form surfel built from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vec import settle, v

SUMS = ("sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz")


def moment_aggs(p=None, weight: Column | None = None) -> list[Column]:
    """count, sums and products of a point column triple, as aggregate Columns."""
    x, y, z = p or v("x", "y", "z")
    terms = (x, y, z, x * x, x * y, x * z, y * y, y * z, z * z)
    if weight is None:
        count = F.count(F.lit(1))
    else:
        count, terms = F.sum(weight), tuple(t * weight for t in terms)
    return [count.alias("n"), *(F.sum(t).alias(s) for t, s in zip(terms, SUMS))]


def merge_aggs() -> list[Column]:
    """Aggregates that merge moment rows."""
    return [F.sum(c).alias(c) for c in ("n", *SUMS)]


EIGEN = ["mx", "my", "mz", "l0", "l1", "l2", "ex", "ey", "ez"]
SURFEL = ["mx", "my", "mz", "l0", "l1", "l2", "curv", "curv2", "nx", "ny", "nz", "stable"]


def _eigen_steps(df: DataFrame) -> DataFrame:
    """Closed-form eigenvalues of the symmetric 3x3 covariance, one projection per step.

    The direction of l0 is the longest cross product of two rows of C - l0 I.
    """
    df = df.selectExpr("*", "sx/n as mx", "sy/n as my", "sz/n as mz")
    df = df.selectExpr("*", "sxx/n - mx*mx as _xx", "sxy/n - mx*my as _xy", "sxz/n - mx*mz as _xz",
                       "syy/n - my*my as _yy", "syz/n - my*mz as _yz", "szz/n - mz*mz as _zz")
    df = df.selectExpr("*", "(_xx + _yy + _zz)/3 as _q")
    df = df.selectExpr("*", "_xx - _q as _a", "_yy - _q as _b", "_zz - _q as _c")
    df = df.selectExpr("*", "sqrt((_a*_a + _b*_b + _c*_c + 2*(_xy*_xy + _xz*_xz + _yz*_yz))/6) as _p",
                       "_a*(_b*_c - _yz*_yz) - _xy*(_xy*_c - _yz*_xz) + _xz*(_xy*_yz - _b*_xz) as _det")
    df = df.selectExpr("*", "acos(least(greatest(coalesce(_det/nullif(2*_p*_p*_p, 0D), 0D), -1D), 1D))/3 as _phi")
    df = df.selectExpr("*", "_q + 2*_p*cos(_phi) as l2", f"_q + 2*_p*cos(_phi + {2 * math.pi / 3!r}D) as l0")
    df = df.selectExpr("*", "3*_q - l0 - l2 as l1", "_xx - l0 as _u0", "_yy - l0 as _u1", "_zz - l0 as _u2")
    df = df.selectExpr("*", "_xy*_yz - _xz*_u1 as _ux", "_xz*_xy - _u0*_yz as _uy", "_u0*_u1 - _xy*_xy as _uz",
                       "_xy*_u2 - _xz*_yz as _wx", "_xz*_xz - _u0*_u2 as _wy", "_u0*_yz - _xy*_xz as _wz",
                       "_u1*_u2 - _yz*_yz as _tx", "_yz*_xz - _xy*_u2 as _ty", "_xy*_yz - _u1*_xz as _tz")
    df = df.selectExpr("*", *(f"sqrt(_{k}x*_{k}x + _{k}y*_{k}y + _{k}z*_{k}z) as _{k}" for k in "uwt"))
    return df.selectExpr("*", *(
        f"case when _u >= _w and _u >= _t then _u{a}/nullif(_u, 0D) when _w >= _t then _w{a}/nullif(_w, 0D)"
        f" else _t{a}/nullif(_t, 0D) end as e{a}" for a in "xyz"))


def with_eigen(df: DataFrame) -> DataFrame:
    """Add mean m*, covariance eigenvalues l0 <= l1 <= l2 and the l0 direction e*.

    e* is null where the smallest eigenvalue has no unique direction.
    """
    return settle(_eigen_steps(df), EIGEN, df.columns)


def with_surfel(df: DataFrame, min_points: int, curv_max: float, curv2_min: float,
                min_variance: str = "0D") -> DataFrame:
    """Mean, eigenvalues, curvatures, viewpoint-facing normal and stability of moment rows."""
    keep = [c for c in df.columns if c not in SUMS]
    df = _eigen_steps(df)
    df = df.selectExpr("*", f"case when n >= {min_points} then l0/nullif(l2, 0D) end as curv",
                       f"case when n >= {min_points} then l1/nullif(l2, 0D) end as curv2",
                       "if(ex*mx + ey*my + ez*mz > 0, -1D, 1D) as _side")
    df = df.selectExpr("*", *(f"case when n >= {min_points} then _side*e{a} end as n{a}" for a in "xyz"),
                       f"coalesce(n >= {min_points} and curv <= {curv_max!r}D and curv2 >= {curv2_min!r}D"
                       f" and l2 >= {min_variance}, false) as stable")
    return settle(df, SURFEL, keep)
