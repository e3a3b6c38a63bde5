"""Three-component vectors of Columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class V(NamedTuple):
    x: Column
    y: Column
    z: Column


def v(*names: str) -> V:
    """``v("x","y","z")`` or ``v("n")`` for the columns nx, ny, nz."""
    if len(names) == 1:
        names = tuple(names[0] + a for a in "xyz")
    return V(*(F.col(n) for n in names))


def const(x: float, y: float, z: float) -> V:
    return V(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b) -> V:
    return V(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def add(a, b) -> V:
    return V(a[0] + b[0], a[1] + b[1], a[2] + b[2])


def sub(a, b) -> V:
    return V(a[0] - b[0], a[1] - b[1], a[2] - b[2])


def mul(a, k) -> V:
    return V(a[0] * k, a[1] * k, a[2] * k)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.when(b != 0, b)


def unit(a, length: Column) -> V:
    """a / length with an already computed length (null for zero length)."""
    return V(*(ratio(c, length) for c in a))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def named(a, prefix: str) -> dict[str, Column]:
    return {prefix + k: c for k, c in zip("xyz", a)}


def let(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add computed columns that filters above must not paste back into their input.

    ``inline(array(struct(...)))`` stays inside whole-stage codegen, and the optimizer
    pushes no predicate through it.  Long closed forms end in one ``let``; without it a
    filter on the result would be rewritten in terms of its inputs, growing the
    expression exponentially.
    """
    return df.select("*", F.inline(F.array(F.struct(*(e.alias(k) for k, e in exprs.items())))))


def settle(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Close a chain of projections: pass ``keep`` through, settle ``names`` as in ``let``."""
    return df.selectExpr(*keep, f"inline(array(struct({', '.join(names)})))")


def constant_rows(names: str, rows) -> str:
    """SQL generator over a short constant table of integers: ``inline(array(struct...))``."""
    cols = names.split()
    body = ", ".join("struct(" + ", ".join(f"{int(v)}L as {c}" for c, v in zip(cols, r)) + ")" for r in rows)
    return f"inline(array({body}))"
