"""Point filters, axis changes and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(cols=("x", "y", "z")):
    return F.expr(" and ".join(f"not isnan({c}) and abs({c}) < double('infinity')" for c in cols))


def split_valid(points: DataFrame, z_max: float, z_min: float):
    """(kept, rejects): finite points strictly inside the z range, the rest with a reason."""
    inside = (F.col("z") < z_max) & (F.col("z") > z_min)
    ok = F.coalesce(finite() & inside, F.lit(False))
    reason = F.when(F.coalesce(finite(), F.lit(False)), F.lit("range")).otherwise(F.lit("undefined"))
    return points.filter(ok), points.filter(~ok).select("scan_id", "pid", reason.alias("reason"))


def pass_through(points: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    return points.filter(finite()).filter(F.col(column).between(lo, hi))


def to_robot_axes(points: DataFrame) -> DataFrame:
    """Depth-camera axes to robot axes."""
    return points.withColumns({"x": F.col("z"), "y": -F.col("x"), "z": -F.col("y")})


def pick(rows: DataFrame, ids: DataFrame, keys) -> DataFrame:
    """Rows whose key is in the id list."""
    return rows.join(ids.select(*keys), list(keys), "left_semi")


def without(rows: DataFrame, ids: DataFrame, keys) -> DataFrame:
    return rows.join(ids.select(*keys), list(keys), "left_anti")
