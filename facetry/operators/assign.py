"""Point-to-structure assignment tables: (scan_id, pid, structure_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["scan_id", "pid"]


def update(old: DataFrame, new: DataFrame):
    """(merged, changed): new rows win; changed lists the points whose structure differs."""
    side = new.select(*KEY, F.col("structure_id").alias("_new"))
    both = old.join(side, KEY, "full")
    merged = both.select(*KEY, F.coalesce("_new", "structure_id").alias("structure_id"))
    changed = both.filter(F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("structure_id")))
    return merged, changed.select(*KEY, F.col("structure_id").alias("old_id"), F.col("_new").alias("new_id"))


def rebuild(claims: DataFrame, rank: str):
    """(assignment, overlaps) from membership rows; the highest rank wins, as the last writer does."""
    w = Window.partitionBy(*KEY).orderBy(F.col(rank).desc(), F.col("structure_id").desc())
    d = claims.withColumn("_r", F.row_number().over(w))
    overlaps = claims.groupBy(*KEY).agg(F.count("*").alias("claims")).filter("claims > 1")
    return d.filter("_r = 1").select(*KEY, "structure_id"), overlaps


def merge_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Inlier lists of merged structures, duplicates kept (UNION ALL)."""
    return (members.join(groups, ["scan_id", "structure_id"])
            .select("scan_id", F.col("group_id").alias("structure_id"), "pid"))


def remaining(points: DataFrame, claimed: DataFrame) -> DataFrame:
    """Points not yet claimed."""
    return points.join(claimed.select(*KEY), KEY, "left_anti")


def dense_labels(structures: DataFrame, order, first: int = 10) -> DataFrame:
    """Consecutive labels per scan from ``first``; a scan's structures are few."""
    w = Window.partitionBy("scan_id").orderBy(*order)
    return structures.withColumn("label", (F.row_number().over(w) + (first - 1)).cast("bigint"))


def by_area(planes: DataFrame) -> DataFrame:
    """Rank of planes by rectangle area, largest first."""
    w = Window.partitionBy("scan_id").orderBy(F.col("area").desc(), "plane_id")
    return planes.withColumn("rank", F.row_number().over(w).cast("bigint"))


def summary(points: DataFrame, assignment: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """Points, segmented, unsegmented and undefined points per scan."""
    d = points.join(assignment.select(*KEY, "structure_id"), KEY, "left").groupBy("scan_id").agg(
        F.count("*").alias("points"), F.count("structure_id").alias("segmented"))
    d = d.withColumn("unsegmented", F.col("points") - F.col("segmented"))
    if rejects is None:
        return d.withColumn("undefined", F.lit(0).cast("bigint"))
    lost = rejects.groupBy("scan_id").agg(F.count("*").alias("undefined"))
    return d.join(lost, "scan_id", "left").fillna({"undefined": 0})
