"""One- and two-dimensional histograms as sparse grouped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_bins(df: DataFrame, value: str, lo: float, hi: float, size: float) -> DataFrame:
    """Add ``bin``; the key ``hi`` falls into the last bin, keys outside are dropped."""
    last = int((hi - lo) / size) - 1
    kept = df.filter((F.col(value) >= lo) & (F.col(value) <= hi))
    return kept.withColumn("bin", F.least(F.floor((F.col(value) - lo) / size), F.lit(last)).cast("bigint"))


def hist_1d(df: DataFrame, keys, value: str, lo: float, hi: float, size: float) -> DataFrame:
    return fixed_bins(df, value, lo, hi, size).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def triangle_1d(df: DataFrame, value: str, lo: str, size: str, bins: str, dev: str, weight: str = "1D") -> DataFrame:
    """One row per (input, bin) with weight (dev - |left edge - key|)/dev > 0.

    ``lo``, ``size``, ``bins`` and ``dev`` are SQL expressions, so they may differ per row.
    """
    d = df.selectExpr("*", f"cast(greatest(0, floor(({value} - {dev} - ({lo}))/{size})) as int) as _b0",
                      f"cast(least({bins}, ceil(({value} + {dev} - ({lo}))/{size})) as int) - 1 as _b1")
    d = d.filter("_b0 <= _b1").selectExpr("*", "explode(sequence(_b0, _b1)) as _b")
    d = d.selectExpr(*df.columns, "cast(_b as bigint) as bin",
                     f"{weight}*({dev} - abs(_b*{size} + ({lo}) - {value}))/{dev} as w")
    return d.filter("w > 0")


def triangle_2d(df: DataFrame, x: str, y: str, lo_x: str, lo_y: str, hi_x: str, hi_y: str,
                size: str, dev: str, weight: str = "1D") -> DataFrame:
    """Two-dimensional kernel: weight falls with the distance to the bin's lower corner."""
    d = df
    for a, v, lo, hi in (("x", x, lo_x, hi_x), ("y", y, lo_y, hi_y)):
        d = d.selectExpr("*", f"cast(greatest(0, floor(({v} - {dev} - ({lo}))/{size})) as int) as _{a}0",
                         f"cast(least(floor(({hi} - ({lo}))/{size}) + 1, ceil(({v} + {dev} - ({lo}))/{size})) as int) - 1 as _{a}1")
        d = d.filter(f"_{a}0 <= _{a}1").selectExpr("*", f"explode(sequence(_{a}0, _{a}1)) as _{a}")
    d = d.selectExpr(*df.columns, "cast(_x as bigint) as bin_x", "cast(_y as bigint) as bin_y",
                     f"{weight}*({dev} - sqrt(pow(_x*{size} + ({lo_x}) - {x}, 2) + pow(_y*{size} + ({lo_y}) - {y}, 2)))/{dev} as w")
    return d.filter("w > 0")


def hist_2d(df: DataFrame, keys, x: str, y: str, lo_x: float, lo_y: float, size: float) -> DataFrame:
    return (df.withColumn("bin_x", F.floor((F.col(x) - lo_x) / size).cast("bigint"))
            .withColumn("bin_y", F.floor((F.col(y) - lo_y) / size).cast("bigint"))
            .groupBy(*keys, "bin_x", "bin_y").agg(F.count("*").alias("n")))


def total(rows: DataFrame, keys, bins=("bin",)) -> DataFrame:
    """Weight and number of members per bin."""
    return rows.groupBy(*keys, *bins).agg(F.sum("w").alias("w"), F.count("*").alias("members"))


def peak(totals: DataFrame, keys, bins=("bin",), digits: int = 9, order=None) -> DataFrame:
    """Heaviest bin per key; the lowest bin (in ``order``) wins ties."""
    order = order or bins
    rank = F.struct(F.round("w", digits), *(-F.col(b) for b in order))
    best = F.max_by(F.struct(*bins, "w", "members"), rank).alias("p")
    return totals.groupBy(*keys).agg(best).select(*keys, "p.*")


def in_peak(rows: DataFrame, peaks: DataFrame, keys, bins=("bin",)) -> DataFrame:
    return rows.join(peaks.select(*keys, *bins), [*keys, *bins], "left_semi")


def drop_members(rows: DataFrame, peaks: DataFrame, keys, id_cols, bins=("bin",)) -> DataFrame:
    """Remove every member of the peak bins from all bins."""
    gone = in_peak(rows, peaks, keys, bins).select(*keys, *id_cols).distinct()
    return rows.join(gone, [*keys, *id_cols], "left_anti")
