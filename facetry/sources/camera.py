"""Range pixels (image_id, r, c, v) to Cartesian points, and to metric robot axes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Structured-light camera, (offset, scale, focal length) per calibration, and aspect.
CALIBRATION = {
    1: (785.410786, 0.773545, -1610.981722),
    0: (771.016866, 0.791686, -1586.072821),
}
ASPECT = 1.4508
# File name pattern and image numbers taken with calibration 1.
CALIBRATION_1_PATTERN = r"abw\.test\.(0|19|21|25|27|28|29)\.range"

# Scanning-mirror camera (lengths in inches, angles in degrees).
MIRROR_GAP = 3.0
NOD_GAP = 5.5
SLOPE_DEG = 45.0
H_FIELD = 51.65
V_FIELD = 36.73
STANDOFF = 830.3
RANGE_UNIT = 0.20236
IMAGE_SIDE = 512
PINHOLE_FIELD_DEG = 60.0


def with_calibration(images: DataFrame, path: str = "path") -> DataFrame:
    """Calibration number by file name."""
    return images.withColumn("cal", F.col(path).rlike(CALIBRATION_1_PATTERN).cast("int"))


def structured_light(pixels: DataFrame) -> DataFrame:
    """Columns px, py, pz in range units; value 0 is undefined (null).  ``cal`` selects the constants."""
    def pick(k: int):
        return f"if(cal = 1, {CALIBRATION[1][k]!r}D, {CALIBRATION[0][k]!r}D)"

    d = pixels.selectExpr("*", f"if(v = 0, null, v/{pick(1)} + {pick(0)}) as _s")
    focal = f"abs({pick(2)})"
    return d.selectExpr(*pixels.columns, f"(c - 255)*_s/{focal} as px", f"(255 - r)/{ASPECT!r}D*_s/{focal} as py",
                        f"if(v = 0, null, (255 - v)/{pick(1)}) as pz")


def scanning_mirror(pixels: DataFrame) -> DataFrame:
    """Rotating plus nodding mirror model; all columns are trigonometry of the pixel position."""
    side = f"{IMAGE_SIDE}D"
    d = pixels.selectExpr("*", f"radians({H_FIELD!r}D*(255.5D - c)/{side}) as _al", f"radians({V_FIELD!r}D*(255.5D - r)/{side}) as _be")
    d = d.selectExpr("*", f"-({MIRROR_GAP!r}D*(1 - cos(_al))/tan(radians({SLOPE_DEG!r}D))) as _dz")
    d = d.selectExpr("*", f"_dz*tan(radians({SLOPE_DEG!r}D) + 0.5D*_be) as _dy")
    d = d.selectExpr("*", f"({NOD_GAP!r}D + _dy)*tan(_al) as _dx")
    d = d.selectExpr("*", f"(v + {STANDOFF!r}D - ((_dz - {NOD_GAP!r}D)/{RANGE_UNIT!r}D"
                     f" + sqrt(_dx*_dx + ({NOD_GAP!r}D + _dy)*({NOD_GAP!r}D + _dy))/{RANGE_UNIT!r}D))*{RANGE_UNIT!r}D as _r3")
    return d.selectExpr(*pixels.columns, "_dx + _r3*sin(_al) as px", "_dy + _r3*cos(_al)*sin(_be) as py",
                        "_dz + _r3*cos(_al)*cos(_be) as pz")


def pinhole(pixels: DataFrame) -> DataFrame:
    """Ideal 60 x 60 degree pinhole; value 0 is undefined (null)."""
    step = PINHOLE_FIELD_DEG / IMAGE_SIDE
    d = pixels.selectExpr("*", f"radians({-PINHOLE_FIELD_DEG / 2!r}D + (r + 0.5D)*{step!r}D) as _rx",
                          f"radians({-PINHOLE_FIELD_DEG / 2!r}D + (c + 0.5D)*{step!r}D) as _ry")
    d = d.selectExpr("*", "if(v = 0, null, v/sqrt(1 + tan(_ry)*tan(_ry) + tan(_rx)*tan(_rx))) as pz")
    return d.selectExpr(*pixels.columns, "pz*tan(_rx) as px", "pz*tan(_ry) as py", "pz")


def to_metres(d: DataFrame, strict_range: bool = False):
    """(points, rejects): range units to metres on robot axes.

    Only the upper bound of 10 m is tested unless ``strict_range`` asks for both.
    """
    d = d.selectExpr("*", "-(pz/100 - 4) as x", "-px/100 as y", "py/100 as z")
    test = "abs({0}) < 10" if strict_range else "{0} < 10"
    ok = F.coalesce(F.expr(" and ".join(test.format(a) for a in "xyz")), F.lit(False))
    # a raw coordinate of exactly -1 is the marker of undefined pixels
    ok = ok & F.expr("not coalesce(px = -1 or py = -1 or pz = -1, false)")
    d = d.withColumn("_ok", ok)
    rejects = d.filter("not _ok").withColumn("reason", F.expr("if(px is null or px = -1 or py = -1 or pz = -1, 'undefined', 'range')"))
    drop = ["_ok", "px", "py", "pz"]
    return d.filter("_ok").drop(*drop), rejects.drop(*drop, "x", "y", "z")
