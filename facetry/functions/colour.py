"""Packed colours and index colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def red(rgb: Column) -> Column:
    return F.shiftright(rgb, 16).bitwiseAND(F.lit(255))


def green(rgb: Column) -> Column:
    return F.shiftright(rgb, 8).bitwiseAND(F.lit(255))


def blue(rgb: Column) -> Column:
    return rgb.bitwiseAND(F.lit(255))


def pack(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def float_bits_to_rgb(bits: Column) -> Column:
    """24-bit colour from the integer bits of a packed colour field."""
    return bits.bitwiseAND(F.lit(0xFFFFFF))


# Lower ends of the hue sectors and the sector width.
SECTORS = (0.83333, 0.66666, 0.5, 0.33333, 0.16666)
SECTOR_WIDTH = 0.16666


def index_colour(index: Column, total: Column) -> dict[str, Column]:
    """Hue-wheel colour of structure ``index`` out of ``total``."""
    t = 1 - index.cast("double") / total.cast("double")
    one, zero = F.lit(1.0), F.lit(0.0)

    def ramp(lo: float) -> Column:
        return (t - lo) / SECTOR_WIDTH

    table = (
        (one, 1 - ramp(SECTORS[0]), zero),
        (ramp(SECTORS[1]), one, zero),
        (zero, one, 1 - ramp(SECTORS[2])),
        (zero, 1 - ramp(SECTORS[3]), one),
        (ramp(SECTORS[4]), zero, one),
    )

    def channel(k: int, first: Column, last: Column) -> Column:
        out = F.when(t == 1, first)
        for lo, row in zip(SECTORS, table):
            out = out.when(t >= lo, row[k])
        return out.otherwise(last)

    return {"red": channel(0, one, one), "green": channel(1, zero, zero),
            "blue": channel(2, zero, 1 - t / SECTOR_WIDTH)}


def rgb_from_unit(r: Column, g: Column, b: Column) -> Column:
    return pack(*(F.floor(c * 255).cast("int") for c in (r, g, b)))
