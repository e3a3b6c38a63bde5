"""Occupancy grids in plane coordinates as sparse cell tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import constant_rows
from ..session import stage
from .components import cell_components


def with_cells(df: DataFrame, origin: DataFrame, keys, size) -> DataFrame:
    """Rows with u, v get their cell (cx, cy) relative to (umin, vmin) of their key."""
    size = F.lit(size) if isinstance(size, (int, float)) else size
    df = df.join(origin.select(*keys, F.col("umin").alias("_u0"), F.col("vmin").alias("_v0")), list(keys))
    return (df.withColumn("cx", F.floor((F.col("u") - F.col("_u0")) / size).cast("bigint"))
            .withColumn("cy", F.floor((F.col("v") - F.col("_v0")) / size).cast("bigint")).drop("_u0", "_v0"))


def origins(df: DataFrame, keys) -> DataFrame:
    """Ranges of each key's rows, stored: where they are few, rows that meet them stay where they are."""
    return stage(df.groupBy(*keys).agg(F.min("u").alias("umin"), F.max("u").alias("umax"),
                                       F.min("v").alias("vmin"), F.max("v").alias("vmax")))


def populate(cell_rows: DataFrame, keys) -> DataFrame:
    """Populated cells with the number of rows in each."""
    return cell_rows.groupBy(*keys, "cx", "cy").agg(F.count("*").alias("n"))


def refine(cells: DataFrame, scale) -> DataFrame:
    """Cells on a grid finer by the whole factor ``scale`` (a number or a column name)."""
    s = str(int(scale)) if isinstance(scale, (int, float)) else scale
    keep = [c for c in cells.columns if c not in ("cx", "cy")]
    d = cells.selectExpr(*keep, "cx", "cy", f"{s} as _s", f"explode(sequence(0, cast({s} as int) - 1)) as _k")
    d = d.selectExpr(*keep, "cy", "_s", "cx*_s + _k as cx", "explode(sequence(0, cast(_s as int) - 1)) as _l")
    return d.selectExpr(*keep, "cast(cx as bigint) as cx", "cast(cy*_s + _l as bigint) as cy")


def touching(probe: DataFrame, cells: DataFrame, keys, reach: int) -> DataFrame:
    """Probe rows (with cx, cy) that see a populated cell in the window -reach..reach-1.

    The window is half-open.  The populated cells are spread over the probe cells they
    serve, so the probe side, usually points, is not multiplied.
    """
    span = range(1 - reach, reach + 1)
    near = cells.select(*keys, "cx", "cy").distinct().selectExpr(
        *keys, "cx as _cx", "cy as _cy", constant_rows("_ox _oy", [(a, b) for a in span for b in span]))
    near = near.selectExpr(*keys, "_cx + _ox as cx", "_cy + _oy as cy").distinct()
    return probe.join(near, [*keys, "cx", "cy"], "left_semi")


def start_cells(cells: DataFrame, keys) -> DataFrame:
    """First populated cell per grid in (cx, cy) order."""
    return (cells.groupBy(*keys).agg(F.min(F.struct("cx", "cy")).alias("s"))
            .select(*keys, F.col("s.cx").alias("start_x"), F.col("s.cy").alias("start_y")))


def component_sizes(comp_cells: DataFrame, keys) -> DataFrame:
    """Cells and nodes per component; ``n`` is the node count of a cell."""
    return comp_cells.groupBy(*keys, "comp").agg(F.count("*").alias("cells"), F.sum("n").alias("nodes"),
                                                 F.min(F.struct("cx", "cy")).alias("first"))


def connected_parts(rows: DataFrame, keys, size, min_plane: int, min_part: int, origin: DataFrame | None = None):
    """Split rows (u, v) of each key into connected parts: (kept rows with ``comp``, sizes).

    The part of the start cell must exceed both minima, the others the smaller one.
    """
    keys = list(keys)
    origin = origin if origin is not None else origins(rows, keys)
    placed = with_cells(rows, origin, keys, size)
    comp = cell_components(populate(placed, keys), keys)
    sizes = component_sizes(comp, keys)
    start = comp.groupBy(*keys).agg(F.min("comp").alias("start"))
    sizes = sizes.join(start, keys)
    need = F.when(F.col("comp") == F.col("start"), F.lit(max(min_plane, min_part))).otherwise(
        F.lit(min(min_plane, min_part)))
    sizes = sizes.withColumn("kept", F.col("nodes") > need)
    good = comp.join(sizes.filter("kept").select(*keys, "comp"), [*keys, "comp"], "left_semi")
    return placed.join(good.select(*keys, "cx", "cy", "comp"), [*keys, "cx", "cy"]), sizes


def attached(old_cells: DataFrame, rows: DataFrame, keys, min_nodes: int) -> DataFrame:
    """Candidate rows (cx, cy) in the component of the grid's start cell, if more than ``min_nodes``.

    ``old_cells`` must already be on the candidates' cell size.
    """
    keys = list(keys)
    new = rows.groupBy(*keys, "cx", "cy").agg(F.count("*").alias("n"))
    both = (old_cells.select(*keys, "cx", "cy", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("old"))
            .unionByName(new.withColumn("old", F.lit(0))))
    merged = both.groupBy(*keys, "cx", "cy").agg(F.sum("n").alias("n"), F.max("old").alias("old"))
    active = merged.join(new.select(*keys).distinct(), keys, "left_semi")
    comp = cell_components(active, keys)
    first = F.min(F.when(F.col("old") == 1, F.struct("cx", "cy", "comp")))
    home = comp.groupBy(*keys).agg(first.alias("s")).select(*keys, F.col("s.comp").alias("comp"))
    big = (comp.join(home, [*keys, "comp"], "left_semi").groupBy(*keys, "comp").agg(F.sum("n").alias("nodes"))
           .filter(F.col("nodes") > min_nodes))
    cells = comp.join(big.select(*keys, "comp"), [*keys, "comp"], "left_semi").select(*keys, "cx", "cy")
    return rows.join(cells, [*keys, "cx", "cy"], "left_semi")
