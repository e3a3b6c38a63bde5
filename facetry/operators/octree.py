"""Octree layers as tables: keys, moments, roll-up, surfels and the joins along them.

A cell is (depth, ix, iy, iz); its ancestor at a shallower depth is a right shift.
Layer d holds the cells at depth d and the leaves above d.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import with_pair_axis
from ..functions.moments import SUMS, merge_aggs, moment_aggs, with_surfel
from ..functions.vec import constant_rows, v
from ..params import SegParams
from ..session import stage

CELL = ["ix", "iy", "iz"]
LEAF = ["scan_id", "leaf_depth", "lx", "ly", "lz"]
NODE = ["scan_id", "layer", "depth", *CELL]


def leaf_depth(p: SegParams, square_range):
    """Deepest depth whose cell is at least factor * range²; a CASE over the fixed sizes."""
    if p.sq_dist_factor <= 0:
        return F.lit(p.depth)
    target = F.greatest(F.lit(p.min_octree_resolution), F.lit(p.sq_dist_factor) * square_range)
    out = F.when(F.lit(p.cell_size(p.depth)) >= target, F.lit(p.depth))
    for d in range(p.depth - 1, -1, -1):
        out = out.when(F.lit(p.cell_size(d)) >= target, F.lit(d))
    return out.otherwise(F.lit(0))


def with_keys(points: DataFrame, p: SegParams) -> DataFrame:
    """Points with their leaf cell (leaf_depth, lx, ly, lz); non-finite points are dropped."""
    x, y, z = v("x", "y", "z")
    finite = [~F.isnan(c) & (F.abs(c) < float("inf")) for c in (x, y, z)]
    df = points.filter(finite[0] & finite[1] & finite[2])
    df = df.withColumn("leaf_depth", leaf_depth(p, x * x + y * y + z * z))
    half = p.cell_size(0) / 2
    shift = F.lit(p.depth) - F.col("leaf_depth")
    for key, c in zip(("lx", "ly", "lz"), (x, y, z)):
        full = F.floor((c + half) / p.min_octree_resolution).cast("bigint")
        df = df.withColumn(key, full if p.sq_dist_factor <= 0
                           else F.floor(full / F.pow(F.lit(2.0), shift)).cast("bigint"))
    return df


def leaf_moments(keyed: DataFrame) -> DataFrame:
    """One row per leaf cell; partial sums are combined before the shuffle."""
    aggs = moment_aggs()
    if "pid" in keyed.columns:
        aggs.append(F.min("pid").alias("node_min"))
    return keyed.groupBy(*LEAF).agg(*aggs)


MORTON_BITS = 20  # bits of a coordinate in the curve code


def curve_code(p: SegParams) -> str:
    """Place of a leaf's lowest corner on the Morton curve: cells under one node follow each other."""
    spread = []
    for k, a in enumerate("xyz"):
        c = f"shiftleft(l{a}, {p.depth} - leaf_depth)"
        spread += [f"shiftleft(shiftright({c}, {bit}) & 1L, {3 * bit + 2 - k})" for bit in range(p.depth)]
    return " | ".join(spread) if spread else "0L"


def _rolled(layers: list[int], names: list[str]):
    """Nodes of all layers from leaves in curve order; nodes at the ends of a batch are marked as cut."""
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for leaves in batches:
            if not len(leaves):
                continue
            scan, leaf_depth = leaves["scan_id"].to_numpy(), leaves["leaf_depth"].to_numpy()
            sums = leaves[names].to_numpy()
            low = leaves["node_min"].to_numpy() if "node_min" in leaves else None
            for layer in layers:
                depth = np.minimum(leaf_depth, layer)
                cell = [leaves["l" + a].to_numpy() >> (leaf_depth - depth) for a in "xyz"]
                new = np.ones(len(scan), bool)
                new[1:] = np.any([c[1:] != c[:-1] for c in (scan, depth, *cell)], axis=0)
                first = np.flatnonzero(new)
                out = {"scan_id": scan[first], "layer": layer, "depth": depth[first], **{"i" + a: c[first] for a, c in zip("xyz", cell)}}
                out |= dict(zip(names, np.add.reduceat(sums, first).T))
                if low is not None:
                    out["node_min"] = np.minimum.reduceat(low, first)
                rows = pd.DataFrame(out)
                rows["cut"] = False
                rows.loc[[0, len(rows) - 1], "cut"] = True
                yield rows

    return kernel


def roll_up(leaves: DataFrame, layers, p: SegParams | None = None) -> DataFrame:
    """All requested layers from the leaf moments, moving each leaf row once.

    Leaves are dealt by ranges of scan and Morton curve, so the leaves of a node stand together and a task sums whole
    layers in one go.  Only nodes at the ends of its batches may go on elsewhere; these few are merged afterwards.
    Without parameters, or for trees too deep for the code, the layers are formed by one grouping of all pairs of leaf
    and layer.
    """
    layers = list(layers)
    if p is None or p.depth > MORTON_BITS:
        layer = F.explode(F.array(*(F.lit(d) for d in layers))).alias("layer")
        df = leaves.select("*", layer).withColumn("depth", F.least("leaf_depth", "layer"))
        for a in "xyz":
            df = df.withColumn("i" + a, F.expr(f"shiftright(l{a}, leaf_depth - depth)"))
        keep = [F.min("node_min").alias("node_min")] if "node_min" in leaves.columns else []
        return df.groupBy(*NODE).agg(*merge_aggs(), *keep)
    low = ["node_min"] if "node_min" in leaves.columns else []
    names = ["n", *SUMS]
    dealt = leaves.select(*LEAF, *names, *low, F.expr(curve_code(p)).alias("_at"))
    dealt = dealt.repartitionByRange("scan_id", "_at", "leaf_depth").sortWithinPartitions("scan_id", "_at", "leaf_depth")
    kinds = dict(leaves.dtypes)
    schema = ("scan_id bigint, layer int, depth int, ix bigint, iy bigint, iz bigint, "
              + ", ".join(f"{c} {'double' if c in SUMS else kinds[c]}" for c in (*names, *low)) + ", cut boolean")
    nodes = stage(dealt.drop("_at").mapInPandas(_rolled(layers, names), schema))
    lows = [F.min(c).alias(c) for c in low]
    cut = nodes.filter("cut").groupBy(*NODE).agg(*merge_aggs(), *lows)
    return nodes.filter("not cut").drop("cut").unionByName(cut.select(*NODE, *names, *low))


def surfels(nodes: DataFrame, p: SegParams) -> DataFrame:
    """Mean, eigenvalues, curvatures, normal and stability per node."""
    floor_ = "0D"
    if p.principal_var_factor:
        finest = p.principal_var_factor * p.min_octree_resolution
        floor_ = f"pow({finest!r}D * pow(2D, {p.depth} - layer), 2D)"
    return with_surfel(nodes, p.min_points_for_normal, p.curv_threshold, p.curv2_threshold, floor_)


def layer_moments(keyed: DataFrame, layer: int) -> DataFrame:
    """Moments of a single layer straight from the points: one shuffle of partial sums."""
    aggs = moment_aggs()
    if "pid" in keyed.columns:
        aggs.append(F.min("pid").alias("node_min"))
    return cells_of(keyed, layer).withColumn("layer", F.lit(layer)).groupBy(*NODE).agg(*aggs)


def node_moments(keyed: DataFrame, layers, p: SegParams | None = None) -> DataFrame:
    """Moments of the given layers: directly for one layer, by roll-up for several."""
    layers = list(layers)
    return layer_moments(keyed, layers[0]) if len(layers) == 1 else roll_up(leaf_moments(keyed), layers, p)


def build(points: DataFrame, p: SegParams, layers=None) -> DataFrame:
    """points -> surfels of the requested layers (all of them by default)."""
    return surfels(node_moments(with_keys(points, p), layers or p.layers(), p), p)


def max_leaf_depth(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("scan_id").agg(F.max("leaf_depth").alias("max_depth"))


def on_layer(nodes: DataFrame, layer: int) -> DataFrame:
    return nodes.filter(F.col("layer") == layer)


def node_id(df: DataFrame, name: str = "node") -> DataFrame:
    """Struct key of a node inside its scan and layer."""
    return df.withColumn(name, F.struct("depth", *CELL))


def cells_of(keyed: DataFrame, layer: int) -> DataFrame:
    """Points with the key of their node on a layer."""
    df = keyed.withColumn("depth", F.least("leaf_depth", F.lit(layer)))
    for a in "xyz":
        df = df.withColumn("i" + a, F.expr(f"shiftright(l{a}, leaf_depth - depth)"))
    return df


def points_under(nodes: DataFrame, keyed: DataFrame, layer: int, free_of: DataFrame | None = None,
                 keep: list[str] | None = None) -> DataFrame:
    """Points below nodes of one layer; ``free_of`` removes already assigned points."""
    key = ["scan_id", "depth", *CELL]
    extra = keep or [c for c in nodes.columns if c not in NODE and c not in keyed.columns]
    df = cells_of(keyed, layer).join(nodes.select(*key, *extra), key)
    if free_of is not None:
        df = df.join(free_of.select("scan_id", "pid"), ["scan_id", "pid"], "left_anti")
    return df


def finest_normals(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each point with the normal of its finest stable ancestor.

    The search runs per leaf cell, so points are joined once, on their leaf key.
    """
    leaves = keyed.select(*LEAF).distinct()
    up = leaves.select("*", F.explode(F.sequence(F.lit(0), F.col("leaf_depth"))).alias("depth"))
    for a in "xyz":
        up = up.withColumn("i" + a, F.expr(f"shiftright(l{a}, leaf_depth - depth)"))
    stable = nodes.filter("stable AND layer = depth").select("scan_id", "depth", *CELL, "nx", "ny", "nz")
    best = (up.join(stable, ["scan_id", "depth", *CELL]).groupBy(*LEAF)
            .agg(F.max_by(F.struct("nx", "ny", "nz", "depth"), F.col("depth")).alias("f")))
    best = best.select(*LEAF, "f.nx", "f.ny", "f.nz", F.col("f.depth").alias("normal_depth"))
    return keyed.join(best, LEAF, "left")


def neighbour_pairs(nodes: DataFrame, reach: int, self_pairs: bool = False, mixed: bool = False) -> DataFrame:
    """Unordered pairs of stable nodes of one layer within ``reach`` cells.

    Same-depth pairs use half of the offset cube, so every pair appears once.  With
    ``mixed`` (range-dependent leaf sizes) a node also looks coarser leaves up, from its
    own ancestor at that depth; a scan has at most one row per depth in ``present``.
    """
    key = ["scan_id", "layer", "depth", *CELL]
    side = nodes.filter("stable").select(
        *key, "n", "curv", "mx", "my", "mz", "nx", "ny", "nz")
    cube = list(itertools.product(range(-reach, reach + 1), repeat=3))
    half = [o for o in cube if o > (0, 0, 0) or (self_pairs and o == (0, 0, 0))]

    own = [c for c in ("depth", *CELL, "n", "curv", "mx", "my", "mz", "nx", "ny", "nz")]
    a = side.selectExpr("scan_id", "layer", *(f"{c} as a_{c}" for c in own))
    b = side.selectExpr("scan_id", "layer", *(f"{c} as b_{c}" for c in own))
    a_cols = ["scan_id", "layer", *("a_" + c for c in own)]
    probe = (a.selectExpr("*", "a_depth as b_depth", constant_rows("ox oy oz", half))
             .selectExpr(*a_cols, "b_depth", *(f"a_i{k} + o{k} as b_i{k}" for k in "xyz")))
    if mixed:
        present = side.selectExpr("scan_id", "layer", "depth as b_depth").distinct()
        up = (a.join(present, ["scan_id", "layer"]).filter("b_depth < a_depth")
              .selectExpr("*", constant_rows("ox oy oz", cube)))
        probe = probe.unionByName(up.selectExpr(*a_cols, "b_depth", *(
            f"shiftright(a_i{k}, a_depth - b_depth) + o{k} as b_i{k}" for k in "xyz")))
    pairs = probe.join(b, ["scan_id", "layer", "b_depth", "b_ix", "b_iy", "b_iz"])
    return with_pair_axis(pairs)


def nodes_of_pairs(pairs: DataFrame, distinct: bool = True) -> DataFrame:
    """Both ends of the given pairs."""
    ends = F.array(*(F.struct(*(F.col(f"{s}_{c}").alias(c) for c in ("depth", *CELL))) for s in "ab"))
    keep = [c for c in ("scan_id", "layer", "round") if c in pairs.columns]
    df = pairs.select(*keep, F.inline(ends))
    return df.distinct() if distinct else df


def surfel_geometry(nodes: DataFrame, p: SegParams) -> DataFrame:
    """Cube centre and normal line per node; unstable nodes with 20 points get a relaxed normal."""
    df = with_surfel(nodes, min(20, p.min_points_for_normal), 1e300, 0.0).filter("layer = depth")
    strict = F.coalesce((F.col("n") >= p.min_points_for_normal) & (F.col("curv") <= p.curv_threshold)
                        & (F.col("curv2") >= p.curv2_threshold), F.lit(False))
    drawn = strict | (F.col("n") >= 20)
    df = df.withColumn("size", F.lit(p.min_octree_resolution) * F.pow(F.lit(2.0), p.depth - F.col("depth")))
    half = p.cell_size(0) / 2
    centre = {f"c{a}": (F.col(f"i{a}") + 0.5) * F.col("size") - half for a in "xyz"}
    tip = {f"t{a}": F.when(drawn, F.col(f"m{a}") + F.col(f"n{a}") * F.col("size")) for a in "xyz"}
    return df.select("scan_id", "depth", *CELL, "n", "size", *(c.alias(k) for k, c in centre.items()),
                     "mx", "my", "mz", *(c.alias(k) for k, c in tip.items()),
                     strict.alias("stable"))
