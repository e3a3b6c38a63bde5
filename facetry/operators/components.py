"""Connected components of grid cells and of general edges.

Cells are first labelled inside blocks of 64 x 64 cells, a group of at most 4,096 rows
whatever the size of the plane; only links between blocks are joined up, by one task
for groups with few of them and else by the distributed large-star / small-star
contraction (Kiveris et al., 2014).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import constant_rows
from ..session import is_empty, stage

BLOCK_BITS = 6
EDGES_IN_TASK = 100_000  # edges of a group that one task settles
SHIFT = 1 << 30
# cell code: orders cells by cx, then cy
CODE = f"((cx + {SHIFT}L) * {2 * SHIFT}L + (cy + {SHIFT}L))"


def decode(code: str) -> tuple[str, str]:
    return f"(cast(floor({code} div {2 * SHIFT}L) as bigint) - {SHIFT}L)", f"({code} % {2 * SHIFT}L - {SHIFT}L)"


def label_block(cx: np.ndarray, cy: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Smallest code of each cell's 8-connected component inside one block."""
    side = 1 << BLOCK_BITS
    none = np.iinfo(np.int64).max
    x, y = cx & (side - 1), cy & (side - 1)
    field = np.full((side + 2, side + 2), none, dtype=np.int64)
    field[x + 1, y + 1] = code
    while True:
        rows = np.minimum(np.minimum(field[:-2], field[1:-1]), field[2:])
        low = np.minimum(np.minimum(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])
        nxt = low[x, y]
        if np.array_equal(nxt, field[x + 1, y + 1]):
            return nxt
        field[x + 1, y + 1] = nxt


def label_cells(cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """Component of each of one grid's distinct cells, as in ``cell_components``, in memory."""
    code = (cx + SHIFT) * (2 * SHIFT) + cy + SHIFT
    order = np.argsort(code)
    near, root = code[order], np.arange(len(code))
    ends = []
    for ox, oy in ((1, 0), (0, 1), (1, 1), (1, -1)):
        wanted = near + ox * 2 * SHIFT + oy
        at = np.minimum(np.searchsorted(near, wanted), len(near) - 1)
        hit = np.flatnonzero(near[at] == wanted)
        ends.append((hit, at[hit]))
    a, b = (np.concatenate(e) for e in zip(*ends))
    root = _lowest(root, a, b)
    out = np.empty(len(code), np.int64)
    out[order] = near[root]
    return out


def _lowest(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place in the component of each place, by the edges between a and b."""
    while True:
        low, before = np.minimum(root[a], root[b]), root.copy()
        for end in (a, b):
            np.minimum.at(root, before[end], low)
            np.minimum.at(root, end, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _label_group(pdf: pd.DataFrame) -> pd.DataFrame:
    code = pdf["code"].to_numpy(np.int64)
    pdf["comp"] = label_block(pdf["cx"].to_numpy(np.int64), pdf["cy"].to_numpy(np.int64), code)
    return pdf


def cell_components(cells: DataFrame, keys) -> DataFrame:
    """Distinct cells (keys, cx, cy, ...) plus ``comp``, the code of the component's first cell.

    The first cell is the lowest in (cx, cy) order, which is also the grid's start cell.
    """
    keys = list(keys)
    d = cells.selectExpr("*", f"{CODE} as code", f"shiftright(cx, {BLOCK_BITS}) as _bx",
                         f"shiftright(cy, {BLOCK_BITS}) as _by")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields)
    local = stage(d.groupBy(*keys, "_bx", "_by").applyInPandas(_label_group, f"{fields}, comp bigint"))
    edges = _block_links(local, keys)
    out = local.drop("_bx", "_by", "code")
    if is_empty(edges):
        return out
    roots = connected_components(edges, keys)
    out = out.join(roots.withColumnRenamed("node", "comp"), [*keys, "comp"], "left")
    return out.withColumn("comp", F.coalesce("root", "comp")).drop("root")


def _block_links(local: DataFrame, keys) -> DataFrame:
    """Edges between block-local components that touch across a block border."""
    side = (1 << BLOCK_BITS) - 1
    rim = local.filter(f"(cx & {side}) in (0, {side}) or (cy & {side}) in (0, {side})")
    probe = rim.selectExpr(*keys, "cx", "cy", "comp as a", "_bx", "_by",
                           constant_rows("ox oy", ((1, 0), (0, 1), (1, 1), (1, -1))))
    probe = probe.filter(f"shiftright(cx + ox, {BLOCK_BITS}) <> _bx or shiftright(cy + oy, {BLOCK_BITS}) <> _by")
    probe = probe.selectExpr(*keys, "cx + ox as cx", "cy + oy as cy", "a")
    hit = probe.join(rim.selectExpr(*keys, "cx", "cy", "comp as b"), [*keys, "cx", "cy"])
    return hit.filter("a <> b").select(*keys, "a", "b").distinct()


def _settled(keys):
    """Smallest node of each node's component, for all edges of one group."""
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(pdf[["a", "b"]].to_numpy(np.int64), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        root = _lowest(np.arange(len(nodes)), a, b)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(nodes) for k in keys}, "node": nodes, "root": nodes[root]})

    return kernel


def connected_components(edges: DataFrame, keys=(), in_task: int = EDGES_IN_TASK) -> DataFrame:
    """Edges (keys, a, b) -> (keys, node, root) with the smallest node id as root.

    Groups of up to ``in_task`` edges are settled by one task each, larger ones by rounds over all their edges.
    """
    keys = list(keys)
    e = stage(edges.selectExpr(*keys, "greatest(a, b) as a", "least(a, b) as b").filter("a <> b").distinct())
    if not keys:
        return _contracted(e, keys)
    size = e.groupBy(*keys).agg(F.count("*").alias("_n"))
    large = stage(size.filter(F.col("_n") > in_task).select(*keys))
    kinds = dict(e.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", node bigint, root bigint"
    if is_empty(large):
        return e.groupBy(*keys).applyInPandas(_settled(keys), schema)
    small = e.join(large, keys, "left_anti").groupBy(*keys).applyInPandas(_settled(keys), schema)
    return small.unionByName(_contracted(stage(e.join(large, keys, "left_semi")), keys))


def _contracted(e: DataFrame, keys) -> DataFrame:
    """Large-star / small-star rounds over distinct edges with a > b."""
    seal = None
    while True:
        both = e.unionByName(e.selectExpr(*keys, "b as a", "a as b"))
        low = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(low, [*keys, "a"]).filter("b > a").selectExpr(*keys, "b as a", "m as b").distinct()
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = (large.join(least, [*keys, "a"]).selectExpr(*keys, "b as a", "m as b")
                 .unionByName(least.selectExpr(*keys, "a", "m as b")))
        e = stage(small.filter("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if now == seal:
            break
        seal = now
    roots = e.selectExpr(*keys, "a as node", "b as root")
    return roots.unionByName(e.selectExpr(*keys, "b as node", "b as root").distinct())
