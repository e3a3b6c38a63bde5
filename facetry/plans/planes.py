"""Plane extraction: vote rounds, coarse-to-fine extraction, consensus-only peeling.

All scans advance together.  Votes are settled first: the rounds of a layer do not depend on fits, so all of them
are fitted in one pass.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import EPS32
from ..functions.vec import v
from ..operators import assign, claims, fit, grid, hist, octree, sphere
from ..operators.components import label_cells
from ..operators.fit import count_plane
from ..params import SegParams
from .book import Book, is_empty, stack, stage

NODE_COLS = ["scan_id", "layer", "depth", "ix", "iy", "iz", "n", "mx", "my", "mz", "nx", "ny", "nz", "curv"]
NODE_KEY = ["scan_id", "layer", "depth", "ix", "iy", "iz"]
PLANE = ["scan_id", "plane_id"]


def rho_votes(members: DataFrame, mean: DataFrame, p: SegParams, layer: int) -> DataFrame:
    """Distances along the weighted normal, spread over the distance bins."""
    ht = p.ht_distance(layer)
    d = members.drop("w").join(mean, "scan_id").selectExpr("*", "mx*wnx + my*wny + mz*wnz as rho")
    d = d.filter(f"abs(rho) < {p.rho_max!r}D")
    return hist.triangle_1d(d, "rho", f"-{p.rho_max!r}D", f"{ht!r}D", str(int(2 * p.rho_max / ht)),
                            f"{p.ht_deviation_factor * ht!r}D")


def hough_round(votes: DataFrame, p: SegParams, layer: int):
    """Best orientation and distance per scan: (hypotheses, inlier nodes).

    The plane's normal is the bin direction; the distance is the bin's lower edge.
    """
    members = stage(sphere.members(votes, sphere.peak(sphere.bin_weights(votes))))
    spread = rho_votes(members, sphere.mean_direction(members), p, layer)
    best = hist.peak(hist.total(spread, ["scan_id"]), ["scan_id"])
    inliers = hist.in_peak(spread, best, ["scan_id"])
    ht = p.ht_distance(layer)
    direction = inliers.groupBy("scan_id").agg(*(F.first("b" + a).alias("b" + a) for a in "xyz"))
    hyp = best.join(direction, "scan_id").selectExpr("*", f"bin*{ht!r}D - {p.rho_max!r}D as _d")
    hyp = hyp.selectExpr("scan_id", "bin", "members", *(f"if(_d < 0, -b{a}, b{a}) as n{a}" for a in "xyz"), "abs(_d) as d")
    return hyp, inliers.select(*NODE_COLS)


def threshold_fit(points: DataFrame, hyp: DataFrame, keys, limit: float):
    """Fit without consensus: the hypothesis itself and its points within ``limit``.

    Votes are folded, so a hypothesis' direction may be opposite to its voters' normals; it is turned to its points.
    """
    mean = points.groupBy(*keys).agg(*(F.avg(a).alias("_" + a) for a in "xyz"))
    planes = mean.join(hyp, [c for c in hyp.columns if c in keys])
    side = "if(nx*_x + ny*_y + nz*_z < 0, -1D, 1D)"
    planes = planes.selectExpr(*keys, *(f"{side}*n{a} as n{a}" for a in "xyz"), "d")
    return planes, fit.plane_inliers(points, planes, keys, repr(limit) + "D", strict=False)


def accepted(fits: DataFrame, hyp: DataFrame, counts: DataFrame, p: SegParams, layer: int, keys) -> DataFrame:
    """Fits that agree with their hypothesis and keep enough of their points (members / total)."""
    of = [c for c in hyp.columns if c in keys]
    h = hyp.selectExpr(*of, "nx as hx", "ny as hy", "nz as hz", "d as hd")
    d = fits.join(counts, list(keys)).join(h, of)
    return d.filter(
        (F.abs(F.expr("nx*hx + ny*hy + nz*hz")) > math.cos(2 * p.angle_at(layer)))
        & (F.abs(F.col("hd") - F.col("d")) < 2 * p.ht_distance(layer))
        & (F.col("members") >= p.min_points_in_cc)
        & (F.col("members") / F.col("total") >= p.sac_outlier_ratio)).drop("hx", "hy", "hz", "hd")


def describe(planes: DataFrame, members: DataFrame, cell: float):
    """Extents, outline, grid origin and cells of planes from their member points (x, y, z)."""
    framed = fit.with_frames(planes)
    local = fit.in_plane(members, framed, PLANE)
    ext = local.groupBy(*PLANE).agg(
        F.count("*").alias("members"), F.avg("x").alias("cgx"), F.avg("y").alias("cgy"), F.avg("z").alias("cgz"),
        *(f(c).alias(c + n) for c in "uvw" for n, f in (("min", F.min), ("max", F.max))))
    keep = [c for c in framed.columns if c not in ("members", "cgx", "cgy", "cgz")]
    table = framed.select(*keep).join(ext, PLANE)
    table = table.withColumns({"area": (F.col("umax") - F.col("umin")) * (F.col("vmax") - F.col("vmin")),
                               "u0": F.col("umin"), "v0": F.col("vmin"), "cell": F.lit(cell)})
    cells = grid.populate(grid.with_cells(local.select(*PLANE, "u", "v"), ext, PLANE, cell), PLANE)
    return table, cells.select(*PLANE, "cx", "cy")


def claim_nodes(book: Book, open_nodes: DataFrame, keyed: DataFrame, p: SegParams, layer: int) -> DataFrame | None:
    """Give open nodes to known planes they are connected to; returns the claimed node keys.

    Planes claim in the order of their area, each with its own grid as it was before the layer; what an earlier plane
    has taken is no candidate of a later one.
    """
    cell = p.cell_size(layer)
    planes = assign.by_area(book.structures)
    need = ["scan_id", "plane_id", "nx", "ny", "nz", "d", "thr", "rank", "u0", "v0", "cell", *(f"r{i}{j}" for i in range(3) for j in range(3))]
    cand = claims.near_planes(open_nodes.select(*NODE_COLS), planes.select(*need), p, cell, p.angle_at(layer))
    q = "(m{0}-p_n{0}*p_d)"
    off = [q.format(a) for a in "xyz"]
    cand = cand.selectExpr(
        *NODE_COLS, "plane_id", "rank",
        *(f"cast(floor(({' + '.join(f'r{i}{j}*{o}' for j, o in enumerate(off))} - {o0})/{cell!r}D) as bigint) as {c}"
          for i, (o0, c) in enumerate((("u0", "cx"), ("v0", "cy")))))
    cand = stage(cand)
    if is_empty(cand):
        return None
    touched = cand.select(*PLANE).distinct()
    scale = planes.select(*PLANE, F.greatest(F.lit(1), F.round(F.col("cell") / cell)).cast("int").alias("scale"))
    old = grid.refine(book.cells.join(touched, PLANE, "left_semi").join(scale, PLANE), "scale").select(*PLANE, "cx", "cy")
    won = stage(claims.claim_waves(cand, stage(old), NODE_KEY, min(p.min_octree_nodes, p.min_nodes_in_cc)).select(*NODE_COLS, "plane_id"))
    if is_empty(won):
        return None
    side = book.structures.select(*PLANE, "nx", "ny", "nz", "d", "thr")
    under = octree.points_under(won.select(*NODE_KEY, "plane_id"), keyed, layer, keep=["plane_id"])
    under = under.join(side, PLANE).selectExpr("*", "abs(nx*x + ny*y + nz*z - d) as _e")
    pts = stage(book.free(under.filter("_e <= thr")).select(*PLANE, "pid", "x", "y", "z"))
    near = F.col("_e") <= p.sac_distance(layer)
    full = claims.coverage(under.withColumn("layer", F.lit(layer)), NODE_KEY, near, p.node_segmented_ratio)
    book.segmented.append(stage(full.select("scan_id", "depth", "ix", "iy", "iz")))
    book.assignment.append(pts.select("scan_id", "pid", "plane_id"))
    # grow extents, and move the grids of growing planes to this layer's cell size
    local = fit.in_plane(pts, book.structures, PLANE)
    more = local.groupBy(*PLANE).agg(F.count("*").alias("more"), *(f(c).alias("_" + c + n) for c in "uv"
                                     for n, f in (("min", F.min), ("max", F.max))))
    grown = book.structures.join(more, PLANE, "left")
    fresh = F.col("more").isNotNull()
    upd = {"members": F.col("members") + F.coalesce("more", F.lit(0)), "cell": F.when(fresh, F.lit(cell)).otherwise(F.col("cell"))}
    for c in "uv":
        upd[c + "min"] = F.least(c + "min", f"_{c}min")
        upd[c + "max"] = F.greatest(c + "max", f"_{c}max")
    grown = grown.withColumns(upd).withColumn("area", (F.col("umax") - F.col("umin")) * (F.col("vmax") - F.col("vmin")))
    grown = grown.select(*book.structures.columns)
    base = book.structures.select(*PLANE, F.col("u0").alias("umin"), F.col("v0").alias("vmin"))
    new_cells = grid.populate(grid.with_cells(local.select(*PLANE, "u", "v"), base, PLANE, cell), PLANE).select(*PLANE, "cx", "cy")
    growing = more.select(*PLANE)
    kept = book.cells.join(growing, PLANE, "left_anti")
    moved = old.join(growing, PLANE, "left_semi").unionByName(new_cells).distinct()
    book.cells = stage(kept.unionByName(moved))
    book.structures = stage(grown)
    return won.select(*NODE_KEY)


def plane_ids(parts: DataFrame, layer: int, turn: str = "round") -> DataFrame:
    """Reproducible id from layer, round or attempt, and the order of its parts (few per scan)."""
    w = Window.partitionBy("scan_id", turn).orderBy("comp")
    return parts.withColumn("plane_id", F.expr(f"{layer << 56}L + shiftleft({turn}, 24)") + F.row_number().over(w))


ROUND = ["scan_id", "round"]
VOTES_IN_TASK = 1_000_000  # votes of a scan whose rounds one task settles
HYP = "hx double, hy double, hz double, hd double"


def _settled_rounds(p: SegParams, layer: int):
    """All vote rounds of one scan: the heaviest orientation, its heaviest distance, whose voters leave."""
    ht, low, dev = p.ht_distance(layer), -p.rho_max, p.ht_deviation_factor * p.ht_distance(layer)
    bins = int(2 * p.rho_max / ht)

    def kernel(votes: pd.DataFrame) -> pd.DataFrame:
        column = {c: votes[c].to_numpy() for c in votes.columns}
        _, first, place = np.unique(column["bi"] << 32 | column["bj"], return_index=True, return_inverse=True)
        key = [column[c] for c in ("layer", "depth", "ix", "iy", "iz")]
        _, node = np.unique(np.stack(key), axis=1, return_inverse=True)
        node, alive, out, failed = node.ravel(), np.ones(node.max() + 1, bool), [], 0
        while failed <= p.tries_on_each_depth:
            live = alive[node]
            heavy = np.where(np.bincount(place, live) > 0, np.round(np.bincount(place, column["w"] * live), 9), -np.inf)
            rows = np.flatnonzero(live & (place == heavy.argmax()))
            weight = column["w"][rows].sum() if len(rows) else 0.0
            if weight <= 0:
                break
            mean = [(column["n" + a][rows] * column["w"][rows]).sum() / weight for a in "xyz"]
            rho = sum(column["m" + a][rows] * mean[i] for i, a in enumerate("xyz"))
            rows, rho = rows[np.abs(rho) < p.rho_max], rho[np.abs(rho) < p.rho_max]
            b0 = np.maximum(0, np.floor((rho - dev - low) / ht)).astype(np.int64)
            b1 = np.minimum(bins, np.ceil((rho + dev - low) / ht)).astype(np.int64)
            size = np.maximum(b1 - b0, 0)
            voter = np.repeat(np.arange(len(rows)), size)
            bin_ = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + b0[voter]
            part = (dev - np.abs(bin_ * ht + low - rho[voter])) / dev
            voter, bin_, part = voter[part > 0], bin_[part > 0], part[part > 0]
            if not len(bin_):
                break
            top = int(np.round(np.bincount(bin_, part), 9).argmax())
            rows = rows[voter[bin_ == top]]
            alive[node[rows]] = False
            d, at = top * ht + low, first[heavy.argmax()]
            sign = -1.0 if d < 0 else 1.0
            found = votes.iloc[rows][NODE_COLS].assign(round=len(out), hd=abs(d), **{"h" + a: sign * column["b" + a][at] for a in "xyz"})
            out.append(found)
            failed += len(rows) < p.min_octree_nodes
        return pd.concat(out) if out else votes.iloc[:0][NODE_COLS].assign(round=0, hd=0.0, hx=0.0, hy=0.0, hz=0.0)

    return kernel


def vote_rounds(votes: DataFrame, p: SegParams, layer: int, in_task: int = VOTES_IN_TASK) -> DataFrame:
    """All vote rounds of a layer: inlier nodes with their ``round`` and hypothesis (hx, hy, hz, hd).

    A round takes its voters out of the votes whether or not a plane comes of it, so the rounds do not depend on fits;
    they end when no vote is left, or when so many rounds had too few voters that the scan must stop.  Scans of up to
    ``in_task`` votes are settled by one task each; the rounds of larger scans are jobs over all their votes.
    """
    columns = [*NODE_COLS, "round", "hx", "hy", "hz", "hd"]
    kinds = dict(votes.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in NODE_COLS) + f", round bigint, {HYP}"
    size = votes.groupBy("scan_id").agg(F.count("*").alias("_n"))
    small = votes.join(size.filter(F.col("_n") <= in_task).select("scan_id"), "scan_id", "left_semi")
    out = [stage(small.groupBy("scan_id").applyInPandas(_settled_rounds(p, layer), schema).select(*columns))]
    live = size.filter(F.col("_n") > in_task).selectExpr("scan_id", "0 as failed")
    live, removed, round_no = stage(live), [], 0
    while not is_empty(live):
        rows = votes.join(live, "scan_id", "left_semi")
        if removed:
            rows = sphere.remove_members(rows, stack(removed), NODE_KEY)
        hyp, inliers = hough_round(rows, p, layer)
        named = inliers.join(hyp.selectExpr("scan_id", "nx as hx", "ny as hy", "nz as hz", "d as hd"), "scan_id")
        out.append(stage(named.withColumn("round", F.lit(round_no).cast("bigint")).select(*columns)))
        removed.append(out[-1].select(*NODE_KEY))
        voters = out[-1].groupBy("scan_id").agg(F.count("*").alias("v"))
        live = stage(live.join(voters, "scan_id").selectExpr("scan_id", f"failed + cast(v < {p.min_octree_nodes} as int) as failed")
                     .filter(f"failed <= {p.tries_on_each_depth}"))
        round_no += 1
    return stack(out)


def rounds_made(rounds: DataFrame, p: SegParams) -> DataFrame:
    """The rounds (scan_id, round, voters, gained) that a scan makes before it stops.

    It goes on while its round had enough voters and there are enough points so far, or while failures are left;
    failures count only when the first part is false.  A scan has one row for each round.
    """
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("round")
        points = failed = made = 0
        for voters, gained in zip(pdf["voters"], pdf["gained"]):
            made, points = made + 1, points + gained
            good = voters >= p.min_octree_nodes and points > p.min_points_in_cc
            if not good and failed >= p.tries_on_each_depth:
                break
            failed += not good
        return pdf.iloc[:made][ROUND]

    return rounds.groupBy("scan_id").applyInPandas(kernel, "scan_id bigint, round bigint")


def detect_planes(rounds: DataFrame, book: Book, keyed: DataFrame, p: SegParams, layer: int) -> None:
    """Fit all rounds of a layer in one pass and enter the accepted planes in the book.

    Nodes belong to one round, so the points of different rounds are disjoint and their fits independent.
    """
    size = rounds.groupBy(*ROUND).agg(F.count("*").alias("voters"))
    hyp = rounds.selectExpr(*ROUND, "hx as nx", "hy as ny", "hz as nz", "hd as d").distinct()
    enough = size.filter(F.col("voters") >= p.min_octree_nodes)
    nodes = rounds.join(enough.select(*ROUND), ROUND, "left_semi")
    free = book.free(octree.points_under(nodes.select(*NODE_KEY, "round"), keyed, layer, keep=["layer", "round"]))
    rich = free.groupBy(*ROUND).agg(F.count("*").alias("c")).filter(F.col("c") >= max(3, p.min_points_in_cc))
    rich = stage(rich.select(*ROUND))
    if is_empty(rich):
        return
    # connected parts of the inlier nodes in the hypothesis plane
    cell = p.cell_size(layer)
    framed = fit.with_frames(hyp.join(rich, ROUND))
    pos = nodes.select(*NODE_KEY, "round", F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"))
    parts, _ = grid.connected_parts(fit.in_plane(pos, framed, ROUND), ROUND, cell, p.min_octree_nodes, p.min_nodes_in_cc)
    parts = stage(parts.select(*NODE_KEY, "round", "comp"))
    keys = [*ROUND, "comp"]
    under = octree.points_under(parts, keyed, layer, keep=["layer", "round", "comp"])
    under = stage(under.select(*NODE_KEY, "round", "comp", "pid", "x", "y", "z"))
    pts = book.free(under)
    total = pts.groupBy(*keys).agg(F.count("*").alias("total")).filter(F.col("total") >= p.min_points_in_cc)
    pts = stage(pts.join(total, keys))
    if is_empty(pts):
        return
    if p.no_ransac_step:
        limit = p.ht_distance(layer)
        fits, members = threshold_fit(pts, hyp, keys, limit)
    else:
        limit = p.sac_distance(layer)
        fits, members = fit.msac_planes(pts, keys, f"{limit!r}D", p.plane_hypotheses, seed="round")
    members = stage(members.select(*keys, "pid", "x", "y", "z", "total"))
    counts = members.groupBy(*keys).agg(F.count("*").alias("members"), F.max("total").alias("total"))
    good = accepted(fits.select(*keys, "nx", "ny", "nz", "d"), hyp, counts, p, layer, keys)
    good = stage(good.select(*keys, "members", "nx", "ny", "nz", "d", F.lit(limit).alias("thr")))
    gained = good.groupBy(*ROUND).agg(F.sum("members").alias("gained"))
    made = rounds_made(size.join(gained, ROUND, "left").fillna(0, ["gained"]), p)
    good = stage(plane_ids(good.join(made, ROUND, "left_semi"), layer).select(*PLANE, "round", "comp", "nx", "ny", "nz", "d", "thr"))
    if is_empty(good):
        return
    taken = stage(members.join(good.select(*PLANE, "round", "comp"), keys).select(*PLANE, "pid", "x", "y", "z"))
    table, cells = describe(good.drop("round", "comp"), taken, cell)
    book.add_structures(table.withColumn("layer", F.lit(layer)), cells)
    book.assignment.append(taken.select("scan_id", "pid", "plane_id"))
    side = good.select(*keys, "nx", "ny", "nz", "d")
    hit = under.join(side, keys).withColumn("hit", F.expr("abs(nx*x + ny*y + nz*z - d)") <= p.sac_distance(layer))
    full = claims.coverage(hit, NODE_KEY, F.col("hit"), p.node_segmented_ratio)
    book.segmented.append(stage(full.select("scan_id", "depth", "ix", "iy", "iz")))


def extract_planes(points: DataFrame, p: SegParams):
    """Coarse-to-fine extraction: (book, keyed points, nodes of all layers)."""
    keyed = stage(octree.with_keys(points.select("scan_id", "pid", "x", "y", "z"), p))
    nodes = stage(octree.surfels(octree.node_moments(keyed, p.layers(), p), p))
    book = Book()
    for layer in p.layers():
        open_nodes = stage(book.open_nodes(octree.on_layer(nodes, layer).filter("stable").select(*NODE_COLS)))
        if book.structures is not None:
            claimed = claim_nodes(book, open_nodes, keyed, p, layer)
            if claimed is not None:
                open_nodes = stage(open_nodes.join(claimed, NODE_KEY, "left_anti"))
        busy = open_nodes.groupBy("scan_id").agg(F.count("*").alias("c")).filter(F.col("c") > p.min_nodes_in_cc)
        votes = stage(sphere.votes(open_nodes.join(busy.select("scan_id"), "scan_id", "left_semi"), p.phi_resolution,
                                   p.angle_eps, p.curv_threshold, True))
        if is_empty(votes):
            continue
        detect_planes(vote_rounds(votes, p, layer), book, keyed, p, layer)
    return book, keyed, nodes


POINTS_IN_TASK = 1_000_000  # points of a scan that one task peels


def _frame(n):
    """First two rows of the rotation that turns a unit normal onto z, as in ``geometry.frame``."""
    x, y, z = n
    if z < -1.0 + EPS32:
        return np.array(((-1.0, 0.0, 0.0), (0.0, 1.0, 0.0)))
    k = 1.0 / (1.0 + z)
    return np.array(((z + y * y * k, -x * y * k, -x), (-x * y * k, z + x * x * k, -y)))


def _large_parts(xyz: np.ndarray, normal: np.ndarray, d: float, p: SegParams) -> np.ndarray:
    """Number of each member's part, from 1 in the order of the parts' first cells, among those with enough points; else 0."""
    u, v_ = _frame(normal) @ (xyz - normal * d).T
    cell = np.stack([np.floor((c - c.min()) / p.min_sac_distance).astype(np.int64) for c in (u, v_)])
    cells, at = np.unique(cell, axis=1, return_inverse=True)
    first, part = np.unique(label_cells(*cells), return_inverse=True)
    part = part[at.ravel()]
    n = np.bincount(part)
    least, most = sorted((p.min_octree_nodes, p.min_nodes_in_cc))
    good = (n > np.where(np.arange(len(first)) == 0, most, least)) & (n >= p.min_points_in_cc)
    return np.where(good, np.cumsum(good), 0)[part]


def _peeled(p: SegParams, failures: int):
    """All fits of one scan, one after the other: the claimed points with their plane."""
    def kernel(points: pd.DataFrame) -> pd.DataFrame:
        pid, xyz = points["pid"].to_numpy(np.int64), points[["x", "y", "z"]].to_numpy(float)
        scan, out, attempt, failed = points["scan_id"].iloc[0], [], 0, 0
        while len(pid) > p.min_points_in_cc and failed < failures:
            best = count_plane(pid, xyz, p.min_sac_distance, p.sac_iterations, attempt)
            if best is None or np.count_nonzero(best[2]) < p.min_points_in_cc:
                break
            normal, d, member = best
            mine = np.flatnonzero(member)
            part = _large_parts(xyz[mine], normal, d, p)
            if part.any():
                mine, part = mine[part > 0], part[part > 0]
                out.append(pd.DataFrame(dict(zip("xyz", xyz[mine].T)) | {"pid": pid[mine], "plane_id": (attempt << 24) + part}
                                        | dict(zip(("nx", "ny", "nz", "d"), (*normal, d)))))
                left = ~np.isin(pid, pid[mine])
                pid, xyz = pid[left], xyz[left]
            else:
                failed += 1
            attempt += 1
        return pd.concat(out).assign(scan_id=scan)[CLAIMED] if out else pd.DataFrame({c: [] for c in CLAIMED})

    return kernel


CLAIMED = [*PLANE, "pid", "x", "y", "z", "nx", "ny", "nz", "d"]


def peel_planes(points: DataFrame, p: SegParams, most_tries: int = 100, failures: int = 100, in_task: int = POINTS_IN_TASK):
    """Consensus-only planes: fit all remaining points, split into parts, claim, repeat: Book.

    A scan ends when a fit gets too few points, or after ``failures`` fits without a large enough part.  Each plane needs the
    points that the planes before it have left, so scans of up to ``in_task`` points are peeled by one task each.

    Larger scans take a chain of jobs for a pass.  A failed fit leaves the points as they were, so the fits after it are
    independent of each other: they are made in one pass, keyed by (scan, attempt), ten times as many as in the pass before
    and at most ``most_tries``, and the first one that claims or ends counts.  The result is that of one fit after the other.
    """
    book = Book()
    cloud = points.select("scan_id", "pid", "x", "y", "z")
    limit, keys = p.min_sac_distance, ["scan_id", "attempt"]
    size = cloud.filter("scan_id is not null").groupBy("scan_id").agg(F.count("*").alias("c"), F.count("pid").alias("named"))
    small = stage(size.filter(f"c <= {in_task} and named = c").select("scan_id"))
    if not is_empty(small):
        rows = cloud.join(small, "scan_id").select("scan_id", F.col("pid").cast("bigint").alias("pid"), *(F.col(a).cast("double").alias(a) for a in "xyz"))
        schema = f"scan_id {dict(cloud.dtypes)['scan_id']}, plane_id bigint, pid bigint, " + ", ".join(f"{c} double" for c in CLAIMED[3:])
        claimed = stage(rows.groupBy("scan_id").applyInPandas(_peeled(p, failures), schema))
        if not is_empty(claimed):
            good = claimed.select(*PLANE, "nx", "ny", "nz", "d").distinct().withColumn("thr", F.lit(limit))
            table, cells = describe(good, claimed.select(*PLANE, "pid", "x", "y", "z"), limit)
            book.add_structures(table.withColumn("layer", F.lit(0)), cells)
            book.assignment.append(claimed.select("scan_id", "pid", "plane_id"))
        cloud = cloud.join(small, "scan_id", "left_anti")
    left = stage(cloud)
    # the next attempt, failures so far, and how many attempts the next pass makes
    state = stage(left.select("scan_id").distinct().selectExpr("scan_id", "0L as next", "0L as fails", "1L as width"))
    while not is_empty(state):
        crowd = left.groupBy("scan_id").agg(F.count("*").alias("c")).filter(F.col("c") > p.min_points_in_cc)
        tries = stage(state.join(crowd, "scan_id", "left_semi").selectExpr("scan_id", "explode(sequence(next, next + width - 1)) as attempt"))
        fits, members = fit.msac_planes(left, keys, f"{limit!r}D", p.sac_iterations, "count", "attempt", tries)
        members = stage(members.select(*keys, "pid", "x", "y", "z"))
        fit_size = members.groupBy(*keys).agg(F.count("*").alias("c")).filter(F.col("c") >= p.min_points_in_cc)
        fits = stage(fits.select(*keys, "nx", "ny", "nz", "d").join(fit_size, keys, "left_semi"))
        local = fit.in_plane(members, fits, keys)
        parts, _ = grid.connected_parts(local, keys, limit, p.min_octree_nodes, p.min_nodes_in_cc)
        parts = stage(parts.select(*keys, "comp", "pid", "x", "y", "z"))
        sizes = parts.groupBy(*keys, "comp").agg(F.count("*").alias("c")).filter(F.col("c") >= p.min_points_in_cc)
        sizes = stage(sizes.select(*keys, "comp"))
        # the first attempt that ends the scan (no large fit) or claims (a large part)
        wins = sizes.select(*keys).distinct().withColumn("won", F.lit(True))
        ends = tries.join(fits, keys, "left_anti").withColumn("won", F.lit(False))
        event = wins.unionByName(ends).groupBy("scan_id").agg(F.min_by("won", "attempt").alias("won"), F.min("attempt").alias("attempt"))
        told = stage(state.join(crowd, "scan_id", "left_semi").join(event, "scan_id", "left").selectExpr(
            "scan_id", "attempt", "won", "next", "width", "fails + coalesce(attempt - next, width) as fails"))
        first = told.filter(f"won and fails < {failures}").select(*keys)
        good = sizes.join(first, keys, "left_semi").join(fits, keys)
        good = stage(plane_ids(good, 0, "attempt").select(*PLANE, *keys[1:], "comp", "nx", "ny", "nz", "d"))
        if not is_empty(good):
            claimed = stage(parts.join(good.select(*PLANE, "attempt", "comp"), [*keys, "comp"]).select(*PLANE, "pid", "x", "y", "z"))
            table, cells = describe(good.drop("attempt", "comp").withColumn("thr", F.lit(limit)), claimed, limit)
            book.add_structures(table.withColumn("layer", F.lit(0)), cells)
            book.assignment.append(claimed.select("scan_id", "pid", "plane_id"))
            left = stage(left.join(claimed.select("scan_id", "pid"), ["scan_id", "pid"], "left_anti"))
        state = stage(told.filter(f"fails < {failures} and coalesce(won, true)").selectExpr(
            "scan_id", "coalesce(attempt + 1, next + width) as next", "fails", f"if(won, 1L, least({most_tries}L, 10*width, {failures} - fails)) as width"))
    return book
