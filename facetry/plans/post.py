"""Post-processing of extracted planes: merging and edge-aware reassignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assign, claims, fit, octree
from ..params import SegParams
from .book import Book, is_empty, stack, stage
from .planes import NODE_KEY, PLANE, describe


def star_groups(edges: DataFrame) -> DataFrame:
    """Greedy grouping of ranked edges (a_id, b_id, a_rank < b_rank): (scan_id, b_id -> a_id).

    A plane is a centre unless an earlier centre absorbs it; centres are settled in
    waves, and edges of absorbed planes disappear.
    """
    done: list[DataFrame] = []
    rest = stage(edges.select("scan_id", "a_id", "b_id", "a_rank"))
    while not is_empty(rest):
        targets = rest.select("scan_id", F.col("b_id").alias("a_id")).distinct()
        free = rest.join(targets, ["scan_id", "a_id"], "left_anti")
        taken = stage(free.groupBy("scan_id", "b_id").agg(F.min_by("a_id", "a_rank").alias("a_id")))
        done.append(taken)
        settled = free.select("scan_id", "a_id").distinct()
        gone = taken.select("scan_id", "b_id")
        rest = stage(rest.join(settled, ["scan_id", "a_id"], "left_anti").join(gone, ["scan_id", "b_id"], "left_anti")
                     .join(gone.withColumnRenamed("b_id", "a_id"), ["scan_id", "a_id"], "left_anti"))
    return stack(done)


def member_points(book: Book, keyed: DataFrame) -> DataFrame:
    return keyed.select("scan_id", "pid", "x", "y", "z").join(stack(book.assignment), ["scan_id", "pid"])


def merge_planes(book: Book, keyed: DataFrame, p: SegParams) -> Book:
    """Merge similar, mutually close, grid-connected planes; merged planes are refitted."""
    if book.structures is None:
        return book
    ranked = stage(assign.by_area(book.structures))
    members = stage(member_points(book, keyed))
    pairs = stage(claims.merge_candidates(ranked, p))
    if is_empty(pairs):
        return book
    linked = claims.grid_contacts(pairs, members, ranked, book.cells, p.connection_neighbors)
    groups = star_groups(pairs.join(linked, ["scan_id", "a_id", "b_id"]))
    if groups is None:
        return book
    centres = groups.select("scan_id", "a_id").distinct().selectExpr("scan_id", "a_id", "a_id as b_id")
    groups = stage(groups.unionByName(centres))
    belong = groups.selectExpr("scan_id", "b_id as plane_id", "a_id as merged_id")
    moved = stage(members.join(belong, PLANE).select("scan_id", F.col("merged_id").alias("plane_id"), "pid", "x", "y", "z"))
    limits = ranked.join(belong, PLANE).groupBy("scan_id", F.col("merged_id").alias("plane_id")).agg(
        F.max("thr").alias("thr"), F.min("cell").alias("cell"), F.min("layer").alias("layer"))
    refit = fit.pca_planes(moved, PLANE).select(*PLANE, "nx", "ny", "nz", "d").join(limits, PLANE)
    return rebuilt(book, refit, moved, belong)


def merge_to_fixpoint(book: Book, keyed: DataFrame, p: SegParams) -> Book:
    """Merge until no two planes may be merged; a merged plane is compared with its own fit, extent and threshold.

    Every pass merges whole stars, so a chain of n planes is one plane after about log2(n) passes; each pass reads the
    points of planes that it compares only.
    """
    while True:
        merged = merge_planes(book, keyed, p)
        if merged is book:
            return book
        book = merged


def rebuilt(book: Book, refit: DataFrame, moved: DataFrame, belong: DataFrame) -> Book:
    """Book with refitted planes in place of the ones listed in ``belong``."""
    out = Book(segmented=book.segmented)
    refit = stage(refit)
    parts, cells = [], []
    # cell sizes form a short list of powers of two, one description job each
    for row in refit.select("cell").distinct().collect():
        some = refit.filter(F.col("cell") == row["cell"])
        t, c = describe(some.drop("cell"), moved, row["cell"])
        parts.append(t)
        cells.append(c)
    gone = belong.select(*PLANE).distinct()
    out.structures = stage(stack([book.structures.join(gone, PLANE, "left_anti"), *parts]))
    out.cells = stage(stack([book.cells.join(gone, PLANE, "left_anti"), *cells]))
    kept = stack(book.assignment).join(gone, PLANE, "left_anti")
    out.assignment = [stage(kept.unionByName(moved.select("scan_id", "pid", "plane_id")))]
    return out


def spread_candidates(book: Book, nodes: DataFrame, p: SegParams) -> DataFrame:
    """Finest-layer nodes with every plane they may belong to."""
    cell = p.cell_size(p.depth)
    near = claims.near_planes(nodes.select(*NODE_KEY, "mx", "my", "mz"),
                              book.structures.select(*PLANE, "nx", "ny", "nz", "d", "thr"), p, cell)
    return claims.box_and_grid(near, book.structures, book.cells, p)


def spread_nodes(book: Book, nodes: DataFrame, keyed: DataFrame, p: SegParams) -> Book:
    """Reassign all finest-layer nodes; points of contested nodes are split by the bisecting plane."""
    if book.structures is None:
        return book
    layer = p.layers()[-1]
    cand = spread_candidates(book, octree.on_layer(nodes, layer), p)
    two = stage(claims.nearest_two(cand, NODE_KEY))
    single = two.filter("second_plane is null").select(*NODE_KEY, F.col("first_plane").alias("plane_id"))
    whole = octree.points_under(single, keyed, layer, keep=["plane_id"]).select(*PLANE, "pid", "x", "y", "z")
    contested = two.filter("second_plane is not null")
    middles = claims.middle_planes(contested, book.structures)
    edge = octree.points_under(contested.select(*NODE_KEY, "first_plane", "second_plane"), keyed, layer,
                               keep=["first_plane", "second_plane"])
    edge = claims.split_points(edge, middles).select(*PLANE, "pid", "x", "y", "z")
    # planes that own only contested nodes are dropped
    owners = single.select(*PLANE).distinct()
    pts = stage(whole.unionByName(edge.join(owners, PLANE, "left_semi")))
    big = pts.groupBy(*PLANE).agg(F.count("*").alias("c")).filter(F.col("c") > p.min_points_in_cc).select(*PLANE)
    pts = stage(pts.join(big, PLANE, "left_semi"))
    keep = book.structures.select(*PLANE, "thr", "layer")
    refit = stage(fit.pca_planes(pts, PLANE).select(*PLANE, "nx", "ny", "nz", "d").join(keep, PLANE))
    out = Book(segmented=book.segmented)
    table, cells = describe(refit, pts, p.cell_size(layer))
    out.structures, out.cells = stage(table), stage(cells)
    out.assignment = [pts.select("scan_id", "pid", "plane_id")]
    return out
