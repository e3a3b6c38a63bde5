"""Properties and small fixtures checked against brute force."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry import session
from facetry.functions import geometry as G
from facetry.functions.moments import moment_aggs, with_eigen
from facetry.functions.vec import v
from facetry.operators import assign, claims, evaluate, fit, grid, octree, spatial, sphere
from facetry.operators.components import cell_components, connected_components
from facetry.params import SegParams


def test_params_text_keeps_tail():
    p = SegParams.from_text("0.3 1.5 1.0 0.05 0.01 0.075 0.7 0.005 -0.002 50")
    assert p.max_ht_distance == 0.3 and p.phi_resolution == 50 and p.tries_on_each_depth == 25
    assert p.depth == 13 and SegParams.from_service({"RhoMax": "10", "MinNodesInCC": 4}).min_nodes_in_cc == 4


def test_param_sets_and_file(spark, tmp_path):
    from facetry.params import sweep_table
    f = tmp_path / "a.params"
    f.write_text("0.2\n2.0\n1.0\n0.1\n0.02\n")
    p = SegParams.from_file(spark, str(f))
    assert (p.max_sac_distance, p.min_sac_distance, p.sac_octree_factor) == (0.1, 0.02, 0.1)
    assert sweep_table(spark, {"a": p, "b": SegParams()}).count() == 2


def test_eigen_matches_numpy(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(400, 3)) * [1.0, 0.5, 0.01]
    rows = [(i % 4, *map(float, p)) for i, p in enumerate(pts)]
    got = with_eigen(spark.createDataFrame(rows, "g int, x double, y double, z double").groupBy("g").agg(*moment_aggs())).collect()
    for r in got:
        w, vec = np.linalg.eigh(np.cov(pts[r.g::4].T, bias=True))
        assert np.allclose([r.l0, r.l1, r.l2], w, atol=1e-9)
        assert abs(abs(np.dot(vec[:, 0], [r.ex, r.ey, r.ez])) - 1) < 1e-9


def test_moments_do_not_depend_on_partitioning(spark):
    df = spark.range(2000).selectExpr("id % 3 as scan_id", "id as pid", "sin(id) as x", "cos(id*7) as y", "id/2000D as z")
    p = SegParams(min_octree_resolution=0.5, rho_max=4.0, sq_dist_factor=-1.0)
    a = octree.leaf_moments(octree.with_keys(df, p)).orderBy(*octree.LEAF).collect()
    b = octree.leaf_moments(octree.with_keys(df.repartition(7), p)).orderBy(*octree.LEAF).collect()
    assert [(r.lx, r.n) for r in a] == [(r.lx, r.n) for r in b]
    assert np.allclose([r.sxx for r in a], [r.sxx for r in b])
    tops = octree.roll_up(octree.leaf_moments(octree.with_keys(df, p)), [0]).agg(F.sum("n")).first()[0]
    assert tops == 2000


@pytest.mark.parametrize("n", [(0, 0, 1), (0, 0, -1), (0.6, 0, 0.8), (0, -1, 0)])
def test_frame_is_a_rotation_onto_z(spark, n):
    d = spark.createDataFrame([tuple(map(float, n))], "nx double, ny double, nz double").select(
        *(c.alias(k) for k, c in G.frame_columns(v("n")).items())).first()
    m = np.array(d).reshape(3, 3)
    assert np.allclose(m @ m.T, np.eye(3)) and np.allclose(m @ n, [0, 0, 1]) and abs(np.linalg.det(m) - 1) < 1e-12


def test_votes_match_full_scan(spark):
    rng = np.random.default_rng(3)
    dirs = rng.normal(size=(60, 3))
    dirs = np.vstack([dirs / np.linalg.norm(dirs, axis=1)[:, None], [[0, 0, 1], [0, 0, -1], [1, 0, 0]]])
    bins = sphere.bin_rows(25)
    assert len(bins) == 817
    b = np.array([r[2:] for r in bins])
    df = spark.createDataFrame([(i, *map(float, d)) for i, d in enumerate(dirs)], "id int, nx double, ny double, nz double")
    for fold in (True, False):
        got = {(r.id, r.bi, r.bj) for r in sphere.cap_bins(df, 25, math.pi / 10, fold).collect()}
        dots = dirs @ b.T
        hit = (np.abs(dots) if fold else dots) >= math.cos(math.pi / 10)
        assert got == {(int(i), bins[k][0], bins[k][1]) for i, k in zip(*np.nonzero(hit))}


def brute_components(cells):
    left, out = set(cells), {}
    while left:
        todo = [min(left)]
        left.discard(todo[0])
        seen = list(todo)
        while todo:
            x, y = todo.pop()
            for c in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if c in left:
                    left.discard(c)
                    todo.append(c)
                    seen.append(c)
        out.update({c: min(seen) for c in seen})
    return out


def test_components_across_blocks(spark):
    random.seed(5)
    cells = {(x, y) for x in range(-70, 140) for y in range(-10, 80) if random.random() < 0.42}
    cells |= {(x, 200) for x in range(-100, 300)}
    df = spark.createDataFrame([(1, x, y) for x, y in cells], "g int, cx bigint, cy bigint")
    got = cell_components(df, ["g"]).collect()
    want = brute_components(cells)
    first = {}
    for r in got:
        root = want[(r.cx, r.cy)]
        assert first.setdefault(r.comp, root) == root
    assert len(first) == len(set(want.values()))


def test_general_components(spark):
    edges = [(1, i, i + 1) for i in range(50)] + [(1, 100, 101), (2, 7, 9)]
    got = {(r.g, r.node): r.root for r in connected_components(spark.createDataFrame(edges, "g int, a bigint, b bigint"), ["g"]).collect()}
    assert got[(1, 50)] == 0 and got[(1, 101)] == 100 and got[(2, 9)] == 7


def test_window_is_half_open(spark):
    cells = spark.createDataFrame([(1, 0, 0)], "g int, cx bigint, cy bigint")
    probe = spark.createDataFrame([(1, x, 0) for x in range(-4, 5)], "g int, cx bigint, cy bigint")
    assert sorted(r.cx for r in grid.touching(probe, cells, ["g"], 2).collect()) == [-1, 0, 1, 2]


def test_plane_blocks_cover_every_near_point(spark):
    rng = np.random.default_rng(8)
    p = SegParams(rho_max=4.0, min_octree_resolution=0.25, sq_dist_factor=-1.0)
    normals = rng.normal(size=(12, 3))
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    planes = [(0, i, *map(float, n), float(d), 0.1) for i, (n, d) in enumerate(zip(normals, rng.uniform(0, 2, 12)))]
    pts = rng.uniform(-3.9, 3.9, size=(3000, 3))
    nodes = spark.createDataFrame([(0, i, *map(float, q)) for i, q in enumerate(pts)], "scan_id int, node int, mx double, my double, mz double")
    tab = spark.createDataFrame(planes, "scan_id int, plane_id int, nx double, ny double, nz double, d double, thr double")
    got = {(r.node, r.plane_id) for r in claims.near_planes(nodes, tab, p, 0.05).collect()}
    want = {(i, j) for i, q in enumerate(pts) for j, (n, pl) in enumerate(zip(normals, planes)) if abs(q @ n - pl[5]) <= 0.1}
    assert got == want


def test_radius_moments_count_copies(spark):
    rows = [(0, i, float(x), 0.0, 0.0) for i, x in enumerate([0.0, 0.0, 0.0, 0.05, 0.3])]
    df = spark.createDataFrame(rows, "scan_id int, pid bigint, x double, y double, z double")
    got = {r.pid: r.n for r in spatial.radius_moments(df, df, 0.1, ["pid"]).collect()}
    assert got == {0: 4, 1: 4, 2: 4, 3: 4, 4: 1}


def dense_cloud(n, seed):
    """A ball, a sheet, a pile of copies and stray points; a third of all rows lies in one cell."""
    rng = np.random.default_rng(seed)
    ball = rng.normal(scale=0.02, size=(n // 3, 3)) + [0.05, 0.05, 0.05]
    sheet = np.column_stack([rng.uniform(-0.3, 0.3, (n // 3, 2)), np.zeros(n // 3)])
    return np.vstack([ball, sheet, np.full((50, 3), -0.07), [[0.0, 0.0, 0.1], [0.0, 0.0, -0.1], [5.0, 5.0, 5.0]]])


def cloud_frame(spark, pts):
    return spark.createDataFrame([(0, i, *map(float, q)) for i, q in enumerate(pts)], "scan_id int, pid bigint, x double, y double, z double")


def test_radius_moments_of_dense_cells_equal_brute_force(spark):
    pts = dense_cloud(3000, 4)
    df = cloud_frame(spark, pts)
    assert len(spatial.radius_hits(df, df, 0.1, ["pid"])) > 2
    got = {r.pid: r for r in spatial.radius_moments(df, df, 0.1, ["pid"]).collect()}
    assert len(got) == len(pts)
    for i, q in enumerate(pts):
        d = (pts - q) ** 2
        near = pts[d[:, 0] + d[:, 1] + d[:, 2] <= 0.1 * 0.1]
        r = got[i]
        assert r.n == len(near)
        assert np.allclose([r.sx, r.sy, r.sz], near.sum(axis=0)) and np.allclose([r.sxy, r.szz], [near[:, 0] @ near[:, 1], near[:, 2] @ near[:, 2]])


def test_radius_rows_grow_slower_than_pairs(spark):
    rows, pairs = [], []
    for n in (1500, 6000):
        pts = np.random.default_rng(n).uniform(0, 0.2, (n, 3))
        df = cloud_frame(spark, pts)
        rows.append(sum(h.count() for h in spatial.radius_hits(df, df, 0.1, ["pid"])))
        pairs.append(spatial.radius_moments(df, df, 0.1, ["pid"]).agg(F.sum("n")).first()[0])
    assert pairs[1] > 14 * pairs[0] and rows[1] < 11 * rows[0] and rows[1] < pairs[1] / 2


def test_radius_blocks_of_any_size_equal_brute_force(spark):
    pts = dense_cloud(1500, 5)
    odd = spark.createDataFrame([(0, 9001, float("nan"), 0.0, 0.0), (0, 9002, 0.0, float("inf"), 0.0), (0, 9003, 0.0, 0.0, None), (None, 9004, 0.0, 0.0, 0.0)],
                                "scan_id int, pid bigint, x double, y double, z double")
    df = cloud_frame(spark, pts).union(odd)
    near = [(((pts - q) ** 2) @ np.ones(3) <= 0.1 * 0.1).sum() for q in pts]
    for in_block in (10**6, 900, 300, 1):  # whole, halved blocks, crowded cells, crowded cells only
        got = {r.pid: r.n for r in spatial.radius_moments(df, df, 0.1, ["pid"], in_block=in_block).collect()}
        assert got == dict(enumerate(near)), in_block


def stored_bytes(spark):
    folder = Path(session.shared_folder(spark).removeprefix("file:"))
    return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())


def test_radius_moments_store_no_rows_for_pairs(spark):
    pts = np.column_stack([np.random.default_rng(8).uniform(0, 0.5, (8000, 2)), np.zeros(8000)])
    df = cloud_frame(spark, pts)
    before = stored_bytes(spark)
    assert spatial.radius_moments(df, df, 0.1, ["pid"]).agg(F.sum("n")).first()[0] > 5_000_000
    assert stored_bytes(spark) - before < 100 * len(pts)


def test_crowded_cells_store_no_rows_for_boxes(spark, monkeypatch):
    """Cells beyond the limit of a block stored a row for each query and cut box; now positions pass the queries in chunks."""
    monkeypatch.setattr(spatial, "QUERIES_HELD", 900)
    monkeypatch.setattr(spatial, "CHUNK", 500)
    pts = np.column_stack([np.random.default_rng(9).uniform(0, 0.5, (4000, 2)), np.zeros(4000)])
    pts = np.vstack([pts, np.full((1500, 3), 0.25)])
    df = cloud_frame(spark, pts)
    before = stored_bytes(spark)
    got = {r.pid: (r.n, r.sx, r.sxy) for r in spatial.radius_moments(df, df, 0.1, ["pid"], in_block=100).collect()}
    assert stored_bytes(spark) - before < 100 * len(pts)
    assert len(got) == len(pts)
    for i in range(0, len(pts), 11):
        near = pts[((pts - pts[i]) ** 2) @ np.ones(3) <= 0.1 * 0.1]
        assert got[i][0] == len(near) and np.allclose(got[i][1:], [near[:, 0].sum(), near[:, 0] @ near[:, 1]])


def test_radius_moments_of_nothing(spark):
    df = cloud_frame(spark, dense_cloud(30, 1))
    none = df.limit(0)
    assert spatial.radius_moments(none, df, 0.1, ["pid"]).count() == 0 and spatial.radius_moments(df, none, 0.1, ["pid"]).count() == 0


def test_rows_are_not_dealt_by_grid_to_meet_its_origin(spark, capsys):
    rows = spark.range(2_000_000).selectExpr("id % 2 as scan_id", "id / 7 as u", "-id / 3 as v")
    placed = grid.with_cells(rows, grid.origins(rows, ["scan_id"]), ["scan_id"], 0.5)
    capsys.readouterr()
    placed.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(scan_id" not in plan and "BroadcastHashJoin" in plan
    assert placed.agg(F.min("cx"), F.min("cy")).first() == (0, 0)


def brute_classes(table, t):
    """The rule order spelled out on one image's overlap counts."""
    gts, mss = sorted({g for _, g in table if g >= 10}), sorted({m for m, _ in table if m >= 10})
    gsize = {g: sum(c for (_, q), c in table.items() if q == g) for g in gts}
    msize = {m: sum(c for (q, _), c in table.items() if q == m) for m in mss}
    o = lambda m, g: table.get((m, g), 0)
    gc, mc, gm, mm = {}, {}, {}, {}
    for g in gts:
        for m in mss:
            a, b = o(m, g) / gsize[g], o(m, g) / msize[m]
            if a >= t and b >= t:
                gc[g] = mc[m] = "correct"
                gm[g] = mm[m] = (a, b)
    for g in gts:
        part = [m for m in mss if o(m, g) / msize[m] >= t]
        if len(part) > 1:
            inside = sum(o(m, g) for m in part)
            a, b = inside / gsize[g], inside / sum(msize[m] for m in part)
            if a >= t and b >= t and (g not in gc or sum((a, b)) > sum(gm[g])):
                gc[g], gm[g] = "over", (a, b)
                for m in part:
                    mc[m], mm[m] = "over", (a, b)
    for m in mss:
        part = [g for g in gts if o(m, g) / gsize[g] >= t]
        if len(part) > 1:
            inside = sum(o(m, g) for g in part)
            a, b = inside / sum(gsize[g] for g in part), inside / msize[m]
            if a >= t and b >= t and (m not in mc or sum((a, b)) > sum(mm[m])):
                mc[m], mm[m] = "under", (a, b)
                for g in part:
                    gc[g], gm[g] = "under", (a, b)
    return {g: gc.get(g, "missed") for g in gts}, {m: mc.get(m, "noise") for m in mss}


def test_region_classes_match_rules(spark):
    random.seed(11)
    tables, rows = [], []
    for image in range(40):
        t = {}
        for m in range(10, 16):
            for g in range(10, 16):
                c = random.choice([0, 0, 0, 1, 2, 40, 60, 100])
                if c:
                    t[(m, g)] = c
        tables.append(t)
        rows += [(image, m, g, c) for (m, g), c in t.items()]
    df = spark.createDataFrame(rows, "image_id bigint, ms bigint, gt bigint, pixels bigint")
    for t in (0.51, 0.8):
        g, m = evaluate.classify(df, t)
        got_g = {(r.image_id, r.gt): r["class"] for r in g.collect()}
        got_m = {(r.image_id, r.ms): r["class"] for r in m.collect()}
        for image, tab in enumerate(tables):
            want_g, want_m = brute_classes(tab, t)
            assert {k: c for (i, k), c in got_g.items() if i == image} == want_g
            assert {k: c for (i, k), c in got_m.items() if i == image} == want_m
    with pytest.raises(ValueError):
        evaluate.classify(df, 0.5)


def test_numbering_is_whole_across_ranges(spark):
    from facetry.sinks import tables
    df = spark.range(0, 200_000, 3).selectExpr("0L as scan_id", "id as pid")
    r = tables.numbered(df).agg(F.min("num"), F.max("num"), F.countDistinct("num"), F.count("*")).first()
    assert (r[0], r[1], r[2]) == (0, r[3] - 1, r[3])


def test_label_rules_raise(spark):
    bad = spark.createDataFrame([(0, 0, 0, 10), (0, 0, 1, 12)], "image_id int, r int, c int, gt int")
    with pytest.raises(ValueError):
        evaluate.check(bad, "gt")


def test_update_lists_only_changes(spark):
    old = spark.createDataFrame([(0, 1, 5), (0, 2, 5)], "scan_id int, pid int, structure_id int")
    new = spark.createDataFrame([(0, 2, 5), (0, 3, 7)], "scan_id int, pid int, structure_id int")
    merged, changed = assign.update(old, new)
    assert merged.count() == 3 and [(r.pid, r.old_id, r.new_id) for r in changed.collect()] == [(3, None, 7)]


def test_draws_are_different_combinations(spark):
    """As many hypotheses as asked for, or all there are; a new seed draws anew."""
    rows = [(g, i, float(i), float(i * i), float(g)) for g, n in ((0, 20), (1, 60), (2, 2)) for i in range(n)]
    pool = fit.sample_pools(spark.createDataFrame(rows, "scan_id long, pid long, x double, y double, z double"), ["scan_id"], 50)
    assert {r.scan_id: r["count"] for r in pool.groupBy("scan_id").count().collect()} == {0: 20, 1: 50, 2: 2}

    def combinations(width, seed):
        got = {}
        for r in fit.drawn(pool, ["scan_id"], 2000, width, seed).collect():
            got.setdefault(r.scan_id, set()).add(frozenset(r[c].x for c in "abc"[:width]))
            assert len({r[c].x for c in "abc"[:width]}) == width
        return got

    first = combinations(3, 0)
    assert {g: len(c) for g, c in first.items()} == {0: 20 * 19 * 18 // 6, 1: 2000}
    assert len(first[1] & combinations(3, 1)[1]) < 1000
    assert {g: len(c) for g, c in combinations(2, 5).items()} == {0: 190, 1: 1225, 2: 1}
