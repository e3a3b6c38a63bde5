"""Hypotheses scored by boxes of neighbouring points against the test of every point, the blocks of large groups, and shared points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import fit


def cloud(n):
    """Half a tube, half noise with any normals."""
    rng = np.random.default_rng(n)
    turn, far = rng.uniform(0, 2 * np.pi, n), 0.3 + rng.uniform(-0.0015, 0.0015, n)
    rows = np.stack([0.3 + far * np.cos(turn), far * np.sin(turn) - 0.2, rng.uniform(-1, 1, n), np.cos(turn), np.sin(turn), 0 * turn], axis=1)
    normal = rng.normal(size=(n // 2, 3))
    rows[:n // 2] = np.concatenate([rng.uniform(-1.5, 1.5, (n // 2, 3)), normal / np.linalg.norm(normal, axis=1)[:, None]], axis=1)
    return rng, rows


@pytest.mark.parametrize("n", [1, 17, 300, 6000])
def test_cylinder_counts_are_those_of_single_points(n):
    rng, rows = cloud(n)
    axis = rng.normal(size=(120, 3)) * np.where(np.arange(120) % 2, 1, 0.05)[:, None] + [0, 0, 1.0]
    axis /= np.linalg.norm(axis, axis=1)[:, None]
    shapes = np.concatenate([[0.3, -0.2, 0] + rng.normal(size=(120, 3)) * 0.02, axis, 0.3 + rng.normal(size=(120, 1)) * 0.02], axis=1)
    limit, want = np.where(np.arange(n) % 3, 0.05, 0.02), []
    for s in shapes:
        q = rows[:, :3] - s[:3]
        o = q - np.outer(q @ s[3:6], s[3:6])
        dist = np.sqrt((o * o).sum(axis=1))
        turn = np.arccos(np.clip((o * rows[:, 3:]).sum(axis=1) / dist, -1, 1))
        want.append(-np.count_nonzero(0.9 * np.abs(dist - s[6]) + 0.1 * np.minimum(turn, np.pi - turn) < limit))
    assert fit.cylinder_cost(0.1)(rows, limit)(shapes).tolist() == want


@pytest.mark.parametrize("n", [1, 600, 6000])
def test_plane_counts_are_those_of_single_points(n):
    rng, rows = cloud(n)
    planes = rng.normal(size=(200, 4))
    planes[:, :3] /= np.linalg.norm(planes[:, :3], axis=1)[:, None]
    rows[0, 0] = np.nan
    off = np.abs(rows[:, :3] @ planes[:, :3].T - planes[:, 3])
    assert fit.plane_cost("count")(rows[:, :3], np.full(n, 0.05))(planes).tolist() == (-(off < 0.05).sum(axis=0)).tolist()


def test_blocks_hold_neighbours_and_are_bounded(spark, monkeypatch):
    """A crowded cell is split; all blocks are named, and no block holds many more points than asked for."""
    monkeypatch.setattr(fit, "BLOCK_POINTS", 200)
    pts = spark.range(3000).selectExpr("id as pid", "id % 2 as scan_id", *(
        f"if(id < 1500, 0.01D, (id*{m} % 997)/997D) as {a}" for a, m in (("x", 7919), ("y", 104729), ("z", 611953))))
    rows, blocks = fit._dealt(pts, ["scan_id"], ["x", "y", "z"], "0.1D")
    rows = rows.toPandas()
    assert len(rows) == 3000 and rows.groupby(["scan_id", "_b"]).size().max() < 500
    known = {(r.scan_id, r["_b"]) for r in blocks.collect()}
    assert set(zip(rows["scan_id"], rows["_b"])) <= known
    whole = rows[rows["_b"] >= 0]
    side = whole.groupby("scan_id")["_b"].nunique()
    assert len(whole) > 1000 and side.min() > 1


def test_sets_share_their_points(spark):
    """Sets of a scan give the planes they give with a copy of the points each."""
    pts = spark.range(1200).selectExpr("id as pid", "id % 2 as scan_id", "(id*7919 % 997)/997D as x", "(id*104729 % 991)/991D as y",
                                       "if(id % 3 = 0, 0.5D, (id*611953 % 983)/983D) as z")
    sets = spark.range(6).selectExpr("id % 2 as scan_id", "id div 2 as attempt")
    keys = ["scan_id", "attempt"]
    for count in (20, 400):  # a pool of a part of the points, and of all
        got = [fit.msac_planes(p, keys, "0.02D", count, "count", "attempt", s) for p, s in ((pts, sets), (pts.join(sets, "scan_id"), None))]
        shapes = [sorted(tuple(r) for r in f.select(*keys, "n", *(F.round(c, 9) for c in ("nx", "ny", "nz", "d"))).collect()) for f, _ in got]
        held = [sorted(tuple(r) for r in m.select(*keys, "pid").collect()) for _, m in got]
        assert shapes[0] == shapes[1] and len(shapes[0]) == 6 and held[0] == held[1]


def test_cylinder_counts_by_products_are_those_of_single_points():
    """Tiles of points meet cylinders in products of matrices; before, every cylinder went down the boxes."""
    rng = np.random.default_rng(6)
    turn = rng.uniform(0, 2 * np.pi, 1500)
    tube = np.column_stack([0.3 + 0.3 * np.cos(turn), -0.2 + 0.3 * np.sin(turn), rng.uniform(-1, 1, 1500), np.cos(turn), np.sin(turn), np.zeros(1500)])
    noise = np.column_stack([rng.uniform(-1.5, 1.5, (700, 3)), rng.normal(size=(700, 3))])
    points = np.vstack([tube, noise, np.full((40, 6), 0.1), [[np.nan] * 6, [0.3, -0.2, 0.0, 0.0, 0.0, 1.0]]])
    points[:, 3:] /= np.linalg.norm(points[:, 3:], axis=1)[:, None]
    axes = rng.normal(size=(60, 3))
    shapes = np.column_stack([rng.uniform(-1, 1, (60, 3)), axes / np.linalg.norm(axes, axis=1)[:, None], rng.uniform(0.001, 3, 60)])
    shapes = np.vstack([shapes, [[0.3, -0.2, 50.0, 0.0, 0.0, 1.0, 0.3], [0.3, -0.2, 0.0, 0.0, 0.0, 1.0, 0.001], [np.nan] * 7]])
    for weight in (0.0, 0.001, 0.1, 1.0):
        for limit in (0.05, 0.3, 2.0):
            got = fit.cylinder_counts(weight)(points, np.full(len(points), limit))(shapes)
            want = [np.count_nonzero(fit.cylinder_hits(points[:, :3].T, points[:, 3:].T, s, limit, weight)) for s in shapes]
            assert got.tolist() == want, (weight, limit)


def test_plane_counts_in_single_precision_are_exact():
    """Points at the limit, far from the origin, are counted as in double precision."""
    rng = np.random.default_rng(7)
    points = rng.uniform(-1, 1, (3000, 3)) + [1000.0, -2000.0, 500.0]
    points[::7, 2] = 500.05 + rng.choice([-1e-9, 0.0, 1e-9], len(points[::7]))
    normals = rng.normal(size=(50, 3))
    normals = np.vstack([normals / np.linalg.norm(normals, axis=1)[:, None], [[0.0, 0.0, 1.0]]])
    planes = np.column_stack([normals, (normals * np.vstack([points[:50], [[0.0, 0.0, 500.0]]])).sum(axis=1)])
    got = fit.plane_cost("count")(points, np.full(len(points), 0.05))(planes)
    assert (-got).tolist() == [np.count_nonzero(np.abs(points @ n[:3] - n[3]) < 0.05) for n in planes]
