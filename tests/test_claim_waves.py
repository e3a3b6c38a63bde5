"""Claims in waves against one plane after the other."""

import random

import pytest

from facetry.operators import claims

KEY = ["scan_id", "ix"]


def one_after_the_other(candidates, old, least):
    """Plain version: planes in rank order, each takes the free candidates in the component of its first grid cell."""
    taken, out = set(), set()
    for scan, plane, _ in sorted({(s, p, r) for s, _, p, r, _, _ in candidates}, key=lambda t: (t[0], t[2])):
        mine = [(n, x, y) for s, n, p, _, x, y in candidates if (s, p) == (scan, plane) and (s, n) not in taken]
        grid = {(x, y) for s, p, x, y in old if (s, p) == (scan, plane)}
        cells, front = grid | {(x, y) for _, x, y in mine}, [min(grid)]
        seen = set(front)
        while front:
            x, y = front.pop()
            near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & cells - seen
            seen |= near
            front += near
        got = [n for n, x, y in mine if (x, y) in seen]
        if len(got) > least:
            taken |= {(scan, n) for n in got}
            out |= {(scan, n, plane) for n in got}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_waves_claim_as_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    old = [(s, p, p * 3 + i, j) for s in (0, 1) for p in range(5) for i in range(2) for j in range(2)]
    rows = {}
    for s in (0, 1):
        for n in range(90):
            for p in rng.sample(range(5), rng.choice([1, 1, 2, 3])):
                rows[s, n, p] = (s, n, p, (p * 7 + s) % 5, p * 3 + rng.randrange(-2, 4), rng.randrange(-3, 5))
    cand = spark.createDataFrame(list(rows.values()), "scan_id bigint, ix bigint, plane_id bigint, rank int, cx bigint, cy bigint")
    cells = spark.createDataFrame(old, "scan_id bigint, plane_id bigint, cx bigint, cy bigint")
    got = {(r.scan_id, r.ix, r.plane_id) for r in claims.claim_waves(cand, cells, KEY, 3).collect()}
    assert got == one_after_the_other(list(rows.values()), old, 3) and got


def test_later_plane_loses_its_bridge(spark):
    """A node that an earlier plane takes no longer connects a later plane to its far nodes."""
    cand = [(0, 1, 7, 0, 1, 0), (0, 1, 8, 1, 1, 0), (0, 2, 8, 1, 2, 0), (0, 3, 8, 1, 3, 0)]
    df = spark.createDataFrame(cand, "scan_id bigint, ix bigint, plane_id bigint, rank int, cx bigint, cy bigint")
    cells = spark.createDataFrame([(0, 7, 0, 0), (0, 8, 0, 0)], "scan_id bigint, plane_id bigint, cx bigint, cy bigint")
    assert {(r.ix, r.plane_id) for r in claims.claim_waves(df, cells, KEY, 0).collect()} == {(1, 7)}


def test_no_candidates(spark):
    df = spark.createDataFrame([], "scan_id bigint, ix bigint, plane_id bigint, rank int, cx bigint, cy bigint")
    cells = spark.createDataFrame([], "scan_id bigint, plane_id bigint, cx bigint, cy bigint")
    assert claims.claim_waves(df, cells, KEY, 0).count() == 0
