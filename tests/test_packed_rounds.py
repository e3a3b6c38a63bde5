"""Consensus rounds over packed points: same draws, counts and owners as over rows, and no points written again."""

from pyspark.sql import functions as F

from facetry.operators import fit, packed
from facetry.plans import cylinders
from facetry.session import stage

from .test_extraction import CYL, cylinder_cloud

KEYS = ["scan_id"]


def oriented(spark, n=6000):
    """Two crossing cylinders of two scans, with some points without a normal."""
    d = spark.range(n).selectExpr("id % 2 as scan_id", "id as pid", "id*3.883222D as t", "(id % 500)/250D - 1D as h", "id % 4 < 2 as up")
    d = d.selectExpr("scan_id", "pid", "if(up, 0.5D + 0.3D*cos(t), h) as x", "0.2D + 0.3D*sin(t) as y", "if(up, h, 0.3D*cos(t)) as z",
                     "if(pid % 50 = 0, cast(null as double), if(up, cos(t), 0D)) as nx", "sin(t) as ny", "if(up, 0D, cos(t)) as nz")
    return stage(d)


def hypotheses(points, count=200):
    pool = fit.sample_pools(points.filter("nx is not null"), KEYS, 2 * count, ("nx", "ny", "nz"), 3)
    return stage(fit.cylinder_hypotheses(pool, KEYS, count, 0.01, 2.0, 3))


def rows(d):
    return sorted(map(tuple, d.collect()))


def test_draw_numbers_are_those_of_the_rows(spark):
    d = spark.sql("select id*id*id - 5000000 as pid from range(2000)")
    for seed in (0, 3, 1 << 20):
        got = d.select("pid", F.expr(fit.draw_order(seed)).alias("o")).toPandas()
        assert (fit.draw_numbers(got["pid"].to_numpy(), seed) == got["o"]).all()


def test_best_of_packed_points_is_that_of_the_rows(spark):
    pts = oriented(spark)
    hyps, blocks = hypotheses(pts), packed.pack(pts, KEYS)
    assert {tuple(r) for r in packed.sizes(blocks, KEYS).collect()} == {(0, 3000, 2880), (1, 3000, 3000)}
    best = packed.best_cylinders(blocks, hyps, None, KEYS, 0.02, 0.1)
    want = fit.score_cylinders(pts.filter("nx is not null"), hyps, KEYS, "0.02D", 0.1)
    assert rows(best) == rows(want.select(best.columns))
    # what the best ones took is no longer counted, drawn or owned by others
    made = best.withColumn("cylinder_id", F.lit(7).cast("bigint"))
    taken = packed.lists(made, KEYS)
    usable = pts.filter("nx is not null")
    gone = fit.cylinder_inliers(usable, best, KEYS, "0.02D", 0.1)
    left = stage(usable.join(gone.select("scan_id", "pid"), ["scan_id", "pid"], "left_anti"))
    second = packed.best_cylinders(blocks, hyps, taken, KEYS, 0.02, 0.1)
    assert rows(second) == rows(fit.score_cylinders(left, hyps, KEYS, "0.02D", 0.1).select(second.columns))
    sets = left.groupBy("scan_id").agg(F.count("*").alias("usable"))
    assert rows(packed.pools(blocks, sets, taken, KEYS, 100, 0.02, 0.1, 5)) == rows(fit.sample_pools(left, KEYS, 100, ("nx", "ny", "nz"), 5))
    more = second.withColumn("cylinder_id", F.lit(9).cast("bigint"))
    both = packed.owned(blocks, made.unionByName(more), more, KEYS, 0.02, 0.1)
    assert rows(both.select("scan_id", "pid")) == rows(fit.cylinder_inliers(left, second, KEYS, "0.02D", 0.1).select("scan_id", "pid"))


def test_rounds_write_no_points_again(spark, monkeypatch):
    written = []

    def counted(df, *args):
        out = stage(df, *args)
        if dict(df.dtypes).get("pid") == "bigint":
            written.append(out.count())
        return out

    for module in (cylinders, packed, fit):
        monkeypatch.setattr(module, "stage", counted)
    pts = cylinder_cloud(spark)
    book = cylinders.peel_cylinders(pts, CYL)
    owned = sum(a.count() for a in book.assignment)
    # the rows of the normals, of the inliers and of the rest were written in each round; now a pool and the owners
    assert owned > 1000 and sum(written) < owned + 2 * 110 * 20
    assert len(written) < 12
