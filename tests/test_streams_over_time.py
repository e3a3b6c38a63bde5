"""Streams over several batches: frames in any order, a real segmentation, restarts, closed windows and compaction."""

from pyspark.sql import functions as F

from facetry.params import SegParams
from facetry.streaming import streams

FRAME = "sensor_id bigint, frame_ts timestamp, scan_id bigint, pid bigint, x double, y double, z double, rgb bigint, intensity double"
PEEL = SegParams(consensus_only=True, sac_iterations=30, min_sac_distance=0.15, min_points_in_cc=40, min_octree_nodes=3, min_octree_resolution=0.25)


def frame(spark, sensor, second, scan, wall):
    return spark.range(160).selectExpr(
        f"{sensor}L as sensor_id", f"timestamp'2024-01-01 00:00:{second:02d}' as frame_ts", f"{scan}L as scan_id", "id as pid", f"{wall}D as x",
        "(id*7919 % 101)/50.5D - 1D as y", "(id*104729 % 97)/48.5D - 1D as z", "0L as rgb", "0D as intensity")


def run(spark, source, checkpoint, seen):
    q = streams.segment_stream(streams.point_stream(spark, source, FRAME), PEEL, lambda seg, pts, batch: seen.append(
        (batch, sorted(r.scan_id for r in pts.select("scan_id").distinct().collect()),
         sorted((r.scan_id, round(r.d, 3)) for r in seg.structures.select("scan_id", "d").collect()))), checkpoint)
    q.trigger(availableNow=True).start().awaitTermination(240)


def test_older_frame_of_a_later_batch_is_dropped(spark, tmp_path):
    source, checkpoint, seen = str(tmp_path / "in"), str(tmp_path / "ck"), []
    frame(spark, 1, 5, 10, 0.7).write.mode("append").parquet(source)
    run(spark, source, checkpoint, seen)
    frame(spark, 1, 4, 11, 0.8).unionByName(frame(spark, 2, 1, 20, 1.2)).write.mode("append").parquet(source)
    run(spark, source, checkpoint, seen)
    frame(spark, 1, 6, 12, 0.9).unionByName(frame(spark, 2, 1, 21, 1.3)).write.mode("append").parquet(source)
    run(spark, source, checkpoint, seen)
    # frame 11 is older than 10, frame 21 is not newer than 20
    assert [s[1:] for s in seen] == [([10], [(10, 0.7)]), ([20], [(20, 1.2)]), ([12], [(12, 0.9)])]


def test_repeated_batch_sees_the_same_frames(spark, tmp_path):
    memory = streams.FrameMemory(str(tmp_path / "frames"))
    for batch, second in ((0, 3), (1, 2), (2, 9)):
        frames = memory.unseen(frame(spark, 1, second, batch, 1.0), batch)
        memory.keep(frames, batch)
    for batch, second, want in ((0, 3, 160), (1, 2, 0), (2, 9, 160)):
        assert memory.unseen(frame(spark, 1, second, batch, 1.0), batch).count() == want


P = SegParams(rho_max=4.0, min_octree_resolution=0.25, sq_dist_factor=-1.0)


def events(spark, first, last, day, scan=0):
    return spark.range(first, last).selectExpr("id as pid", f"timestamp'2024-01-0{day} 10:00:00' + make_interval(0,0,0,0,0,cast(id % 5 as int),0) as ts",
                                               f"{scan}L as scan_id", "(id % 9)/4D as x", "(id % 7)/4D as y", "(id % 5)/4D as z")


def sums(df):
    return sorted((r.w.start, r.scan_id, r.lx, r.ly, r.lz, r.n, round(r.sx, 6), round(r.syz, 6)) for r in df.collect())


def test_restart_gives_the_batch_result(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    parts = [events(spark, 0, 90, 1), events(spark, 90, 150, 1, 1), events(spark, 150, 300, 2)]
    schema, held = parts[0].schema, streams.MomentMap(f"{folder}/map", P)
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(source)
        got = streams.drained(spark.readStream.schema(schema).parquet(source), folder, P)  # a new start each time
        if i == 1:
            held.compact(spark)
    want = sums(streams.cell_moments(spark.read.schema(schema).parquet(source), P))
    assert sums(got) == want
    held.compact(spark)
    held.compact(spark)
    assert sums(held.moments(spark)) == want
    late = events(spark, 300, 340, 1)  # the window of day 1 is closed by day 2
    late.unionByName(events(spark, 340, 350, 2)).coalesce(1).write.mode("append").parquet(source)
    got = streams.drained(spark.readStream.schema(schema).parquet(source), folder, P)
    assert sum(r[5] for r in sums(got)) == 310
    assert held.progress(spark).agg(F.sum("dropped")).first()[0] == 40


def test_repeated_batch_replaces_its_part(spark, tmp_path):
    held = streams.MomentMap(str(tmp_path / "map"), P)
    for batch in (0, 1, 1, 1):
        held.add(events(spark, batch * 50, batch * 50 + 50, 1), batch)
    assert sum(r[5] for r in sums(held.moments(spark))) == 100
