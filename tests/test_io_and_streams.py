"""Readers, writers and streams on small written files."""

import io
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.catalog.views import load
from facetry.operators import evaluate, fit, raster
from facetry.params import SegParams
from facetry.sinks import files as out
from facetry.sinks import tables
from facetry.sources import camera
from facetry.sources import files as src
from facetry.streaming import streams


def cloud(mode, rows):
    head = ("# cloud\nVERSION .7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\n"
            f"WIDTH 2\nHEIGHT {len(rows) // 2}\nPOINTS {len(rows)}\nDATA {mode}\n").encode()
    if mode == "ascii":
        lines = []
        for x, y, z, c in rows:
            bits = struct.unpack("<f", struct.pack("<I", c))[0]
            lines.append(f"{x} {y} {z} {bits!r}")
        return head + "\n".join(lines).encode() + b"\n"
    if mode == "binary_compressed":
        columns = list(zip(*rows))
        body = b"".join(struct.pack(f"<{len(rows)}{'I' if i == 3 else 'f'}", *c) for i, c in enumerate(columns))
        packed = b"".join(bytes([len(body[i:i + 32]) - 1]) + body[i:i + 32] for i in range(0, len(body), 32))
        return head + struct.pack("<II", len(packed), len(body)) + packed
    return head + b"".join(struct.pack("<fffI", x, y, z, c) for x, y, z, c in rows)


def test_expand():
    # literals, a copy that overlaps itself, a long copy with an extra length byte
    assert src.expand(b"\x02abc" + b"\x20\x02" + b"\xe0\x05\x00", 3 + 3 + 14) == b"abcabc" + b"c" * 14
    with pytest.raises(ValueError):
        src.expand(b"\x02abc", 4)


def test_ids_of_paths_and_pruned_sequences(spark, tmp_path):
    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "1.ras").write_bytes(out.encode_image(np.full((2, 2), ord(folder), np.uint8), "raster"))
    (tmp_path / "b" / "2.ras").write_bytes(b"broken, and never read")
    (tmp_path / "b" / "plain.ras").write_bytes(b"no number")
    one = src.read_sequence(spark, str(tmp_path), "raster", [1])
    assert one.count() == 8 and {r.v for r in one.collect()} == {ord("a"), ord("b")}
    assert src.read_sequence(spark, str(tmp_path), "raster", [7]).count() == 0
    (tmp_path / "b" / "2.ras").unlink()
    (tmp_path / "b" / "plain.ras").unlink()
    assert src.read_images(spark, str(tmp_path), "raster", src.BY_PATH).select("image_id").distinct().count() == 2
    wide = spark.createDataFrame([(0, 5), (1, 70000)], "r long, c long")
    assert sorted(r.pid for r in src.with_pid(wide).collect()) == [5, 140001]


@pytest.mark.parametrize("mode", ["ascii", "binary", "binary_compressed"])
def test_clouds(spark, tmp_path, mode):
    rows = [(0.5, 1.0, 2.0, 0x102030), (float("nan"), 0.0, 1.0, 0xFF), (1.5, -1.0, 30.0, 1), (2.5, 0.25, 4.0, 0x0A0B0C)]
    for k in (3, 12):
        (tmp_path / f"scan.{k}.pcd").write_bytes(cloud(mode, rows))
    d = src.read_clouds(spark, str(tmp_path))
    assert sorted(r[0] for r in d.select("scan_id").distinct().collect()) == [3, 12]
    one = {r.pid: r for r in d.filter("scan_id = 3").collect()}
    assert one[0].rgb == 0x102030 and one[3].x == 2.5 and math.isnan(one[1].x) and (one[0].width, one[0].height) == (2, 2)
    plain = src.read_clouds(spark, str(tmp_path), colour=False).filter("scan_id = 12").collect()
    assert all(r.rgb == 0 and (r.width, r.height) == (4, 1) for r in plain)


@pytest.mark.parametrize("mode", ["ascii", "binary", "binary_compressed"])
@pytest.mark.parametrize("split", [333, 5000])
def test_split_clouds_equal_whole_ones(spark, tmp_path, mode, split):
    rng = np.random.default_rng(split)
    xyz = rng.integers(-500, 500, (400, 3)) / 8
    rows = [(*map(float, q), int(c)) for q, c in zip(xyz, rng.integers(0, 1 << 23, 400))]
    (tmp_path / "big.1.pcd").write_bytes(cloud(mode, rows))
    (tmp_path / "big.2.pcd").write_bytes(cloud(mode, rows[:200]).rstrip(b"\n") if mode == "ascii" else cloud(mode, rows[:200]))
    (tmp_path / "small.3.pcd").write_bytes(cloud(mode, rows[:2]))
    whole = sorted(map(tuple, src.read_clouds(spark, str(tmp_path), split_bytes=None).collect()))
    parts = sorted(map(tuple, src.read_clouds(spark, str(tmp_path), split_bytes=split).collect()))
    assert len(whole) == 602 and parts == whole
    plain = src.read_clouds(spark, str(tmp_path), colour=False, split_bytes=split)
    assert {(r.scan_id, r.width, r.height) for r in plain.collect()} == {(1, 400, 1), (2, 200, 1), (3, 2, 1)}


def test_blank_lines_and_comments_in_split_clouds(spark, tmp_path):
    rows = [(float(i), 0.0, 0.0, 0) for i in range(50)]
    lines = cloud("ascii", rows).split(b"\n")
    (tmp_path / "1.pcd").write_bytes(b"# " + b"long " * 3000 + b"\n" + b"\n".join(lines[:10]) + b"\n" + b"\n\n".join(lines[10:]))
    for split in (31, 100):
        assert sorted((r.pid, r.x) for r in src.read_clouds(spark, str(tmp_path), split_bytes=split).collect()) == [(i, float(i)) for i in range(50)]


def test_every_line_is_read_by_one_range():
    body = b"head\n" + b"\n".join(b"x" * (k % 7) for k in range(40))
    for split in range(1, 50):
        cuts = range(5, len(body), split)
        assert b"".join(src._lines(io.BytesIO(body), a, min(len(body), a + split), 5) for a in cuts) == body[5:]


def test_four_gigabytes_are_planned_from_the_header(spark, tmp_path):
    n = (4 << 30) // 16
    head = cloud("binary", []).replace(b"POINTS 0", b"POINTS %d" % n).replace(b"HEIGHT 0", b"HEIGHT %d" % (n // 2))
    with open(tmp_path / "1.pcd", "wb") as file:
        file.write(head)
        file.truncate(len(head) + n * 16)  # a hole in the file, no data on the disk
    parts = src.cloud_parts(spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("path", "bigint(1) as scan_id", "length")).collect()
    assert len(parts) == 64 and max(r.end - r.begin for r in parts) <= src.SPLIT_BYTES
    parts.sort(key=lambda r: r.begin)
    assert [r.first for r in parts] == [k * (src.SPLIT_BYTES // 16) for k in range(64)] and parts[-1].end == len(head) + n * 16
    with open(tmp_path / "1.pcd", "r+b") as file:
        file.truncate(len(head) + 16)
    with pytest.raises(Exception, match="shorter than its header says"):
        src.cloud_parts(spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("path", "bigint(1) as scan_id", "length")).collect()


def test_label_images_of_unequal_size_are_refused(spark, tmp_path):
    for folder, sizes in (("gt", {1: (3, 4), 2: (2, 2)}), ("ms", {1: (3, 4), 2: (2, 2)}), ("other", {1: (3, 5), 3: (2, 2)})):
        (tmp_path / folder).mkdir()
        for k, shape in sizes.items():
            (tmp_path / folder / f"{k}.ras").write_bytes(out.encode_image(np.arange(shape[0] * shape[1], dtype=np.uint8).reshape(shape), "raster"))
    gt, ms, other = (src.read_labels(spark, str(tmp_path / f)) for f in ("gt", "ms", "other"))
    pairs = evaluate.label_pairs(gt, ms)
    assert pairs.count() == 16 and pairs.filter("gt <> ms").count() == 0
    assert [r.image_id for r in evaluate.size_faults(gt, other).orderBy("image_id").collect()] == [1, 2, 3]
    with pytest.raises(ValueError, match=r"\[1, 2, 3\]"):
        evaluate.label_pairs(gt, other)


def test_range_images(spark, tmp_path):
    img = np.arange(12, dtype=np.uint8).reshape(3, 4)
    (tmp_path / "big.1.ras").write_bytes(out.encode_image(img, "raster"))
    (tmp_path / "little.2.ras").write_bytes(struct.pack("<8I", out.RASTER_MAGIC, 4, 3, 8, 12, 1, 0, 0) + img.tobytes())
    got = {(r.image_id, r.r, r.c): r.v for r in src.read_images(spark, str(tmp_path), "raster").collect()}
    assert got[(1, 2, 3)] == 11 and got[(2, 1, 0)] == 4 and len(got) == 24
    assert (src.decode_pgm(out.encode_image(img, "pgm")) == img).all()
    assert (src.decode_pgm(b"P2\n# note 7\n4 3\n# more\n255\n" + " ".join(map(str, range(12))).encode()) == img).all()
    words = (np.arange(512 * 512, dtype=np.uint32) | 0xF000).astype(">u4")
    packed = b"".join(b"key = value\n" for _ in range(10)) + b"\n\n" + words.tobytes()
    assert (src.decode_packed(packed).ravel() == (np.arange(512 * 512) & 4095)).all()
    with pytest.raises(ValueError):
        src.decode_raster(struct.pack(">8I", out.RASTER_MAGIC, 4, 3, 8, 12, 1, 1, 9) + img.tobytes())


def test_calibration_by_name(spark):
    d = spark.createDataFrame([("/d/abw.test.19.range",), ("/d/abw.test.2.range",), ("/d/abw.test.0.range",)], "path string")
    assert [r.cal for r in camera.with_calibration(d).collect()] == [1, 0, 1]


def test_metres_keep_only_the_upper_bound(spark):
    d = spark.createDataFrame([(1, 100.0, 0.0, 0.0), (2, 2000.0, 0.0, 0.0), (3, None, None, None), (4, -2000.0, 0.0, 0.0)],
                              "pid int, px double, py double, pz double")
    kept, lost = camera.to_metres(d)
    assert sorted(r.pid for r in kept.collect()) == [1, 2]
    assert {r.pid: r.reason for r in lost.collect()} == {3: "undefined", 4: "range"}
    strict, _ = camera.to_metres(d, strict_range=True)
    assert [r.pid for r in strict.collect()] == [1]


def test_angles_normals_and_sequence(spark, tmp_path):
    (tmp_path / "a.4.gt-ang").write_text("2\n10 11 90.0\n10 12 120.5\n")
    (tmp_path / "a.4.ms-nor").write_text("2\n10 0.0 0.6 -0.8\n11 1 0 0\n")
    ang = src.read_angles(spark, str(tmp_path / "a.4.gt-ang")).collect()
    assert [(r.image_id, r.region2, r.deg) for r in ang] == [(4, 11, 90.0), (4, 12, 120.5)]
    nor = {r.region: (r.nx, r.ny, r.nz) for r in src.read_normals(spark, str(tmp_path / "a.4.ms-nor")).collect()}
    assert nor[10] == (0.0, -0.6, 0.8) and nor[11] == (1, 0, 0)
    (tmp_path / "b.4.gt-ang").write_text("3\n10 11 90.0\n")
    with pytest.raises(Exception, match="wrong number of angles"):
        src.read_angles(spark, str(tmp_path / "b.4.gt-ang")).collect()
    for k in range(3):
        (tmp_path / f"img.{k}.ras").write_bytes(out.encode_image(np.full((2, 2), k, np.uint8), "raster"))
    seq = src.read_sequence(spark, str(tmp_path / "img.*.ras"), "raster", [0, 2])
    assert sorted(r[0] for r in seq.select("image_id").distinct().collect()) == [0, 2]


def test_label_image_round_trip(spark, tmp_path):
    labels = spark.createDataFrame([(i, r, c, 10 + (r + c) % 3) for i in (0, 1) for r in range(4) for c in range(5)],
                                   "image_id bigint, r bigint, c bigint, label bigint")
    for row in out.encode_labels(labels).collect():
        (tmp_path / f"ms.{row.image_id}.seg").write_bytes(bytes(row.content))
    back = src.read_labels(spark, str(tmp_path))
    assert back.exceptAll(labels).count() == 0 and back.count() == 40


def test_normals_text_and_metrics(spark, tmp_path):
    planes = spark.createDataFrame([(1, 7, 0.0, 0.0, 1.0), (1, 9, 1.0, 0.0, 0.0)], "scan_id bigint, plane_id bigint, nx double, ny double, nz double")
    out.normals_text(tables.normals_table(planes), str(tmp_path / "nor"))
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "nor")).select("value").collect())
    assert lines == ["10 0.000000 0.000000 1.000000", "11 1.000000 0.000000 0.000000", "2"]
    for s in (1.5, 2.5):
        out.append_metric(spark, str(tmp_path / "m"), 1, "planes", s)
    assert spark.read.parquet(str(tmp_path / "m")).agg(F.sum("seconds")).first()[0] == 4.0


def test_frames_and_pictures(spark, tmp_path):
    d = spark.createDataFrame([(1, 0, 0, 1.0, 1.0, 1.0, 0x010203), (1, 0, 1, float("nan"), 1.0, 1.0, 0xFFFFFF)],
                              "scan_id bigint, r bigint, c bigint, x double, y double, z double, rgb bigint")
    pic = {r.c: (r.red, r.green, r.blue) for r in out.raw_picture(d).collect()}
    assert pic == {0: (1, 2, 3), 1: (0, 0, 0)}
    for _ in range(2):
        out.dump_frame(d, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2


def test_plane_records_round_trip(spark, sf, tmp_path):
    pts = load(spark, sf, "colored_points").filter("surf = 1").withColumnRenamed("surf", "plane_id")
    planes = pts.select("scan_id").distinct().selectExpr("scan_id", "1 as plane_id", "1D as nx", "0D as ny", "0D as nz", "1.6D as d", "0.05D as thr")
    ext = fit.with_outline(planes.join(fit.extents(pts, planes, ["scan_id", "plane_id"]), ["scan_id", "plane_id"]))
    size, rgb, high, normals = raster.plane_textures(pts, planes, 2.0, 1)
    rec = tables.plane_records(ext.drop("rectangle", "box", "area"), size, rgb, high)
    rec.write.parquet(str(tmp_path / "planes"))
    back, size2, texels, nm = src.read_plane_records(spark, str(tmp_path / "planes"))
    assert back.count() == 2 and nm.count() == size2.selectExpr("sum(w_pot*h_pot)").first()[0] == normals.count()
    assert texels.filter("h > 0").count() > 0


def test_newest_frame_only(spark, tmp_path):
    rows = spark.sql("""select 1L as sensor_id, timestamp'2024-01-01 00:00:01' as frame_ts, 10L as scan_id, id as pid, double(id) as x, 0D as y, 1D as z
      from range(5) union all select 1L, timestamp'2024-01-01 00:00:02', 11L, id, double(id), 0D, 1D from range(4)""")
    both = streams.both_kinds(streams.from_rgba(rows.selectExpr("*", "1 as r", "2 as g", "3 as b", "255 as a")), rows.filter("false"))
    both.selectExpr("sensor_id", "frame_ts", "scan_id", "pid", "x", "y", "z", "rgb", "0D as intensity").write.parquet(str(tmp_path / "in"))
    seen = []
    for every, want in ((False, {11: 4}), (True, {10: 5, 11: 4})):
        seen.clear()
        q = streams.segment_stream(
            streams.prepare(streams.point_stream(spark, str(tmp_path / "in")), 0.0, 2.0, True), SegParams(),
            lambda seg, pts, batch: seen.extend(pts.groupBy("scan_id").count().collect()), str(tmp_path / f"ck{every}"),
            all_frames=every, segment=lambda pts, p: None).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert {r.scan_id: r["count"] for r in seen} == want


def test_stream_moments_equal_batch(spark, sf, tmp_path):
    p = SegParams(rho_max=4.0, min_octree_resolution=0.25, sq_dist_factor=-1.0)
    base = load(spark, sf, "stream_points").withColumn("ts", F.col("ts").cast("timestamp"))
    base.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
    q = (streams.cell_moments(stream, p).writeStream.format("memory").queryName("cells").outputMode("update")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(90)
    keys = ["w", "scan_id", "lx", "ly", "lz"]
    got = spark.table("cells").groupBy(*keys).agg(F.max("n").alias("n"))
    want = streams.cell_moments(base, p).select(*keys, "n")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert streams.surfels_of_moments(streams.cell_moments(base, p), p).count() == want.count()
