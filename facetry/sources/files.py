"""Readers of point-cloud, range-image, label, angle and normal files."""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import is_empty, stage
from ..sinks.files import RASTER_MAGIC

PACKED_SIDE = 512
PACKED_HEADER_LINES = 10
ROWS_PER_BATCH = 262_144
TEXT_BYTES = 1 << 20
NUMBER = r"(\d+)(?!.*\d)"  # last number of the file name


BY_PATH = "path"  # in place of a pattern: the id is a hash of the whole path, for collections of many folders


def _files(spark: SparkSession, path: str, pattern: str, numbers=None) -> DataFrame:
    """Files with the scan number taken from their name (``pattern`` has one group).

    Files whose number is not asked for are left out by name, before their content is read.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if pattern == BY_PATH:
        number = F.xxhash64("path")
    else:
        number = F.try_element_at(F.regexp_extract_all(F.element_at(F.split("path", "/"), -1), F.lit(pattern), F.lit(1)), F.lit(1)).try_cast("bigint")
    if numbers is not None:
        wanted = d.select("path").filter(number.isin(*numbers))
        paths = [r.path for r in wanted.collect()]  # as many as numbers are asked for
        if not paths:
            return d.filter(F.lit(False)).select("path", number.alias("scan_id"), "length", "content")
        d = spark.read.format("binaryFile").load(paths)
    return d.select("path", number.alias("scan_id"), "length", "content")


# --- point clouds ----------------------------------------------------------

CLOUD_SCHEMA = ("path string, scan_id bigint, pid bigint, x double, y double, z double, rgb bigint, intensity double, "
                "width bigint, height bigint")


def parse_cloud_header(content: bytes) -> tuple[dict, int]:
    """Header fields of a point-cloud file and the offset of its data."""
    head, pos = {}, 0
    while True:
        end = content.index(b"\n", pos)
        line = content[pos:end].decode("ascii", "replace").strip()
        pos = end + 1
        if not line or line.startswith("#"):
            continue
        key, *rest = line.split()
        head[key.upper()] = rest
        if key.upper() == "DATA":
            return head, pos


def expand(data: bytes, size: int) -> bytes:
    """LZF data: runs of literal bytes and copies of earlier output."""
    out, i = bytearray(), 0
    while i < len(data):
        control = data[i]
        i += 1
        if control < 32:
            out += data[i:i + control + 1]
            i += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += data[i]
            i += 1
        back = ((control & 31) << 8 | data[i]) + 1
        i += 1
        length += 2
        seed = bytes(out[-back:][:length])
        out += (seed * -(-length // len(seed)))[:length]
    if len(out) != size:
        raise ValueError("broken compressed point cloud")
    return bytes(out)


def _layout(head: dict) -> tuple[list, list, list, int]:
    """(names, counts, types, number of points) that a header names."""
    names = head["FIELDS"]
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(names))]
    kinds = {"F4": "<f4", "F8": "<f8", "U1": "u1", "U2": "<u2", "U4": "<u4", "I1": "i1", "I2": "<i2", "I4": "<i4"}
    total = int(head["POINTS"][0]) if "POINTS" in head else int(head["WIDTH"][0]) * int(head["HEIGHT"][0])
    return names, counts, [kinds[t + s] for t, s in zip(head["TYPE"], head["SIZE"])], total


def _record(head: dict) -> np.dtype:
    names, counts, dtypes, _ = _layout(head)
    return np.dtype([(n, t, (c,)) if c > 1 else (n, t) for n, t, c in zip(names, dtypes, counts)])


def _from_records(head: dict, content: bytes, n: int, pos: int = 0) -> dict:
    rows = np.frombuffer(content, _record(head), n, pos)
    names, counts, _, _ = _layout(head)
    return {name: rows[name] for name, c in zip(names, counts) if c == 1}


def _from_text(head: dict, content: bytes) -> dict:
    """Columns of text rows; cells are wide while they are text, so they are made for some thousand lines at a time."""
    names, counts, dtypes, _ = _layout(head)
    kept = {n: [] for n, c in zip(names, counts) if c == 1}
    begin = 0
    while begin < len(content):
        end = content.find(b"\n", begin + TEXT_BYTES)
        end = len(content) if end < 0 else end + 1
        cells, at = np.array(content[begin:end].split(), dtype="U32").reshape(-1, sum(counts)), 0
        for n, t, c in zip(names, dtypes, counts):
            if c == 1:
                kept[n].append(cells[:, at].astype(np.float64 if t.startswith("<f") else np.int64).astype(t))
            at += c
        begin = end
    return {n: np.concatenate(parts) if parts else np.zeros(0, t) for (n, parts), t in
            zip(kept.items(), (t for t, c in zip(dtypes, counts) if c == 1))}


def decode_cloud(content: bytes) -> tuple[dict, dict]:
    """(header, column arrays) of an ascii, binary or compressed point-cloud file."""
    head, pos = parse_cloud_header(content)
    names, counts, dtypes, total = _layout(head)
    mode = head["DATA"][0].lower()
    if mode == "binary":
        return head, _from_records(head, content, total, pos)
    if mode == "binary_compressed":  # the fields one after another
        packed, size = struct.unpack_from("<II", content, pos)
        body, out, at = expand(content[pos + 8:pos + 8 + packed], size), {}, 0
        for n, t, c in zip(names, dtypes, counts):
            if c == 1:
                out[n] = np.frombuffer(body, t, total, at)
            at += total * c * np.dtype(t).itemsize
        return head, out
    if mode != "ascii":
        raise ValueError(f"unsupported point-cloud data mode {mode}")
    cols = _from_text(head, content[pos:])
    if len(cols["x"]) != total:
        raise ValueError("point cloud has not the number of points of its header")
    return head, cols


def _cloud_rgb(cols: dict, n: int):
    for name in ("rgb", "rgba"):
        if name in cols:
            raw = np.ascontiguousarray(cols[name])
            bits = raw.view(np.uint32) if raw.dtype == np.float32 else raw.astype(np.uint32)
            return bits.astype(np.int64) & 0xFFFFFF
    return np.zeros(n, dtype=np.int64)


def _batches(head: dict, cols: dict, path: str, scan: int, first: int, colour: bool):
    """Decoded columns as Arrow batches of points numbered from ``first``."""
    n = len(cols["x"])
    rgb = _cloud_rgb(cols, n) if colour else np.zeros(n, dtype=np.int64)
    w, h = (int(head["WIDTH"][0]), int(head["HEIGHT"][0])) if colour else (_layout(head)[3], 1)
    for a in range(0, n, ROWS_PER_BATCH):
        s = slice(a, min(n, a + ROWS_PER_BATCH))
        k = s.stop - s.start
        light = pa.array(cols["intensity"][s].astype(float)) if "intensity" in cols else pa.nulls(k, pa.float64())
        yield pa.RecordBatch.from_pydict({
            "path": pa.array([path] * k), "scan_id": pa.array([scan] * k, pa.int64()),
            "pid": pa.array(np.arange(first + s.start, first + s.stop, dtype=np.int64)),
            **{c: pa.array(cols[c][s].astype(float)) for c in "xyz"}, "rgb": pa.array(rgb[s]), "intensity": light,
            "width": pa.array([w] * k, pa.int64()), "height": pa.array([h] * k, pa.int64())})


SPLIT_BYTES = 64 << 20
HEADER_BYTES = 4096
# File systems whose files tasks can open at any byte, and their names there
SEEKABLE = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
PARTS = "path string, scan_id bigint, mode string, head binary, begin bigint, end bigint, first bigint"


def _open(path: str):
    from pyarrow import fs

    scheme, rest = path.split(":", 1)
    rest = "//" + rest if not rest.startswith("//") else rest
    store, name = fs.FileSystem.from_uri(f"{SEEKABLE[scheme]}:{rest}")
    return store.open_input_file(name)


def _header(file) -> bytes:
    """The header's bytes, read in doubling pieces."""
    size = HEADER_BYTES
    while True:
        file.seek(0)
        content = file.read(size)
        try:
            return content[:parse_cloud_header(content)[1]]
        except ValueError:  # the piece ends inside the header
            if len(content) < size:
                raise ValueError("point cloud without a header") from None
            size *= 2


def cloud_parts(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Byte ranges of about ``split_bytes`` of the files ``(path, scan_id, length)``; only headers are read.

    A range of a binary file holds whole records and knows the number of its first one (``first``); of an ascii file it
    holds the lines that begin in it, and ``first`` is null.  Compressed files are one block and stay one part.
    """
    def plan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as file:
                    raw = _header(file)
                head, pos = parse_cloud_header(raw)
                mode, length = head["DATA"][0].lower(), row["length"]
                if mode == "binary":
                    width, total = _record(head).itemsize, _layout(head)[3]
                    if length < pos + total * width:
                        raise ValueError(f"{row['path']} is shorter than its header says")
                    step = max(1, split_bytes // width)
                    spans = [(pos + a * width, pos + min(total, a + step) * width, a) for a in range(0, total, step)]
                elif mode == "ascii":
                    spans = [(a, min(length, a + split_bytes), None) for a in range(pos, length, split_bytes)]
                else:
                    spans = [(0, length, 0)]
                for a in range(0, len(spans), ROWS_PER_BATCH):
                    begin, end, first = zip(*spans[a:a + ROWS_PER_BATCH])
                    k = len(begin)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["path"]] * k), pa.array([row["scan_id"]] * k, pa.int64()), pa.array([mode] * k), pa.array([raw] * k, pa.binary()),
                         *(pa.array(c, pa.int64()) for c in (begin, end, first))], ["path", "scan_id", "mode", "head", "begin", "end", "first"])

    return files.select("path", "scan_id", "length").mapInArrow(plan, PARTS)


def _lines(file, begin: int, end: int, start: int) -> bytes:
    """The lines that begin in the byte range; ``start`` is where the first line of all begins."""
    at = begin if begin == start else begin - 1
    file.seek(at)
    body = file.read(end - at)
    if at < begin:
        cut = body.find(b"\n")
        body = body[cut + 1:] if cut >= 0 else b""
    while body and not body.endswith(b"\n"):
        more = file.read(HEADER_BYTES)
        if not more:
            break
        stop = more.find(b"\n")
        body += more if stop < 0 else more[:stop + 1]
    return body


def _numbered(parts: DataFrame) -> DataFrame:
    """Ranges of ascii files with the number of their first line: lines are counted by task, sums run over a file's ranges."""
    def count(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                with _open(row["path"]) as file:
                    body = _lines(file, row["begin"], row["end"], len(row["head"]))
                found.append(sum(1 for line in body.split(b"\n") if line.strip()))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("begin"), pa.array(found, pa.int64())], ["path", "begin", "lines"])

    lines = parts.select("path", "head", "begin", "end").mapInArrow(count, "path string, begin bigint, lines bigint")
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    return parts.drop("first").join(lines.select("path", "begin", F.coalesce(before, F.lit(0)).alias("first")), ["path", "begin"])


def _spread(parts: DataFrame) -> DataFrame:
    """One range a task, up to some thousands."""
    parts = stage(parts)
    return parts.repartition(max(1, min(20_000, parts.count())))


def _read_parts(parts: DataFrame, colour: bool) -> DataFrame:
    """Points of byte ranges, read batch by batch."""
    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                head, pos = parse_cloud_header(row["head"])
                with _open(row["path"]) as file:
                    if row["mode"] == "binary":
                        width, at, first = _record(head).itemsize, row["begin"], row["first"]
                        while at < row["end"]:
                            file.seek(at)
                            body = file.read(min(row["end"] - at, ROWS_PER_BATCH * width))
                            n = len(body) // width
                            yield from _batches(head, _from_records(head, body, n), row["path"], row["scan_id"], first, colour)
                            at, first = at + n * width, first + n
                        continue
                    body = _lines(file, row["begin"], row["end"], pos) if row["mode"] == "ascii" else file.read()
                cols = _from_text(head, body) if row["mode"] == "ascii" else decode_cloud(body)[1]
                yield from _batches(head, cols, row["path"], row["scan_id"], row["first"], colour)

    return parts.mapInArrow(decode, CLOUD_SCHEMA)


def read_clouds(spark: SparkSession, path: str, pattern: str = NUMBER, colour: bool = True, split_bytes: int | None = SPLIT_BYTES) -> DataFrame:
    """Point-cloud files as points, streamed in batches.

    Files up to ``split_bytes`` are read whole by one task each.  Larger ones are planned from their headers and read by
    byte ranges, where tasks can open files of that scheme (``SEEKABLE``); with ``split_bytes=None`` all are read whole.
    Without colour the colour is 0 and the shape N x 1.
    """
    # Arrow output keeps NaN coordinates apart from missing values
    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                head, cols = decode_cloud(row["content"])
                yield from _batches(head, cols, row["path"], row["scan_id"], 0, colour)

    files = _files(spark, path, pattern)
    whole = files.select("path", "scan_id", "content")
    if split_bytes is None:
        return whole.mapInArrow(decode, CLOUD_SCHEMA)
    large = files.filter(F.col("length") > split_bytes).select("path", "scan_id", "length")
    example = large.first()
    if example is None or example.path.split(":")[0] not in SEEKABLE:
        return whole.mapInArrow(decode, CLOUD_SCHEMA)
    small = files.filter(F.col("length") <= split_bytes).select("path", "scan_id", "content").mapInArrow(decode, CLOUD_SCHEMA)
    parts = _spread(cloud_parts(large, split_bytes))
    ascii_parts = parts.filter("mode = 'ascii'")
    points = [small, _read_parts(parts.filter("mode != 'ascii'"), colour)]
    if not is_empty(ascii_parts):
        points.append(_read_parts(_spread(_numbered(ascii_parts)), colour))
    return functools.reduce(DataFrame.unionByName, points)


# --- range and label images ------------------------------------------------

def decode_raster(content: bytes) -> np.ndarray:
    """8-bit raster file of either byte order; colour maps are refused."""
    order = ">" if struct.unpack(">I", content[:4])[0] == RASTER_MAGIC else "<"
    magic, cols, rows, *_rest, map_type_length = struct.unpack(order + "8I", content[:32])
    if magic != RASTER_MAGIC:
        raise ValueError("not a raster file")
    if map_type_length:
        raise ValueError("colour maps are not supported")
    return np.frombuffer(content, np.uint8, rows * cols, 32).reshape(rows, cols)


def decode_pgm(content: bytes) -> np.ndarray:
    """P2 or P5 image; comments in the header are skipped up to the maximum value 255."""
    kind = content[:2]
    if kind not in (b"P2", b"P5"):
        raise ValueError("not a PGM file")
    numbers, pos = [], 2
    token = re.compile(rb"(?:[\s,]*#[^\n]*\n)*[\s,]*(\d+)")
    while len(numbers) < 3 or numbers[-1] != 255:
        hit = token.match(content, pos)
        if hit is None:
            raise ValueError("bad PGM header")
        numbers.append(int(hit.group(1)))
        pos = hit.end()
    cols, rows = numbers[:2]
    if kind == b"P5":
        return np.frombuffer(content, np.uint8, rows * cols, pos + 1).reshape(rows, cols)
    return np.array(content[pos:].split()[:rows * cols], dtype=np.int64).reshape(rows, cols)


def decode_packed(content: bytes) -> np.ndarray:
    """12-bit ranges in big-endian 32-bit words after a ten-line text header and two bytes."""
    pos = 0
    for _ in range(PACKED_HEADER_LINES):
        pos = content.index(b"\n", pos) + 1
    size = PACKED_SIDE * PACKED_SIDE
    words = np.frombuffer(content, ">u4", size, len(content) - 4 * size)
    return (words & 4095).astype(np.int64).reshape(PACKED_SIDE, PACKED_SIDE)


DECODERS = {"raster": decode_raster, "pgm": decode_pgm, "packed": decode_packed}
PIXEL_SCHEMA = "path string, image_id bigint, r bigint, c bigint, v bigint"


def read_images(spark: SparkSession, path: str, kind: str, pattern: str = NUMBER, numbers=None) -> DataFrame:
    """Pixels of image files; one task per file."""
    decoder = DECODERS[kind]

    def decode(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                img = decoder(row.content)
                step = max(1, ROWS_PER_BATCH // img.shape[1])
                for a in range(0, img.shape[0], step):
                    part = img[a:a + step]
                    r, c = np.indices(part.shape)
                    yield pd.DataFrame({"path": row.path, "image_id": row.scan_id, "r": r.ravel() + a, "c": c.ravel(),
                                        "v": part.ravel().astype(np.int64)})

    return _files(spark, path, pattern, numbers).mapInPandas(decode, PIXEL_SCHEMA)


def with_pid(pixels: DataFrame) -> DataFrame:
    """Row-major point id of a pixel, in the widest image of the table."""
    width = pixels.agg(F.max("c")).first()[0]
    return pixels.withColumn("pid", F.col("r") * F.lit((width or 0) + 1) + F.col("c"))


def read_labels(spark: SparkSession, path: str, pattern: str = NUMBER) -> DataFrame:
    return read_images(spark, path, "raster", pattern).selectExpr("image_id", "r", "c", "v as label")


# --- small text tables -----------------------------------------------------

def _numbers(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(image_id, tokens) per text file; files hold a few hundred numbers."""
    d = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), pattern, 1).cast("bigint").alias("image_id"),
        F.split(F.trim("value"), r"\s+").alias("t"))
    return d


def read_angles(spark: SparkSession, path: str, pattern: str = NUMBER) -> DataFrame:
    """Ground-truth angles: a count, then region, region, degrees; a short file is an error."""
    d = _numbers(spark, path, pattern)
    d = d.selectExpr("image_id", "t", "explode(sequence(0, cast(t[0] as int))) as k").filter("k < cast(t[0] as int)")
    short = F.raise_error(F.concat(F.lit("wrong number of angles for image "), F.col("image_id"))).cast("double")
    deg = F.when(F.size("t") >= 3 * F.col("t")[0].cast("int") + 1, F.expr("double(t[3*k + 3])")).otherwise(short)
    return d.select("image_id", F.expr("bigint(t[3*k + 1])").alias("region1"), F.expr("bigint(t[3*k + 2])").alias("region2"), deg.alias("deg"))


def read_normals(spark: SparkSession, path: str, pattern: str = NUMBER) -> DataFrame:
    """Region normals: a count, then region and normal; normals with z < 0 are flipped."""
    d = _numbers(spark, path, pattern)
    d = d.selectExpr("image_id", "t", "explode(sequence(0, cast(t[0] as int))) as k").filter("k < cast(t[0] as int)")
    d = d.selectExpr("image_id", "bigint(t[4*k + 1]) as region", *(f"double(t[4*k + {i}]) as _{a}" for i, a in zip((2, 3, 4), "xyz")))
    return d.selectExpr("image_id", "region", *(f"if(_z < 0, -_{a}, _{a}) as n{a}" for a in "xyz"))


def read_sequence(spark: SparkSession, path: str, kind: str, numbers, pattern: str = NUMBER) -> DataFrame:
    """Images of a numbered sequence; other files are not read."""
    return read_images(spark, path, kind, pattern, numbers)


# --- plane records ---------------------------------------------------------

def read_plane_records(spark: SparkSession, path: str):
    """Plane records back into (planes, sizes, height raster, normal map); the normal map is recomputed."""
    from ..operators import raster

    rec = spark.read.parquet(path)
    key = ["scan_id", "plane_id"]
    planes = rec.select(*key, "nx", "ny", "nz", "d", "thr", "rectangle").dropDuplicates(key)
    size = rec.select(*key, "texel", "width", "height", "width_ratio", "height_ratio").dropDuplicates(key)
    size = size.selectExpr("*", "cast(round(width/width_ratio) as bigint) as w_pot", "cast(round(height/height_ratio) as bigint) as h_pot")
    texels = rec.select(*key, "ty", F.explode("texels").alias("t")).select(*key, "t.*", "ty")
    high = texels.selectExpr(*key, "tx", "ty", "h/255D as h")
    return planes, size, texels, raster.normal_map(high, size)
