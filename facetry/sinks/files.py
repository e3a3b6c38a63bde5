"""Writers: Parquet tables, text normals, encoded label images, raw frames, run metrics."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RASTER_MAGIC = 0x59A66A95  # Fixed value: raster file magic number


def write_table(df: DataFrame, path: str, mode: str = "append", by=("scan_id",)) -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def append_metric(spark, path: str, scan_id: int, name: str, seconds: float) -> None:
    spark.createDataFrame([(scan_id, name, float(seconds))], "scan_id bigint, name string, seconds double").write.mode(
        "append").parquet(path)


def normals_text(normals: DataFrame, path: str) -> None:
    """Text lines per image: the plane count, then region and normal; one folder per image."""
    line = F.format_string("%d %f %f %f", "region", "nx", "ny", "nz")
    rows = normals.select("image_id", F.col("region").alias("_o"), line.alias("value"))
    head = normals.groupBy("image_id").agg(F.max("planes").cast("string").alias("value")).select(
        "image_id", F.lit(0).cast("bigint").alias("_o"), "value")
    out = head.unionByName(rows).repartition("image_id").sortWithinPartitions("image_id", "_o").drop("_o")
    out.write.mode("overwrite").partitionBy("image_id").text(path)


def encode_image(values: np.ndarray, kind: str) -> bytes:
    """8-bit image as big-endian raster file or binary PGM."""
    rows, cols = values.shape
    body = values.astype(np.uint8).tobytes()
    if kind == "pgm":
        return b"P5\n%d %d\n255\n" % (cols, rows) + body
    return struct.pack(">8I", RASTER_MAGIC, cols, rows, 8, rows * cols, 1, 0, 0) + body


def encode_labels(labels: DataFrame, kind: str = "raster") -> DataFrame:
    """(image_id, content) with one encoded file per image; a group is one image of 8-bit labels."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["label"].max() > 255:
            raise ValueError("labels above 255 do not fit an 8-bit image")
        grid = np.zeros((pdf["r"].max() + 1, pdf["c"].max() + 1), dtype=np.uint8)
        grid[pdf["r"], pdf["c"]] = pdf["label"]
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "content": [encode_image(grid, kind)]})

    return labels.select("image_id", "r", "c", "label").groupBy("image_id").applyInPandas(one, "image_id bigint, content binary")


def write_encoded(images: DataFrame, path: str) -> None:
    images.write.mode("overwrite").parquet(path)


def raw_picture(points: DataFrame) -> DataFrame:
    """Pixels (r, g, b) of a raw organised frame; non-finite points are black."""
    bad = F.expr("isnan(x) or isnan(y) or isnan(z) or abs(x) = double('infinity') or abs(y) = double('infinity') or abs(z) = double('infinity')")
    val = lambda s: F.when(bad, F.lit(0)).otherwise(F.expr(f"(shiftright(rgb, {s}) & 255)")).cast("int")
    return points.select("scan_id", "r", "c", val(16).alias("red"), val(8).alias("green"), val(0).alias("blue"))


def dump_frame(points: DataFrame, path: str) -> None:
    """Raw points of frames, one folder per scan; a repeated batch replaces its own scans."""
    (points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(path))
