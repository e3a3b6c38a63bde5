"""Point streams: cloud sources, newest-frame segmentation, windowed cell moments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour
from ..functions.moments import merge_aggs, moment_aggs
from ..functions.vec import v
from ..operators import clean, octree
from ..params import SegParams
from ..session import stage

POINT_SCHEMA = ("sensor_id bigint, frame_ts timestamp, scan_id bigint, pid bigint, x double, y double, z double, "
                "rgb bigint, intensity double")


def point_stream(spark: SparkSession, path: str, schema=POINT_SCHEMA, files_per_trigger: int = 100, name: str = "*") -> DataFrame:
    """Points that arrive as Parquet files (of that name pattern) in a folder."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .option("pathGlobFilter", name).parquet(path))


def widen(points: DataFrame) -> DataFrame:
    """Uncoloured points as coloured ones with colour 0."""
    return points if "rgb" in points.columns else points.withColumn("rgb", F.lit(0).cast("bigint"))


def from_rgba(points: DataFrame) -> DataFrame:
    """Separate r, g, b, a channels packed into one colour."""
    packed = colour.pack(*(F.col(c).cast("bigint") for c in ("r", "g", "b")))
    return points.withColumn("rgb", packed).drop("r", "g", "b", "a")


def both_kinds(coloured: DataFrame, plain: DataFrame) -> DataFrame:
    return coloured.unionByName(widen(plain), allowMissingColumns=True)


def prepare(points: DataFrame, z_min: float, z_max: float, depth_camera: bool) -> DataFrame:
    """Range filter and axis change of incoming frames."""
    d = clean.pass_through(points, "z", z_min, z_max)
    return clean.to_robot_axes(d) if depth_camera else d


def newest_frames(points: DataFrame) -> DataFrame:
    """Points of the newest frame per sensor; older frames of the batch are dropped."""
    last = points.groupBy("sensor_id").agg(F.max("frame_ts").alias("frame_ts"))
    return points.join(last, ["sensor_id", "frame_ts"], "left_semi")


def read_if_any(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet rows below ``folder``, none if nothing has been written there yet."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class FrameMemory:
    """The last frame handled of each sensor, one small snapshot for each batch.

    A batch reads the snapshot of an earlier batch and writes its own, so a repeated batch sees what the first try saw.
    A snapshot has one row for each sensor.
    """

    ROWS = "sensor_id bigint, frame_ts timestamp, batch bigint"

    def __init__(self, folder: str):
        self.folder = folder

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """(sensor_id, frame_ts) handled before the batch."""
        held = read_if_any(spark, self.folder, self.ROWS).filter(F.col("batch") < batch_id)
        return held.groupBy("sensor_id").agg(F.max("frame_ts").alias("frame_ts"))

    def unseen(self, points: DataFrame, batch_id: int) -> DataFrame:
        """Points of the newest frame of each sensor, if it is newer than any handled before."""
        last = self.before(points.sparkSession, batch_id).withColumnRenamed("frame_ts", "last_ts")
        newest = newest_frames(points).join(last, "sensor_id", "left")
        return newest.filter("last_ts is null or frame_ts > last_ts").drop("last_ts")

    def keep(self, frames: DataFrame, batch_id: int) -> None:
        both = frames.select("sensor_id", "frame_ts").unionByName(self.before(frames.sparkSession, batch_id))
        rows = both.groupBy("sensor_id").agg(F.max("frame_ts").alias("frame_ts"))
        rows.withColumn("batch", F.lit(batch_id)).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/step={batch_id}")


def segment_stream(points: DataFrame, p: SegParams, write: Callable, checkpoint: str, all_frames: bool = False,
                   segment: Callable | None = None):
    """Segment every batch with fresh state: ``write(segmentation, frame_points, batch_id)``.

    Frames are independent; with ``all_frames`` none is dropped.  Otherwise a sensor's newest frame is handled, and a
    frame that arrives in a later batch than a newer one is dropped.  Writers should replace the partitions of the
    batch's scans, so a repeated batch does no harm.
    """
    from ..plans.pipeline import segment as default

    run, memory = segment or default, FrameMemory(f"{checkpoint}/frames")

    def each(batch: DataFrame, batch_id: int) -> None:
        frames = batch if all_frames else stage(memory.unseen(batch, batch_id))
        if frames.take(1):
            write(run(frames, p), frames, batch_id)
        if not all_frames:
            memory.keep(frames, batch_id)

    return points.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


CELLS = ["w", "scan_id", "lx", "ly", "lz"]


def cell_moments(points: DataFrame, p: SegParams, ts: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Moments per event-time window and finest cell; a map accumulated over time.

    The same code serves batch and stream; sums are mergeable, so late rows inside the
    watermark just add to their window.
    """
    d = points.withColumn(ts, F.col(ts).cast("timestamp"))
    if d.isStreaming:
        d = d.withWatermark(ts, late)
    keyed = octree.with_keys(d, p)
    return keyed.groupBy(F.window(ts, window).alias("w"), "scan_id", "lx", "ly", "lz").agg(*moment_aggs(v("x", "y", "z")))


class MomentMap:
    """A map of cell moments over time as an append-only table of partial sums.

    Each batch adds the sums of its own rows and keeps no other state; the batch's part is replaced if the batch is
    repeated.  Rows of windows that were closed before the batch began (the newest event time of all earlier batches,
    less ``late``, lies beyond their end) are dropped and counted.  ``compact`` merges the parts of all batches so far
    into one; readers take the latest merged part and the batches after it.
    """

    PROGRESS = "newest timestamp, dropped bigint, batch bigint"

    def __init__(self, folder: str, p: SegParams, ts: str = "ts", window: str = "1 day", late: str = "1 hour"):
        self.folder, self.p, self.ts, self.window, self.late = folder, p, ts, window, late

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """The function for ``foreachBatch``."""
        spark = batch.sparkSession
        before = read_if_any(spark, f"{self.folder}/progress", self.PROGRESS).filter(F.col("batch") < batch_id)
        limit = before.select((F.max("newest") - F.expr(f"interval {self.late}")).alias("limit")).first()["limit"]
        rows = batch.withColumn(self.ts, F.col(self.ts).cast("timestamp"))
        closed = F.window(self.ts, self.window)["end"] <= F.lit(limit) if limit is not None else F.lit(False)
        sums = cell_moments(rows.filter(~closed), self.p, self.ts, self.window)
        sums.write.mode("overwrite").parquet(f"{self.folder}/parts/batch={batch_id}")
        facts = rows.agg(F.max(self.ts).alias("newest"), F.sum(closed.cast("bigint")).alias("dropped"))
        facts.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{self.folder}/progress/step={batch_id}")

    def progress(self, spark: SparkSession) -> DataFrame:
        return read_if_any(spark, f"{self.folder}/progress", self.PROGRESS)

    def _parts(self, spark: SparkSession) -> tuple[DataFrame | None, int]:
        """(partial sums of the latest merged part and the batches after it, last batch)."""
        merged = read_if_any(spark, f"{self.folder}/merges", "upto bigint").agg(F.max("upto")).first()[0]
        batches = [r[0] for r in self.progress(spark).filter(F.col("batch") > (-1 if merged is None else merged)).select("batch").distinct().collect()]
        paths = [f"{self.folder}/parts/batch={b}" for b in sorted(batches)]
        if merged is not None:
            paths.append(f"{self.folder}/merged/upto={merged}")
        return (spark.read.parquet(*paths) if paths else None), max([-1 if merged is None else merged, *batches])

    def moments(self, spark: SparkSession) -> DataFrame | None:
        """Moments of every window and cell so far, None before the first batch."""
        parts, _ = self._parts(spark)
        return None if parts is None else parts.groupBy(*CELLS).agg(*merge_aggs())

    def compact(self, spark: SparkSession) -> None:
        """Merge all parts; the merge counts from the moment its own entry is written."""
        parts, last = self._parts(spark)
        if parts is not None:
            parts.groupBy(*CELLS).agg(*merge_aggs()).write.mode("overwrite").parquet(f"{self.folder}/merged/upto={last}")
            spark.range(1).select(F.lit(last).cast("bigint").alias("upto")).write.mode("overwrite").parquet(f"{self.folder}/merges/step={last}")


def drained(points: DataFrame, folder: str, p: SegParams) -> DataFrame:
    """Run a stream over all that has arrived and return the accumulated moments, stored below ``folder``."""
    held = MomentMap(f"{folder}/map", p)
    (points.writeStream.foreachBatch(held.add).option("checkpointLocation", f"{folder}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    found = held.moments(points.sparkSession)
    return found if found is not None else cell_moments(points.sparkSession.createDataFrame([], points.schema), p)


def surfels_of_moments(moments: DataFrame, p: SegParams) -> DataFrame:
    """Surfels from accumulated cell moments (a batch or the content of ``foreachBatch``)."""
    d = moments.selectExpr("w.start as window_start", "scan_id", f"{p.depth} as layer", f"{p.depth} as depth",
                           "lx as ix", "ly as iy", "lz as iz", "n", "sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz")
    return octree.surfels(d, p)
