"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library is tuned for; all are plain Spark options.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("facetry")
               .config("spark.sql.shuffle.partitions", str(partitions))
               .config("spark.driver.memory", "8g")
               .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.ui.enabled", "false"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A local temporary folder is used only on a local master with the setting unset.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="facetry-")
        sc.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, rows_in_file: int = 0) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives the next join real sizes to
    decide on broadcasting.  Loops call this once per round.  ``rows_in_file`` limits
    the files of tables with large rows.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_in_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
