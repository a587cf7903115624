"""A local session for tests, and the folder in which stage results are kept."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "meterline", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and benchmarks, with master, memory and partitions fixed. A cluster makes its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxMetadataStringLength", "1000")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A scratch folder is made only where the setting is missing in a single-JVM
    session, and is then remembered in it. A cluster without the setting is an error:
    each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("meterline.scratch.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="meterline-")
        spark.conf.set("meterline.scratch.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a stage result once and continue from the stored table.

    Cuts the lineage, survives lost executors, and gives the next stage exact
    file sizes, which is what the automatic broadcast choice is based on.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
