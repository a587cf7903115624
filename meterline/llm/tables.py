"""Reading inputs and keeping stage results in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.session import shared_folder, stored

#: A side is broadcast only while its counted rows fit this many bytes; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Run:
    """Stage results of one call, each written once under a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.stages = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.stages += 1
        return stored(df, f"{self.folder}/{self.stages}")


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a stored table, with a broadcast hint if its counted size allows it."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


@contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """Jobs run inside pass texts to Python in batches of this many bytes, or of one longer text, whatever their number of rows.

    A smaller limit around it holds.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(size, int(before)) if before.isdigit() else size))
    try:
        yield
    finally:
        spark.conf.set(name, before)
