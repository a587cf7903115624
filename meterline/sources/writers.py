"""Sinks. Each is one distributed write; no statement text is built from rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_partitioned(df: DataFrame, path: str, mode: str = "overwrite", by: str = "usage_date") -> None:
    """Full refresh partitioned by day.

    Rebalancing puts the rows of a day together without fixing the number of
    tasks: adaptive execution joins small days and splits a day that holds a
    large part of the table.
    """
    df.hint("rebalance", by).write.mode(mode).partitionBy(by).parquet(path)


def append_results(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def snapshot(df: DataFrame, path: str, label: str) -> str:
    """Dated copy of a table; returns the path of the copy."""
    target = f"{path.rstrip('/')}_backup_{label}"
    df.write.mode("errorifexists").parquet(target)
    return target


def restore(spark: SparkSession, snapshot_path: str, target_path: str) -> DataFrame:
    """Overwrite a table from its copy. The copy is read, never the target."""
    if snapshot_path.rstrip("/") == target_path.rstrip("/"):
        raise ValueError("a table cannot be restored from itself")
    copy = spark.read.parquet(snapshot_path)
    copy.write.mode("overwrite").parquet(target_path)
    return spark.read.schema(copy.schema).parquet(target_path)
