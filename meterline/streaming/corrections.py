"""Net quantities of a stream of usage records, with retractions and restatements as they come.

The state is a stored table of sums per dimension, partitioned by a hash of the dimensions.
Each micro-batch is added to the partitions it touches under its own number, so a batch
that is run again after a failure adds nothing. Sums do not depend on
order: late retractions, and batches in any order, end at what one batch run gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterline.operators.upkeep import add_up
from meterline.sources.stored_table import StoredTable, bucket

BUCKETS = 64


def net_table(spark, path: str) -> StoredTable:
    return StoredTable(spark, path, "bucket")


def net_corrections_stream(
    usage: DataFrame, table: StoredTable, dims: list[str], checkpoint: str, *, buckets: int = BUCKETS, record_id: str | None = None,
    event_time: str = "usage_end_time", delay: str = "30 days", **trigger,
) -> StreamingQuery:
    """Start adding a stream of usage records to ``table``; ``trigger`` as for a stream writer, available-now by default.

    ``record_id`` names a column by which records delivered twice within ``delay`` count
    once; Spark then leaves out records later than that. Without it every record counts and none is too
    late. ``checkpoint`` and ``table`` belong together: a restart goes on where they stand.
    """
    if record_id:
        usage = usage.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([record_id])

    def add(batch: DataFrame, number: int) -> None:
        delta = batch.select(*dims, F.col("usage_quantity").cast("decimal(38,6)").alias("net_quantity"), F.lit(1).cast("long").alias("record_count"))
        add_up(table, delta.withColumn("bucket", bucket(dims, buckets)), dims, ["net_quantity", "record_count"], f"{checkpoint}#{number}")

    return usage.select(*dict.fromkeys([*dims, "usage_quantity", *([event_time, record_id] if record_id else [])])).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def net_of(table: StoredTable) -> DataFrame:
    """The sums so far, as ``net_corrections`` gives them: only positive nets."""
    return table.read().drop("bucket").filter(F.col("net_quantity") > 0)
