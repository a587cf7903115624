"""Data checks merged from the state of each day.

A day of the feed is read once, when it arrives or is corrected, and leaves one row of
counts, sums and dates that merge: adding them up, or taking the larger, gives what a scan
of all days would. Checks over any range read those rows only.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions.columns import day, freshness_status, ratio, rounded, since
from meterline.operators.cost import price_interval_join
from meterline.sources.stored_table import StoredTable


def day_state(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage_date and the mergeable state of its records."""
    rows = price_interval_join(usage, prices)
    original = F.col("record_type") == "ORIGINAL"
    cost = F.col("usage_quantity") * F.col("effective_price")
    return rows.groupBy("usage_date").agg(
        F.count("*").alias("records"), F.count_if(original).alias("originals"), F.count_if(original & F.col("effective_price").isNotNull()).alias("priced"),
        F.count_if(original & ((F.col("usage_quantity") <= 0) | (cost <= 0))).alias("non_positive"),
        F.sum(F.when(original, F.col("usage_quantity"))).cast("decimal(38,6)").alias("quantity"), F.sum(F.when(original, cost)).cast("decimal(38,10)").alias("cost"),
    )


class DayChecks:
    """The states of all days as a stored table, a partition a day."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = StoredTable(spark, f"{folder}/days", "usage_date")

    def refresh(self, usage: DataFrame, prices: DataFrame, first: date, last: date) -> None:
        """Take in the days from ``first`` to ``last``, new ones or corrected ones; only they are read, and what was known of them is replaced."""
        states = day_state(usage.filter(F.col("usage_date").between(day(first), day(last))), prices)
        old = [k for k in self.table.current().partitions if first.isoformat() <= k <= last.isoformat()]
        span = [date.fromordinal(n).isoformat() for n in range(first.toordinal(), last.toordinal() + 1)]
        self.table.replace(states, values=sorted({*old, *span}))

    def read(self) -> DataFrame:
        return self.table.read()


def merged(states: DataFrame, as_of: date) -> list[Column]:
    """The checks of a group of day states as aggregates."""
    latest = F.max(F.when(F.col("originals") > 0, F.col("usage_date")))
    behind = F.datediff(day(as_of), latest)
    return [
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"), F.min("usage_date").alias("first_date"), F.max("usage_date").alias("last_date"),
        F.count("*").alias("days_with_data"), latest.alias("latest_original"), behind.alias("days_behind"), freshness_status(behind).alias("status"),
        rounded(ratio(F.sum("priced") * 100, F.sum("originals")), 2).alias("price_coverage_pct"), F.sum("non_positive").alias("non_positive"),
        F.round(F.sum("quantity"), 2).alias("total_dbu"), F.round(F.sum("cost"), 2).alias("total_cost"),
    ]


def checks(states: DataFrame, as_of: date, windows: tuple[int, ...] = (7, 30, 365)) -> DataFrame:
    """A row of checks for each window that ends on ``as_of``, from one read of the states."""
    longest = states.filter(since(as_of, max(windows)))
    inside = F.filter(F.array(*[F.when(since(as_of, w), F.lit(w)) for w in windows]), lambda w: w.isNotNull())
    found = longest.withColumn("window_days", F.explode(inside)).groupBy("window_days").agg(*merged(states, as_of))
    return found.withColumn("missing_days", F.col("window_days") + 1 - F.col("days_with_data"))
