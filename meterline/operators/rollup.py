"""A stored rollup that reports of any window are merged from, distinct counts included.

Enriched rows are read once and become cells, one for each day and combination of the
columns that reports group or count by. From the cells come two tables, a row for each day
and key: measures that add up, and bitmaps that are or-ed. A bit stands for a value of a
dictionary, so a distinct count over any days is exact without meeting the rows again.
Bitmaps are kept in words of 64 bits, those with a bit set only: a key that meets few
values takes few bytes, in the store as in the memory of a task.

A key has up to three parts (name, label, cloud_provider) in a section of its own: the
consumers of the top lists, and each cloud as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.functions.columns import day, dbl, ratio, rounded, since
from meterline.operators.reports import month_bounds

KEY = ["section", "name", "label", "cloud_provider"]
CELL = ["usage_date", "workspace_id", "sku_name", "cloud_provider", "product_category", "job_id", "job_name", "run_as"]
#: Section -> name, label, and the columns whose distinct values are counted. A section without a name is one key a cloud.
SECTIONS = {
    "workspace": ("workspace_id", None, ("sku_name",)),
    "sku": ("sku_name", "product_category", ("workspace_id",)),
    "job": ("job_id", "job_name", ()),
    "user": ("run_as", None, ("workspace_id",)),
    "cloud": (None, None, ("workspace_id", "sku_name")),
}
#: Sections that leave rows without a name out.
NAMED = ("job", "user")
MEMBERS = ("workspace_id", "sku_name")


@dataclass
class Rollup:
    """measures: usage_date, key, n, n_cost, quantity, cost. members: usage_date, key, member, bucket, bits."""

    measures: DataFrame
    members: DataFrame

    def during(self, condition: Column) -> Rollup:
        return Rollup(self.measures.filter(condition), self.members.filter(condition))


def cells(dashboard: DataFrame) -> DataFrame:
    """One pass over enriched rows; everything else is made from its result."""
    return dashboard.groupBy(*CELL).agg(
        F.count("*").alias("n"), F.count("actual_cost").alias("n_cost"), F.sum("usage_quantity").alias("quantity"), F.sum("actual_cost").alias("cost")
    )


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """``column`` and ``id`` of its distinct values. Store it: ids are given by the tasks that write, without gathering the values.

    The ids of a task follow each other, so values fill bitmaps from the start.
    """
    return rows.select(column).distinct().filter(F.col(column).isNotNull()).select(column, (F.monotonically_increasing_id() + 1).alias("id"))


def extended(known: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """The dictionary with the values of ``rows`` that it lacks; old ids stay."""
    last = known.agg(F.max("id")).first()[0] or 0
    fresh = dictionary(rows.join(known, column, "left_anti"), column)
    return known.unionByName(fresh.select(column, (F.col("id") + last).alias("id")))


def _of(rows: DataFrame, section: str) -> DataFrame:
    name, label, _ = SECTIONS[section]
    part = lambda c: F.col(c) if c else F.lit(None).cast("string")
    rows = rows.filter(F.col(name).isNotNull()) if section in NAMED else rows
    return rows.select("*", F.lit(section).alias("section"), part(name).alias("name"), part(label).alias("label"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def measures(rows: DataFrame) -> DataFrame:
    """usage_date, key, n, n_cost, quantity, cost from stored cells."""
    sums = [F.sum(c).alias(c) for c in ("n", "n_cost", "quantity", "cost")]
    return _union([_of(rows, s).groupBy("usage_date", *KEY).agg(*sums) for s in SECTIONS])


def members(rows: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """usage_date, key, member, bucket, bits from stored cells and stored dictionaries."""
    for member in MEMBERS:
        rows = rows.join(dictionaries[member].withColumnRenamed("id", f"{member}_no"), member, "left")
    rows = rows.select(*CELL, *[f"{m}_no" for m in MEMBERS])

    def of(section: str, member: str) -> DataFrame:
        no = F.col(f"{member}_no")
        bucket, bit = F.shiftright(no, 6), F.expr(f"shiftleft(1L, CAST({member}_no & 63 AS INT))")
        found = _of(rows, section).filter(no.isNotNull()).withColumns({"member": F.lit(member), "bucket": bucket, "bit": bit})
        return found.groupBy("usage_date", *KEY, "member", "bucket").agg(F.bit_or("bit").alias("bits"))

    return _union([of(s, m) for s, (_, _, own) in SECTIONS.items() for m in own])


def distinct_counts(rollup: Rollup) -> DataFrame:
    """key and one column for each member: its distinct values over all days of ``rollup``."""
    merged = rollup.members.groupBy(*KEY, "member", "bucket").agg(F.bit_count(F.bit_or("bits")).alias("n"))
    return merged.groupBy(*KEY).agg(*[F.sum(F.when(F.col("member") == m, F.col("n"))).alias(f"distinct_{m}") for m in MEMBERS])


def totals(rollup: Rollup) -> DataFrame:
    """key, active_days, n, n_cost, quantity, cost and distinct counts over all days of ``rollup``."""
    summed = rollup.measures.groupBy(*KEY).agg(F.count("*").alias("active_days"), *[F.sum(c).alias(c) for c in ("n", "n_cost", "quantity", "cost")])
    counts = distinct_counts(rollup).select(*[F.col(c).alias(f"_{c}") for c in KEY], *[f"distinct_{m}" for m in MEMBERS])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY])
    none = F.lit(0).cast("long")
    return summed.join(counts, same, "left").select(*summed.columns, *[F.coalesce(f"distinct_{m}", none).alias(f"distinct_{m}") for m in MEMBERS])


def top_consumers(rollup: Rollup, as_of: date, days: int = 30, k: int = 10) -> DataFrame:
    """The four top lists in one layout, from one merge of the rollup."""
    found = totals(rollup.during(since(as_of, days) & (F.col("section") != "cloud"))).withColumn("total_cost", F.round("cost", 2))
    place = F.row_number().over(W.partitionBy("section").orderBy(F.desc_nulls_last("total_cost"), *[F.asc_nulls_last(c) for c in ("name", "label", "cloud_provider")]))
    best = found.withColumn("place", place).filter(F.col("place") <= k)  # each task passes on k of a section
    section = F.col("section")
    mean = rounded(ratio(F.col("cost"), F.col("n_cost")), 2)
    return best.select(
        F.concat(F.lit("TOP "), F.upper("section"), F.lit("S")).alias("report_section"), F.when(section == "job", F.coalesce("label", "name")).otherwise(F.col("name")).alias("name"), "cloud_provider",
        F.when(section == "sku", F.col("distinct_workspace_id")).otherwise(F.col("active_days")).alias("active_days"),
        F.when(section == "workspace", F.col("distinct_sku_name")).when(section == "user", F.col("distinct_workspace_id")).alias("unique_skus"),
        F.round("quantity", 2).alias("total_dbu"), "total_cost", F.when(section.isin("workspace", "job"), mean).alias("avg_daily_cost"),
    )


def monthly_stats(rollup: Rollup, as_of: date) -> DataFrame:
    """Per cloud: counts and totals of the previous month, and mean, largest and smallest day cost of all clouds.

    The mean weighs each day by the cloud's rows on it.
    """
    first, last = month_bounds(as_of)
    month = rollup.during(F.col("usage_date").between(day(first), day(last)) & (F.col("section") == "cloud"))
    daily = month.measures.withColumn("day_cost", F.sum("cost").over(W.partitionBy("usage_date")))  # a row a cloud
    weight = F.when(F.col("day_cost").isNotNull(), F.col("n"))
    days = daily.groupBy("cloud_provider").agg(
        rounded(ratio(F.sum(weight * dbl("day_cost")), F.sum(weight)), 2).alias("avg_daily_cost"),
        F.round(F.max("day_cost"), 2).alias("max_daily_cost"), F.round(F.min("day_cost"), 2).alias("min_daily_cost"),
    )
    return totals(month).join(days, "cloud_provider").select(
        "cloud_provider", F.col("active_days").alias("days_with_data"), F.col("distinct_workspace_id").alias("active_workspaces"), F.col("distinct_sku_name").alias("unique_skus"),
        F.round("quantity", 2).alias("total_dbu"), F.round("cost", 2).alias("total_cost"), "avg_daily_cost", "max_daily_cost", "min_daily_cost",
    )


def monthly_report(rollup: Rollup, as_of: date) -> DataFrame:
    return monthly_stats(rollup, as_of).select(day(month_bounds(as_of)[0]).alias("report_month"), F.lit("MONTHLY SUMMARY").alias("section"), "*")
