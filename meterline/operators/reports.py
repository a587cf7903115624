"""Aggregate, top-k and monthly reports over enriched rows."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.functions.columns import before, business_unit_path, day, dbl, grouped_number, month_of, ratio, rounded, since
from meterline.operators.cost import priced_originals, zero_default_daily

RUNNING = (W.unboundedPreceding, W.currentRow)


def _sum(column: str, digits: int = 2) -> Column:
    return F.round(F.sum(column), digits)


def _row_mean(column: str, digits: int = 2) -> Column:
    """Mean over non-null rows; decimal columns keep it exact."""
    return F.round(F.avg(column), digits)


# --- aggregate reports -------------------------------------------------------

def daily_summary(dashboard: DataFrame) -> DataFrame:
    return dashboard.groupBy("usage_date", "cloud_provider", "workspace_id").agg(
        F.sum("usage_quantity").alias("total_dbu"), F.sum("actual_cost").alias("total_cost"),
        F.countDistinct("sku_name").alias("unique_skus"),
    )


def refresh_summary(dashboard: DataFrame) -> DataFrame:
    return dashboard.agg(
        F.count("*").alias("total_records"), F.min("usage_date").alias("earliest_date"),
        F.max("usage_date").alias("latest_date"), F.sum("actual_cost").alias("total_cost"),
    )


def yesterday_cost(dashboard: DataFrame, as_of: date) -> DataFrame:
    return (
        dashboard.filter(F.col("usage_date") == before(as_of, 1))
        .groupBy("cloud_provider")
        .agg(
            _sum("actual_cost").alias("cost"), _sum("usage_quantity").alias("dbu"),
            F.countDistinct("workspace_id").alias("workspaces"),
        )
    )


def month_to_date(dashboard: DataFrame, as_of: date) -> DataFrame:
    return (
        dashboard.filter(F.col("usage_date").between(day(as_of.replace(day=1)), day(as_of)))
        .groupBy("cloud_provider")
        .agg(F.countDistinct("workspace_id").alias("workspaces"), _sum("actual_cost").alias("mtd_cost"))
    )


def total_spend(dashboard: DataFrame, as_of: date, days: int = 365, by: str = "customer_name") -> DataFrame:
    return (
        dashboard.filter(since(as_of, days))
        .groupBy(by, "cloud_provider")
        .agg(
            F.min("usage_date").alias("start_date"), F.max("usage_date").alias("end_date"),
            _sum("usage_quantity", 3).alias("dbu"), _sum("list_cost").alias("list_cost"),
            _sum("actual_cost").alias("total_cost"),
        )
    )


def flat_discount_spend(usage: DataFrame, prices: DataFrame, accounts: DataFrame, as_of: date, days: int = 365) -> DataFrame:
    """List spend, the same less a flat 15 %, and revenue per customer and cloud."""
    daily = zero_default_daily(usage, prices, as_of, days, ["account_id", "cloud"])
    stamp = lambda c: F.date_format(c, "yyyyMMddHHmm")
    return (
        daily.join(accounts.select("account_id", "customer_name"), "account_id", "left")
        .groupBy("customer_name", "cloud")
        .agg(
            stamp(F.min("usage_date")).alias("start_date"), stamp(F.max("usage_date")).alias("end_date"),
            _sum("quantity", 3).alias("dbu"), _sum("cost").alias("list_price"),
            F.round(F.sum("cost") * F.lit(0.85).cast("decimal(3,2)"), 2).alias("discounted_price"),
            _sum("cost").alias("revenue"),
        )
    )


def account_overview(usage: DataFrame, as_of: date, days: int = 365) -> DataFrame:
    return usage.filter(since(as_of, days)).agg(
        F.countDistinct("sku_name").alias("top_sku_count"), F.countDistinct("workspace_id").alias("top_workspace_count"),
        F.max("usage_date").alias("latest_usage_date"), F.min("usage_date").alias("earliest_usage_date"),
        F.datediff(F.max("usage_date"), F.min("usage_date")).alias("days_of_data"),
    )


def account_info_counts(accounts: DataFrame, usage: DataFrame, as_of: date, days: int = 365) -> DataFrame:
    """Metadata with distinct workspaces and SKUs; usage is counted before the join."""
    counts = usage.filter(since(as_of, days)).groupBy("account_id").agg(
        F.countDistinct("workspace_id").alias("total_workspaces"), F.countDistinct("sku_name").alias("total_skus")
    )
    return accounts.join(counts, "account_id", "left").select(
        "customer_name", "business_unit_l0", "business_unit_l1", "business_unit_l2", "business_unit_l3",
        "account_executive", "solutions_architect", "delivery_solutions_architect",
        F.coalesce("total_workspaces", F.lit(0)).alias("total_workspaces"),
        F.coalesce("total_skus", F.lit(0)).alias("total_skus"),
    )


def account_info_label(accounts: DataFrame) -> DataFrame:
    return accounts.select(
        "customer_name",
        business_unit_path("business_unit_l0", "business_unit_l1", "business_unit_l2", "business_unit_l3").alias("business_unit"),
        "account_executive", "solutions_architect", "delivery_solutions_architect",
    )


def monthly_trend(dashboard: DataFrame, as_of: date, days: int = 365) -> DataFrame:
    return (
        dashboard.filter(since(as_of, days))
        .groupBy(month_of("usage_date").alias("month"), "cloud_provider")
        .agg(
            _sum("usage_quantity").alias("monthly_dbu"), _sum("actual_cost").alias("monthly_cost"),
            F.countDistinct("workspace_id").alias("active_workspaces"), F.countDistinct("sku_name").alias("unique_skus"),
        )
    )


def category_trend(dashboard: DataFrame, as_of: date, days: int = 365) -> DataFrame:
    return (
        dashboard.filter(since(as_of, days))
        .groupBy(month_of("usage_date").alias("month"), F.col("product_category").alias("category"), "cloud_provider")
        .agg(_sum("usage_quantity").alias("total_dbu"), _sum("actual_cost").alias("total_cost"))
    )


def weekend_vs_weekday(dashboard: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    weekday = F.dayofweek("usage_date")
    return (
        dashboard.filter(since(as_of, days))
        .groupBy("usage_date")
        .agg(F.sum("actual_cost").alias("daily_cost"))
        .groupBy(F.when(weekday == 1, "Sunday").when(weekday == 7, "Saturday").otherwise("Weekday").alias("day_type"))
        .agg(_row_mean("daily_cost").alias("avg_cost"))
    )


def daily_cost_by_cloud(dashboard: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    return (
        dashboard.filter(since(as_of, days))
        .groupBy("usage_date", "cloud_provider")
        .agg(
            F.count("*").alias("record_count"), F.sum("usage_quantity").alias("total_dbu"),
            _sum("actual_cost").alias("total_cost"),
            _row_mean("actual_cost", 4).alias("avg_cost"),
        )
    )


def daily_cumulative_by_cloud(dashboard: DataFrame, as_of: date, days: int = 365) -> DataFrame:
    """Daily totals with a running cost per cloud (one row per day in each window)."""
    daily = dashboard.filter(since(as_of, days)).groupBy("usage_date", "cloud_provider").agg(
        F.sum("usage_quantity").alias("daily_dbu"), F.sum("actual_cost").alias("daily_cost")
    )
    window = W.partitionBy("cloud_provider").orderBy("usage_date").rowsBetween(*RUNNING)
    return daily.withColumn("cumulative_cost", F.sum("daily_cost").over(window))


def job_cost(usage: DataFrame, prices: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    meta = "usage_metadata."
    return (
        priced_originals(usage.filter(F.col(meta + "job_id").isNotNull()), prices, as_of, days)
        .groupBy(F.col(meta + "job_id").alias("job_id"), F.col(meta + "job_name").alias("job_name"))
        .agg(
            F.countDistinct(meta + "job_run_id").alias("run_count"), F.sum("usage_quantity").alias("total_dbu"),
            _sum("actual_cost").alias("total_cost"),
        )
    )


def summary_metrics_long(usage: DataFrame, prices: DataFrame, as_of: date) -> DataFrame:
    """Five headline figures as (metric, value) text rows, from three aggregates."""
    year = zero_default_daily(usage, prices, as_of, 365, ["usage_date"])
    spend = year.agg(
        F.sum("cost").alias("spend"), F.sum("quantity").alias("quantity"),
        F.avg(F.when(F.col("usage_date") >= before(as_of, 90), dbl("cost"))).alias("average"),
    ).select(
        F.explode(F.array(
            F.struct(F.lit("Total Spend (Last 365 days)").alias("metric"), grouped_number(F.col("spend"), 2).alias("value")),
            F.struct(F.lit("Total DBUs Consumed").alias("metric"), F.format_number("quantity", 2).alias("value")),
            F.struct(F.lit("Average Daily Spend").alias("metric"), grouped_number(F.col("average"), 2).alias("value")),
        )).alias("row")
    ).select("row.*")
    workspaces = usage.filter(since(as_of, 90)).agg(F.countDistinct("workspace_id").cast("string").alias("value"))
    skus = usage.filter(since(as_of, 365)).agg(F.countDistinct("sku_name").cast("string").alias("value"))
    return spend.unionByName(workspaces.withColumn("metric", F.lit("Active Workspaces"))).unionByName(
        skus.withColumn("metric", F.lit("Unique SKUs Used"))
    )


def high_cost_days(dashboard: DataFrame, as_of: date, days: int = 30, k: int = 10) -> DataFrame:
    return (
        dashboard.filter(since(as_of, days)).groupBy("usage_date").agg(F.sum("actual_cost").alias("daily_cost"))
        .orderBy(F.desc("daily_cost"), "usage_date").limit(k)
    )


def time_series(dashboard: DataFrame, as_of: date, grain: str = "WEEK", dims: tuple[str, ...] = ("cloud_provider",), days: int = 90) -> DataFrame:
    if grain.upper() not in ("DAY", "WEEK", "MONTH"):
        raise ValueError(f"unknown grain {grain}")
    period = F.date_trunc(grain, "usage_date").cast("date").alias("period")
    return dashboard.filter(since(as_of, days)).groupBy(period, *dims).agg(_sum("actual_cost").alias("cost"))


def cost_by(dashboard: DataFrame, as_of: date, dims: tuple[str, ...], days: int = 30, filters: Column | None = None) -> DataFrame:
    rows = dashboard.filter(since(as_of, days))
    rows = rows if filters is None else rows.filter(filters)
    return rows.groupBy(*dims).agg(
        F.countDistinct("usage_date").alias("active_days"), _sum("usage_quantity").alias("total_dbu"),
        _sum("actual_cost").alias("total_cost"),
    )


def period_summary(dashboard: DataFrame, as_of: date) -> DataFrame:
    """Last week and previous calendar month in one pass over day × workspace totals.

    Each total is tagged with the periods it falls in, so the source is read once.
    """
    month_start = (as_of - timedelta(days=30)).replace(day=1)
    this_month = as_of.replace(day=1)
    on = F.col("usage_date")
    week = on.between(before(as_of, 7), before(as_of, 1))
    month = (on >= day(month_start)) & (on < day(this_month))
    daily = dashboard.filter(week | month).groupBy("usage_date", "workspace_id").agg(F.sum("actual_cost").alias("cost"))
    tags = F.filter(F.array(F.when(week, "Last Week"), F.when(month, "Last Month")), lambda p: p.isNotNull())
    return daily.withColumn("period", F.explode(tags)).groupBy("period").agg(
        F.countDistinct("usage_date").alias("days_with_data"), F.round(F.sum("cost"), 2).alias("total_cost"),
        _row_mean("cost").alias("avg_daily_cost"), F.countDistinct("workspace_id").alias("active_workspaces"),
    )


def account_list(dashboard: DataFrame, as_of: date, days: int = 365, filters: Column | None = None) -> DataFrame:
    rows = dashboard.filter(since(as_of, days))
    rows = rows if filters is None else rows.filter(filters)
    return rows.select("customer_name").distinct()


def recent_rows(dashboard: DataFrame, as_of: date, days: int = 365, k: int = 100) -> DataFrame:
    """A preview of k rows under a total order, so that it repeats."""
    columns = ["usage_date", "account_id", "workspace_id", "cloud_provider", "sku_name", "usage_quantity", "actual_cost", "run_as"]
    order = [F.desc("usage_date"), *[F.asc_nulls_last(c) for c in columns[1:]]]
    return dashboard.filter(since(as_of, days)).select(*columns).orderBy(*order).limit(k)


# --- top-k -------------------------------------------------------------------

def _top(df: DataFrame, k: int, *keys: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("total_cost"), *[F.asc_nulls_last(c) for c in keys]).limit(k)


def top_workspaces(dashboard: DataFrame, as_of: date, days: int = 30, k: int = 10) -> DataFrame:
    out = dashboard.filter(since(as_of, days)).groupBy("workspace_id", "cloud_provider").agg(
        F.countDistinct("usage_date").alias("active_days"), F.countDistinct("sku_name").alias("unique_skus"),
        _sum("usage_quantity").alias("total_dbu"), _sum("actual_cost").alias("total_cost"),
        _row_mean("actual_cost").alias("avg_daily_cost"),
    )
    return _top(out, k, "workspace_id", "cloud_provider")


def top_skus(dashboard: DataFrame, as_of: date, days: int = 30, k: int = 10) -> DataFrame:
    out = dashboard.filter(since(as_of, days)).groupBy("sku_name", "cloud_provider", "product_category").agg(
        F.countDistinct("workspace_id").alias("workspace_count"), _sum("usage_quantity").alias("total_usage"),
        _sum("actual_cost").alias("total_cost"), _row_mean("price_per_unit", 4).alias("avg_price_per_unit"),
    )
    return _top(out, k, "sku_name", "cloud_provider", "product_category")


def top_jobs(dashboard: DataFrame, as_of: date, days: int = 30, k: int = 10) -> DataFrame:
    out = dashboard.filter(since(as_of, days) & F.col("job_id").isNotNull()).groupBy("job_id", "job_name", "cloud_provider").agg(
        F.countDistinct("usage_date").alias("run_days"), _sum("usage_quantity").alias("total_dbu"),
        _sum("actual_cost").alias("total_cost"), _row_mean("actual_cost").alias("avg_run_cost"),
    )
    return _top(out, k, "job_id", "job_name", "cloud_provider")


def top_users(dashboard: DataFrame, as_of: date, days: int = 30, k: int = 10) -> DataFrame:
    out = dashboard.filter(since(as_of, days) & F.col("run_as").isNotNull()).groupBy("run_as", "cloud_provider").agg(
        F.countDistinct("usage_date").alias("active_days"), F.countDistinct("workspace_id").alias("workspace_count"),
        _sum("usage_quantity").alias("total_dbu"), _sum("actual_cost").alias("total_cost"),
    )
    return _top(out, k, "run_as", "cloud_provider")


def top_consumers_report(workspaces: DataFrame, skus: DataFrame, jobs: DataFrame, users: DataFrame) -> DataFrame:
    """The four top lists stacked into one layout."""
    none_count, none_cost = F.lit(None).cast("long"), F.lit(None).cast("double")

    def section(df, label, name, days, unique, quantity, mean):
        return df.select(
            F.lit(label).alias("report_section"), name.alias("name"), "cloud_provider", F.col(days).alias("active_days"),
            unique.alias("unique_skus"), F.col(quantity).alias("total_dbu"), "total_cost", mean.alias("avg_daily_cost"),
        )

    return (
        section(workspaces, "TOP WORKSPACES", F.col("workspace_id"), "active_days", F.col("unique_skus"), "total_dbu", F.col("avg_daily_cost"))
        .unionByName(section(skus, "TOP SKUS", F.col("sku_name"), "workspace_count", none_count, "total_usage", none_cost))
        .unionByName(section(jobs, "TOP JOBS", F.coalesce("job_name", "job_id"), "run_days", none_count, "total_dbu", F.col("avg_run_cost")))
        .unionByName(section(users, "TOP USERS", F.col("run_as"), "active_days", F.col("workspace_count"), "total_dbu", none_cost))
    )


def top_workspaces_90d(dashboard: DataFrame, as_of: date, days: int = 90, k: int = 10) -> DataFrame:
    out = dashboard.filter(since(as_of, days)).groupBy("workspace_id", "cloud_provider").agg(
        F.countDistinct("sku_name").alias("sku_count"), _sum("usage_quantity").alias("total_dbu"),
        _sum("actual_cost").alias("total_cost"), F.countDistinct("usage_date").alias("active_days"),
    )
    return _top(out, k, "workspace_id", "cloud_provider")


def top_skus_90d(dashboard: DataFrame, as_of: date, days: int = 90, k: int = 10) -> DataFrame:
    out = dashboard.filter(since(as_of, days)).groupBy("sku_name", "cloud_provider", "usage_unit").agg(
        _sum("usage_quantity").alias("total_usage"), _sum("actual_cost").alias("total_cost"),
        F.countDistinct("workspace_id").alias("workspace_count"), F.countDistinct("usage_date").alias("active_days"),
    )
    return _top(out, k, "sku_name", "cloud_provider", "usage_unit")


# --- monthly -----------------------------------------------------------------

def month_bounds(as_of: date) -> tuple[date, date]:
    """First and last day of the month that holds the day 30 days before ``as_of``."""
    first = (as_of - timedelta(days=30)).replace(day=1)
    return first, (first + timedelta(days=32)).replace(day=1) - timedelta(days=1)


def prev_month_range(spark: SparkSession, as_of: date) -> DataFrame:
    anchor = before(as_of, 30)
    return spark.range(1).select(month_of(anchor).alias("month_start"), F.last_day(anchor).alias("month_end"))


def _in_prev_month(as_of: date) -> Column:
    first, last = month_bounds(as_of)
    return F.col("usage_date").between(day(first), day(last))


def monthly_stats(dashboard: DataFrame, as_of: date) -> DataFrame:
    """Per cloud: counts and totals, and mean/max/min of the all-cloud day cost.

    The mean weighs each day by the cloud's rows on it. Rows are collapsed to
    cloud × day first; the day totals then come from a window over at most one
    row per cloud and day.
    """
    rows = dashboard.filter(_in_prev_month(as_of))
    counts = rows.groupBy("cloud_provider").agg(
        F.countDistinct("workspace_id").alias("active_workspaces"), F.countDistinct("sku_name").alias("unique_skus")
    )
    daily = (
        rows.groupBy("cloud_provider", "usage_date")
        .agg(F.count("*").alias("n"), F.sum("usage_quantity").alias("q"), F.sum("actual_cost").alias("c"))
        .withColumn("day_cost", F.sum("c").over(W.partitionBy("usage_date")))
    )
    weight = F.when(F.col("day_cost").isNotNull(), F.col("n"))
    stats = daily.groupBy("cloud_provider").agg(
        F.count("*").alias("days_with_data"), _sum("q").alias("total_dbu"), _sum("c").alias("total_cost"),
        rounded(ratio(F.sum(weight * dbl("day_cost")), F.sum(weight)), 2).alias("avg_daily_cost"),
        F.round(F.max("day_cost"), 2).alias("max_daily_cost"), F.round(F.min("day_cost"), 2).alias("min_daily_cost"),
    )
    return stats.join(counts, "cloud_provider").select(
        "cloud_provider", "days_with_data", "active_workspaces", "unique_skus", "total_dbu", "total_cost",
        "avg_daily_cost", "max_daily_cost", "min_daily_cost",
    )


def product_breakdown(dashboard: DataFrame, as_of: date) -> DataFrame:
    totals = dashboard.filter(_in_prev_month(as_of)).groupBy("product_category").agg(F.sum("actual_cost").alias("total"))
    return totals.select(
        "product_category", F.round("total", 2).alias("cost"),
        rounded(ratio(F.col("total") * 100, F.sum("total").over(W.partitionBy())), 1).alias("cost_pct"),
    )


def _change(current: str, previous: str) -> Column:
    return rounded(ratio(F.col(current) - F.col(previous), F.col(previous)) * 100, 1)


def month_over_month(dashboard: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    monthly = dashboard.filter(since(as_of, days)).groupBy(month_of("usage_date").alias("month"), "cloud_provider").agg(
        _sum("actual_cost").alias("monthly_cost")
    )
    previous = F.lag("monthly_cost").over(W.partitionBy("cloud_provider").orderBy("month"))
    return (
        monthly.withColumn("prev_month_cost", previous)
        .filter(F.col("prev_month_cost").isNotNull())
        .withColumn("cost_change", F.round(F.col("monthly_cost") - F.col("prev_month_cost"), 2))
        .withColumn("pct_change", _change("monthly_cost", "prev_month_cost"))
    )


def monthly_report(dashboard: DataFrame, as_of: date) -> DataFrame:
    return monthly_stats(dashboard, as_of).select(
        day(month_bounds(as_of)[0]).alias("report_month"), F.lit("MONTHLY SUMMARY").alias("section"), "*"
    )


def monthly_change_total(dashboard: DataFrame, as_of: date, days: int = 180) -> DataFrame:
    """All clouds per month against the month before (at most seven rows in the window)."""
    monthly = dashboard.filter(since(as_of, days)).groupBy(month_of("usage_date").alias("month")).agg(F.sum("actual_cost").alias("total"))
    return (
        monthly.withColumn("previous", F.lag("total").over(W.orderBy("month")))
        .filter(F.col("previous").isNotNull())
        .select("month", F.round("total", 2).alias("cost"), F.round("previous", 2).alias("prev_cost"),
                _change("total", "previous").alias("month_over_month_pct"))
    )
