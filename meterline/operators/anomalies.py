"""Spending anomalies and alert rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.functions.columns import before, day, dbl, ratio, rounded, since
from meterline.operators.contracts import contract_costs


def _daily(dashboard: DataFrame, as_of: date, days: int, keys: list[str]) -> DataFrame:
    return dashboard.filter(since(as_of, days)).groupBy("usage_date", *keys).agg(F.sum("actual_cost").alias("cost"))


def _with_previous(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Cost of the previous row that exists, which need not be the day before."""
    window = W.partitionBy(*keys).orderBy("usage_date")
    return daily.withColumn("previous", F.lag("cost").over(window)).withColumn(
        "change", ratio(F.col("cost") - F.col("previous"), F.col("previous"))
    )


def daily_spikes(dashboard: DataFrame, as_of: date, days: int = 30, threshold: float = 0.5) -> DataFrame:
    keys = ["cloud_provider", "workspace_id"]
    return (
        _with_previous(_daily(dashboard, as_of, days, keys), keys)
        .filter((F.col("previous") > 0) & (F.abs("change") > threshold))
        .select(
            "usage_date", *keys, F.round("cost", 2).alias("today_cost"), F.round("previous", 2).alias("yesterday_cost"),
            F.round(F.col("cost") - F.col("previous"), 2).alias("cost_change"),
            rounded(F.col("change") * 100, 1).alias("pct_change"),
        )
    )


def weekend_usage(dashboard: DataFrame, as_of: date, days: int = 30, threshold: float = 100) -> DataFrame:
    """Weekend rows above the threshold, each row judged alone, then summed."""
    weekday = F.dayofweek("usage_date")
    return (
        dashboard.filter(since(as_of, days) & weekday.isin(1, 7) & (F.col("actual_cost") > threshold))
        .groupBy("usage_date", weekday.alias("day_of_week"), "workspace_id", "cloud_provider")
        .agg(F.round(F.sum("actual_cost"), 2).alias("cost"))
    )


def new_workspaces(dashboard: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Workspaces first seen within the window.

    First date, active days and cost come from one aggregate: a workspace that
    passes has all of its rows inside the window anyway.
    """
    return (
        dashboard.groupBy("workspace_id", "cloud_provider", "usage_date")
        .agg(F.sum("actual_cost").alias("cost"))
        .groupBy("workspace_id", "cloud_provider")
        .agg(
            F.min("usage_date").alias("first_seen"), F.datediff(day(as_of), F.min("usage_date")).alias("days_active"),
            F.count("*").alias("usage_days"), F.round(F.sum("cost"), 2).alias("total_cost"),
        )
        .filter(F.col("first_seen") >= before(as_of, days))
    )


def anomaly_summary(spikes: DataFrame, weekend: DataFrame, new: DataFrame) -> DataFrame:
    def row(df: DataFrame, label: str, impact: str) -> DataFrame:
        return df.agg(F.count("*").alias("count"), F.round(F.sum(impact), 2).alias("total_impact")).select(
            F.lit(label).alias("anomaly_type"), "count", F.col("total_impact").cast("double").alias("total_impact")
        )

    return (
        row(spikes, "Daily Anomalies", "cost_change")
        .unionByName(row(weekend, "Weekend Usage", "cost"))
        .unionByName(row(new, "New Workspaces", "total_cost"))
    )


def spike_alerts(spikes: DataFrame, k: int = 10) -> DataFrame:
    return (
        spikes.filter(F.col("pct_change") > 0)
        .select(F.lit("DAILY SPIKE").alias("alert_type"), "usage_date", "cloud_provider", "workspace_id",
                "today_cost", "yesterday_cost", "pct_change")
        .orderBy(F.desc("pct_change"), "usage_date", "cloud_provider", "workspace_id")
        .limit(k)
    )


def workspace_spikes(dashboard: DataFrame, as_of: date, days: int = 30, threshold: float = 0.5, k: int = 10) -> DataFrame:
    return (
        _with_previous(_daily(dashboard, as_of, days, ["workspace_id"]), ["workspace_id"])
        .filter((F.col("previous") > 0) & (F.col("change") > threshold))
        .select("usage_date", "workspace_id", F.round("cost", 2).alias("today_cost"),
                F.round("previous", 2).alias("yesterday_cost"), rounded(F.col("change") * 100, 1).alias("pct_change"))
        .orderBy(F.desc("pct_change"), "usage_date", "workspace_id")
        .limit(k)
    )


def day_over_day_change(dashboard: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """Total per day against the previous day present; the window holds one row per day."""
    daily = _daily(dashboard, as_of, days, []).withColumn("previous", F.lag("cost").over(W.orderBy("usage_date")))
    return daily.select(
        "usage_date", F.round("cost", 2).alias("cost"), F.round(F.col("cost") - F.col("previous"), 2).alias("change"),
        rounded(ratio(F.col("cost") - F.col("previous"), F.col("previous")) * 100, 1).alias("pct_change"),
    )


def high_spend_alert(dashboard: DataFrame, as_of: date, days: int = 30, factor: float = 1.5) -> DataFrame:
    """Yesterday against the mean of the days before it, in one pass."""
    yesterday = before(as_of, 1)
    daily = dashboard.filter(F.col("usage_date").between(before(as_of, days), yesterday)).groupBy("usage_date").agg(
        dbl(F.sum("actual_cost")).alias("cost")
    )
    is_last = F.col("usage_date") == yesterday
    totals = daily.agg(
        F.max(F.when(is_last, F.col("cost"))).alias("yesterday_spend"), F.avg(F.when(~is_last, F.col("cost"))).alias("avg_daily_spend")
    )
    raised = F.col("yesterday_spend") > F.col("avg_daily_spend") * factor
    return totals.select(
        rounded("yesterday_spend", 2).alias("yesterday_spend"), rounded("avg_daily_spend", 2).alias("avg_daily_spend"),
        F.when(raised, "HIGH SPEND ALERT").otherwise("No alert").alias("alert_message"),
    )


def non_positive_usage(costed_usage: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    return costed_usage.filter(since(as_of, days)).filter((F.col("actual_cost") <= 0) | (F.col("usage_quantity") <= 0)).select(
        "usage_date", "workspace_id", "sku_name", "usage_quantity", "actual_cost", F.lit("Negative or zero cost").alias("issue")
    )


def first_seen_recent(dashboard: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """Workspaces whose first date over all history is in the last days."""
    return dashboard.groupBy("workspace_id").agg(F.min("usage_date").alias("first_seen")).filter(
        F.col("first_seen") >= before(as_of, days)
    )


def exhaustion_alert(forecast: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    left = F.datediff("exhaustion_date_p50", day(as_of))
    return (
        forecast.filter(left.between(1, days))
        .select("contract_id", F.col("exhaustion_date_p50").alias("predicted_exhaustion"), left.alias("days_until_exhaustion"),
                F.lit("ALERT: Contract exhausting soon").alias("alert_message"))
        .distinct()
    )


def contract_overrun_alert(contracts: DataFrame, dashboard: DataFrame, as_of: date, limit: float = 1.1) -> DataFrame:
    costs = contract_costs(contracts.filter(F.col("status") == "ACTIVE"), dashboard, as_of, until_as_of=True)
    spent = ratio(F.col("consumed"), F.col("total_value"))
    elapsed = ratio(F.datediff(day(as_of), "start_date"), F.datediff("end_date", "start_date"))
    pct_spent, pct_time = rounded(spent * 100, 1), rounded(elapsed * 100, 1)
    return costs.filter(spent > elapsed * limit).select(
        "contract_id", pct_spent.alias("pct_spent"), pct_time.alias("pct_elapsed"),
        F.concat(F.lit("CONTRACT ALERT: "), F.col("contract_id"), F.lit(" is consuming faster than expected. "),
                 pct_spent.cast("string"), F.lit("% spent with "), pct_time.cast("string"), F.lit("% time elapsed")).alias("alert_message"),
    )


def staleness_alert(df: DataFrame, date_col: str, as_of: date, days: int = 3) -> DataFrame:
    behind = F.datediff(day(as_of), F.max(date_col))
    return df.agg(
        F.max(date_col).alias("latest_date"), behind.alias("max_staleness_days"),
        F.when(behind > days, "ALERT: Data pipeline may be failing").otherwise("OK").alias("alert_status"),
    )
