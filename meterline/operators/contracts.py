"""Contract burndown, pace and status."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.functions.columns import (
    before, business_unit_path, day, dbl, grouped_number, month_of,
    pace_status, projected_end_date, ratio, rounded, since, urgency, whole_days,
)
from meterline.params import MAX_PROJECTED_END, PACE, PaceThresholds

RUNNING = (W.unboundedPreceding, W.currentRow)


def daily_account_costs(dashboard: DataFrame, cost: str = "actual_cost") -> DataFrame:
    """One row per account, cloud and day.

    Sums are distributive, so contracts can be joined to this instead of to the
    rows. A busy account then weighs no more than its number of days.
    """
    return dashboard.groupBy("account_id", "cloud_provider", "usage_date").agg(
        F.sum(cost).alias("daily_cost"), F.count("*").alias("record_count")
    )


def join_term(contracts: DataFrame, daily: DataFrame, last_day: Column, how: str = "inner") -> DataFrame:
    """Contracts with the account's days from the start date to ``last_day``."""
    c, d = contracts.alias("c"), daily.alias("d")
    return c.join(
        d,
        (F.col("c.account_id") == F.col("d.account_id"))
        & (F.col("c.cloud_provider") == F.col("d.cloud_provider"))
        & (F.col("d.usage_date") >= F.col("c.start_date"))
        & (F.col("d.usage_date") <= last_day),
        how,
    ).select("c.*", "d.usage_date", "d.daily_cost", "d.record_count")


def contract_costs(contracts: DataFrame, dashboard: DataFrame, as_of: date, until_as_of: bool = False, cost: str = "actual_cost") -> DataFrame:
    """Every contract with its consumption; contracts without usage stay, with null."""
    last_day = day(as_of) if until_as_of else F.col("c.end_date")
    joined = join_term(contracts, daily_account_costs(dashboard, cost), last_day, "left")
    return joined.groupBy(*contracts.columns).agg(
        F.sum("daily_cost").alias("consumed"), F.min("usage_date").alias("earliest_usage"),
        F.max("usage_date").alias("latest_usage"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("data_points"),
    )


def _active(contracts: DataFrame) -> DataFrame:
    return contracts.filter(F.col("status") == "ACTIVE")


def contract_burndown(contracts: DataFrame, dashboard: DataFrame, as_of: date) -> DataFrame:
    """Daily and cumulative cost of active contracts against an even burn."""
    rows = join_term(_active(contracts), daily_account_costs(dashboard), F.col("c.end_date")).filter(
        F.col("usage_date") <= day(as_of)
    )
    return burndown_columns(rows.withColumn("cumulative_cost", running_cost()))


def running_cost() -> Column:
    return F.sum("daily_cost").over(W.partitionBy("contract_id").orderBy("usage_date").rowsBetween(*RUNNING))


def burndown_columns(rows: DataFrame) -> DataFrame:
    """The burndown's columns from contract terms, ``usage_date``, ``daily_cost`` and ``cumulative_cost``."""
    elapsed = F.datediff("usage_date", "start_date")
    total = F.datediff("end_date", "start_date")
    safe_total = F.greatest(total, F.lit(1))
    return rows.select(
        "contract_id", "cloud_provider", "start_date", "end_date", F.col("total_value").alias("commitment"), "currency",
        "commitment_type", "notes", "usage_date", "daily_cost", "cumulative_cost",
        (F.col("total_value") - F.col("cumulative_cost")).alias("remaining_budget"),
        (elapsed * dbl("total_value") / safe_total).alias("projected_linear_burn"),
        elapsed.alias("days_elapsed"), total.alias("total_contract_days"),
        rounded(elapsed * 100.0 / safe_total, 2).alias("time_pct_complete"),
        rounded(ratio(F.col("cumulative_cost"), F.col("total_value")) * 100, 2).alias("budget_pct_consumed"),
    )


def burndown_summary(burndown: DataFrame, as_of: date, cap: date = MAX_PROJECTED_END, pace: PaceThresholds = PACE) -> DataFrame:
    """Latest state per contract. Pace compares with the share of time at the last usage date."""
    keys = ["contract_id", "cloud_provider", "start_date", "end_date", "commitment", "currency"]
    latest = burndown.groupBy(*keys).agg(
        F.max("usage_date").alias("last_usage_date"), F.max("cumulative_cost").alias("total_consumed"),
        F.max("days_elapsed").alias("days_into_contract"), F.max("total_contract_days").alias("contract_duration"),
        F.max("budget_pct_consumed").alias("pct_consumed"),
    )
    spent, value, days_in = F.col("total_consumed"), F.col("commitment"), F.col("days_into_contract")
    time_pct = ratio(days_in * 100.0, F.col("contract_duration"))
    return latest.select(
        "contract_id", "cloud_provider", "start_date", "end_date", "commitment", "total_consumed",
        F.greatest(value - spent, F.lit(0)).alias("budget_remaining"),
        rounded(ratio(spent, value) * 100, 2).alias("consumed_pct"), "days_into_contract",
        F.datediff("end_date", day(as_of)).alias("days_remaining"),
        pace_status(F.col("pct_consumed"), time_pct, pace).alias("pace_status"),
        projected_end_date(F.col("start_date"), value, days_in, spent, F.col("end_date"), cap).alias("projected_end_date"),
        "last_usage_date",
    )


def contract_analysis(contracts: DataFrame, dashboard: DataFrame, as_of: date, pace: PaceThresholds = PACE) -> DataFrame:
    """Running active contracts with pace measured at ``as_of``; no-usage contracts stay."""
    costs = contract_costs(_active(contracts).filter(F.col("end_date") >= day(as_of)), dashboard, as_of)
    spent, value = dbl("consumed"), dbl("total_value")
    elapsed, total = F.datediff(day(as_of), "start_date"), F.datediff("end_date", "start_date")
    days_left = (value - spent) / F.nullif(ratio(spent, elapsed), F.lit(0.0))
    return costs.select(
        "contract_id", "cloud_provider", "start_date", "end_date", "total_value", F.round("consumed", 2).alias("consumed"),
        F.round(F.col("total_value") - F.col("consumed"), 2).alias("remaining"),
        rounded(ratio(spent, value) * 100, 1).alias("consumed_pct"),
        rounded(ratio(elapsed * 100.0, total), 1).alias("time_elapsed_pct"),
        F.datediff("end_date", day(as_of)).alias("remaining_days"),
        pace_status(ratio(spent, value), ratio(elapsed, total), pace).alias("pace_status"),
        F.date_add(day(as_of), whole_days(days_left)).alias("projected_end_date"),
    )


def _shares(as_of: date) -> tuple[Column, Column]:
    spent = ratio(F.col("consumed"), F.col("total_value"))
    elapsed = ratio(F.datediff(day(as_of), "start_date"), F.datediff("end_date", "start_date"))
    return spent, elapsed


def consumption_rate(contracts: DataFrame, dashboard: DataFrame, as_of: date) -> DataFrame:
    spent, elapsed = _shares(as_of)
    return contract_costs(_active(contracts), dashboard, as_of, until_as_of=True).select(
        "contract_id", "total_value", F.round("consumed", 2).alias("spent"), rounded(spent * 100, 1).alias("pct_consumed"),
        rounded(elapsed * 100, 1).alias("pct_elapsed"),
        F.when(spent > elapsed, "OVER PACE").when(spent < elapsed * 0.8, "UNDER PACE").otherwise("ON PACE").alias("consumption_status"),
    )


def contracts_with_consumption(contracts: DataFrame, dashboard: DataFrame, as_of: date, cost: str = "actual_cost") -> DataFrame:
    consumed = F.coalesce("consumed", F.lit(0))
    return contract_costs(_active(contracts), dashboard, as_of, cost=cost).select(
        F.col("cloud_provider").alias("platform"), "contract_id", "start_date", "end_date", "total_value",
        consumed.alias("consumed"), rounded(ratio(consumed, F.col("total_value")) * 100, 1).alias("consumed_pct"),
    )


def combined_burndown(burndown: DataFrame, as_of: date, days: int = 365) -> DataFrame:
    return burndown.filter(since(as_of, days)).groupBy(F.col("usage_date").alias("date")).agg(
        F.sum("commitment").alias("total_commitment"), F.sum("cumulative_cost").alias("total_consumption"),
        rounded(ratio(F.sum("cumulative_cost"), F.sum("commitment")) * 100, 1).alias("overall_pct_consumed"),
    )


def burndown_chart(burndown: DataFrame, as_of: date, days: int = 180) -> DataFrame:
    return burndown.filter(since(as_of, days)).select(
        "contract_id",
        F.concat("contract_id", F.lit(" ("), grouped_number(F.col("commitment")), F.lit(")")).alias("contract_label"),
        F.col("usage_date").alias("date"), F.round("cumulative_cost", 2).alias("actual_consumption"),
        rounded("projected_linear_burn", 2).alias("ideal_consumption"), F.round("commitment", 2).alias("contract_value"),
        F.round("remaining_budget", 2).alias("remaining_budget"), rounded("budget_pct_consumed", 1).alias("pct_consumed"),
    )


def _percent(column: str) -> Column:
    return F.concat(rounded(column, 1).cast("string"), F.lit("%"))


def contract_summary_table(summary: DataFrame) -> DataFrame:
    return summary.select(
        "contract_id", "cloud_provider", "start_date", "end_date", grouped_number(F.col("commitment")).alias("total_value"),
        grouped_number(F.col("total_consumed"), 2).alias("consumed"), grouped_number(F.col("budget_remaining"), 2).alias("remaining"),
        _percent("consumed_pct").alias("pct_consumed"), "pace_status", F.col("days_remaining").alias("days_left"),
        F.col("projected_end_date").alias("projected_end"),
    )


def daily_consumption(burndown: DataFrame, as_of: date) -> DataFrame:
    return burndown.filter(F.col("usage_date") == before(as_of, 1)).groupBy(F.col("usage_date").alias("date")).agg(
        F.round(F.sum("daily_cost"), 2).alias("daily_cost"), F.countDistinct("contract_id").alias("active_contracts")
    )


def pace_distribution(summary: DataFrame) -> DataFrame:
    return summary.groupBy("pace_status").agg(
        F.count("*").alias("contract_count"), rounded(F.avg("consumed_pct"), 1).alias("avg_consumed_pct"),
        rounded(F.avg("days_remaining"), 0).alias("avg_days_remaining"),
    )


def contract_monthly(burndown: DataFrame, as_of: date, days: int = 365) -> DataFrame:
    return burndown.filter(since(as_of, days)).groupBy(month_of("usage_date").alias("month"), "contract_id").agg(
        F.sum("daily_cost").alias("monthly_cost"), F.count("*").alias("days_active")
    )


def budget_health(summary: DataFrame) -> DataFrame:
    projected, end = F.col("projected_end_date"), F.col("end_date")
    return summary.select(
        "contract_id", F.col("commitment").alias("value"), F.round("total_consumed", 2).alias("spent"),
        rounded("consumed_pct", 1).alias("pct_used"), "pace_status", "days_remaining",
        F.datediff(projected, end).alias("days_variance"),
        F.when(projected < end, "Will deplete early").when(projected > end, "Under budget").otherwise("On track").alias("budget_health"),
        projected.alias("est_depletion_date"), end.alias("contract_end_date"),
    )


def expiring_contracts(contracts: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    left = F.datediff("end_date", day(as_of))
    return _active(contracts).filter(F.col("end_date") <= F.date_add(day(as_of), days)).select(
        "contract_id", "total_value", "end_date", left.alias("days_remaining"), urgency(left).alias("urgency")
    )


def near_completion(summary: DataFrame, pct: float = 80, days: int = 30) -> DataFrame:
    return summary.filter((F.col("consumed_pct") > pct) | (F.col("days_remaining") < days)).select(
        "contract_id", rounded("consumed_pct", 1).alias("pct_used"), "days_remaining", "pace_status"
    )


def overrun_risk_ranking(contracts: DataFrame, dashboard: DataFrame, as_of: date) -> DataFrame:
    """Contracts with their pace ratio; sort by ``pace_ratio`` for the ranking."""
    spent, elapsed = _shares(as_of)
    return contract_costs(_active(contracts), dashboard, as_of, until_as_of=True).select(
        "contract_id", F.round("consumed", 2).alias("spent"), "total_value", rounded(spent * 100, 1).alias("pct_consumed"),
        rounded(elapsed * 100, 1).alias("pct_elapsed"),
        F.when(spent > elapsed * 1.2, "OVERRUN RISK").when(spent > elapsed * 1.1, "MONITOR").otherwise("ON TRACK").alias("risk_status"),
        rounded(ratio(spent, elapsed), 4).alias("pace_ratio"),
    ).orderBy(F.desc_nulls_last("pace_ratio"), "contract_id")


def daily_pace_status(contracts: DataFrame, dashboard: DataFrame, as_of: date) -> DataFrame:
    """Pace class on every day. Joined on account and cloud, so a contract only
    sees its own cost."""
    rows = contract_burndown(contracts, dashboard, as_of)
    consumed = ratio(F.col("cumulative_cost"), F.col("commitment"))
    elapsed = ratio(F.col("days_elapsed"), F.col("total_contract_days"))
    return rows.select(
        "contract_id", "usage_date", F.round("daily_cost", 2).alias("daily_cost"),
        F.round("cumulative_cost", 2).alias("cumulative_cost"), "commitment",
        F.when(consumed > elapsed * 1.2, "OVER_PACE").when(consumed < elapsed * 0.8, "UNDER_PACE").otherwise("ON_PACE").alias("pace_status"),
    )


def rolling_burn_rate_7d(series: DataFrame) -> DataFrame:
    """Seven-day mean of the gap-filled daily series ``(contract_id, ds, y)``."""
    window = W.partitionBy("contract_id").orderBy("ds").rowsBetween(-6, 0)
    y = F.col("y").cast("decimal(28,6)")
    return series.select("contract_id", "ds", "y", rounded(dbl(F.sum(y).over(window)) / F.count(y).over(window), 4).alias("burn_rate_7d"))


def linear_exhaustion(burndown: DataFrame) -> DataFrame:
    """Depletion date at the mean spend between the first and last usage day."""
    totals = burndown.groupBy("contract_id", "commitment", "end_date").agg(
        F.max("cumulative_cost").alias("spent"), F.min("usage_date").alias("first_date"), F.max("usage_date").alias("last_date")
    ).withColumn("days_elapsed", F.datediff("last_date", "first_date"))
    spent, value = dbl("spent"), dbl("commitment")
    average = ratio(spent, F.col("days_elapsed"))
    left = F.when(average > 0, (value - spent) / F.nullif(average, F.lit(0.0)))
    return totals.filter((F.col("days_elapsed") > 0) & (F.col("spent") > 0)).select(
        "contract_id", "commitment", F.round("spent", 2).alias("total_spent"), rounded(average, 2).alias("avg_daily_spend"),
        F.round(F.col("commitment") - F.col("spent"), 2).alias("remaining_budget"), rounded(left, 1).alias("days_to_exhaustion"),
        F.date_add("last_date", whole_days(F.floor(left).cast("double"))).alias("projected_exhaustion_date"),
    )


def contract_account_view(contracts: DataFrame, accounts: DataFrame) -> DataFrame:
    info = accounts.select(
        "account_id", "customer_name", "account_executive", "solutions_architect",
        business_unit_path("business_unit_l0", "business_unit_l1", "business_unit_l2").alias("business_unit"),
    )
    return contracts.join(info, "account_id", "left").select(
        "contract_id", "account_id", "customer_name", "cloud_provider", "start_date", "end_date", "total_value", "status",
        "account_executive", "solutions_architect", F.coalesce("business_unit", F.lit("")).alias("business_unit"),
    )


def entity_statistics(contracts: DataFrame, accounts: DataFrame) -> DataFrame:
    in_status = lambda s: F.count_if(F.col("status") == s)
    left = contracts.agg(
        F.count("*").alias("total_records"), F.countDistinct("account_id").alias("unique_accounts"),
        in_status("ACTIVE").alias("active_count"), in_status("EXPIRED").alias("expired_count"),
        in_status("PENDING").alias("pending_count"), F.sum("total_value").alias("total_contract_value"),
    ).withColumn("entity", F.lit("Contracts"))
    right = accounts.agg(
        F.count("*").alias("total_records"), F.countDistinct("account_id").alias("unique_accounts"),
        F.countDistinct("business_unit_l0").alias("active_count"), F.countDistinct("account_executive").alias("expired_count"),
        F.countDistinct("solutions_architect").alias("pending_count"),
    ).withColumn("entity", F.lit("Account Metadata"))
    return left.unionByName(right, allowMissingColumns=True)


def active_contracts(contracts: DataFrame, as_of: date) -> DataFrame:
    return _active(contracts).select(
        "contract_id", "cloud_provider", "start_date", "end_date", "total_value", "currency", "status",
        F.datediff("end_date", "start_date").alias("contract_days"), F.datediff(day(as_of), "start_date").alias("days_elapsed"),
        F.datediff("end_date", day(as_of)).alias("days_remaining"), "notes",
    )


def usage_coverage(contracts: DataFrame, dashboard: DataFrame, as_of: date) -> DataFrame:
    return contract_costs(contracts, dashboard, as_of).select(
        "contract_id", "start_date", "end_date", "earliest_usage", "latest_usage", "data_points"
    )


def actual_plus_forecast(burndown: DataFrame, forecast: DataFrame) -> DataFrame:
    """History and the forecast after its last day, as one series per contract."""
    last = burndown.groupBy("contract_id").agg(F.max("usage_date").alias("last_actual"))
    actual = burndown.select(
        "contract_id", F.col("usage_date").alias("date"), dbl("daily_cost").alias("daily_cost"),
        dbl("cumulative_cost").alias("cumulative_cost"), F.lit("ACTUAL").alias("source"),
    )
    future = forecast.join(last, "contract_id").filter(F.col("forecast_date") > F.col("last_actual")).select(
        "contract_id", F.col("forecast_date").alias("date"), dbl("predicted_daily_cost").alias("daily_cost"),
        dbl("predicted_cumulative").alias("cumulative_cost"), F.lit("FORECAST").alias("source"),
    )
    return actual.unionByName(future)
