"""Daily series, forecasts, exhaustion dates and model bookkeeping."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.functions.columns import day, dbl, mape_grade, money, ratio, rounded, since
from meterline.operators.contracts import daily_account_costs, join_term
from meterline.operators.seasonal import seasonal_values
from meterline.params import FORECAST_BUFFER_DAYS, FORECAST_HORIZON_DAYS, MIN_TRAINING_DAYS

RUNNING = (W.unboundedPreceding, W.currentRow)
TERM = ["contract_id", "account_id", "cloud_provider", "contract_start", "contract_end", "contract_value"]
FORECAST = ["contract_id", "ds", "yhat", "yhat_lower", "yhat_upper"]


# --- series ------------------------------------------------------------------

def contract_daily_costs(contracts: DataFrame, dashboard: DataFrame, as_of: date) -> DataFrame:
    """Active contracts with daily cost from the start date to ``as_of``, past the end date too."""
    terms = contracts.filter(F.col("status") == "ACTIVE")
    return join_term(terms, daily_account_costs(dashboard), day(as_of)).select(
        "contract_id", "account_id", "cloud_provider", F.col("start_date").alias("contract_start"),
        F.col("end_date").alias("contract_end"), F.col("total_value").alias("contract_value"), "usage_date", "daily_cost", "record_count",
    )


def date_spine(daily: DataFrame) -> DataFrame:
    """Every day between a contract's first and last usage day."""
    spans = daily.groupBy(*TERM).agg(F.min("usage_date").alias("first"), F.max("usage_date").alias("last"))
    return spans.select(*TERM, F.explode(F.sequence("first", "last")).alias("ds"))


def forecast_features(daily: DataFrame) -> DataFrame:
    """Gap-filled series with calendar columns and running totals.

    Each usage day is spread over the days up to the next one, so the spine needs no
    second pass over the costs.
    """
    following = F.lead("usage_date").over(W.partitionBy("contract_id").orderBy("usage_date"))
    until = F.coalesce(F.date_sub("following", 1), F.col("usage_date"))
    filled = daily.withColumn("following", following).select(*TERM, "usage_date", "daily_cost", F.explode(F.sequence("usage_date", until)).alias("ds"))
    filled = filled.withColumn("daily_cost", F.when(F.col("ds") == F.col("usage_date"), F.col("daily_cost")))
    running = F.sum("y").over(W.partitionBy("contract_id").orderBy("ds").rowsBetween(*RUNNING))
    return (
        filled.withColumn("y", F.coalesce("daily_cost", F.lit(0)))
        .withColumn("cumulative_cost", running)
        .select(
            *TERM, "ds", "y", F.dayofweek("ds").alias("day_of_week"), F.month("ds").alias("month"), F.quarter("ds").alias("quarter"),
            "cumulative_cost", F.datediff("ds", "contract_start").alias("days_elapsed"),
            (F.col("contract_value") - F.col("cumulative_cost")).alias("remaining_budget"),
            F.col("daily_cost").isNotNull().cast("int").alias("has_actual_data"),
        )
    )


def forecast_feature_summary(features: DataFrame) -> DataFrame:
    """Coverage, spread and readiness per contract; the remaining budget is the latest one."""
    days, seen = F.count("*"), F.sum("has_actual_data")
    return features.groupBy("contract_id", "cloud_provider", "contract_start", "contract_end", "contract_value").agg(
        days.alias("total_days"), seen.alias("days_with_data"), rounded(ratio(seen * 100, days), 2).alias("data_coverage_pct"),
        F.min("ds").alias("first_data_date"), F.max("ds").alias("last_data_date"), F.round(F.sum("y"), 2).alias("total_spent"),
        rounded(ratio(F.sum("y"), days), 2).alias("avg_daily_cost"), rounded(F.stddev_samp(dbl("y")), 2).alias("stddev_daily_cost"),
        F.round(F.max("y"), 2).alias("max_daily_cost"), F.round(F.max("cumulative_cost"), 2).alias("current_cumulative"),
        rounded(ratio(F.max("cumulative_cost"), F.first("contract_value")) * 100, 2).alias("pct_consumed"),
        F.round(F.max_by("remaining_budget", "ds"), 2).alias("budget_remaining"),
        F.when(seen >= 30, "READY").when(seen >= 14, "LIMITED").otherwise("INSUFFICIENT").alias("readiness"),
    )


def readiness_counts(summary: DataFrame) -> DataFrame:
    count = lambda label: F.count_if(F.col("readiness") == label)
    return summary.agg(
        F.countDistinct("contract_id").alias("contracts_prepared"), count("READY").alias("ready_for_forecast"),
        count("LIMITED").alias("limited_data"), count("INSUFFICIENT").alias("insufficient_data"),
    )


def training_gate(series: DataFrame, min_days: int = MIN_TRAINING_DAYS) -> DataFrame:
    points = F.count("*")
    return series.groupBy("contract_id").agg(
        points.alias("training_points"), F.when(points >= min_days, "seasonal").otherwise("linear_fallback").alias("model_version")
    )


# --- models ------------------------------------------------------------------

def tenths(n: int) -> Column:
    return F.lit(n).cast("decimal(3,0)") / F.lit(10).cast("decimal(2,0)")


def _future(days: Column) -> Column:
    """Zero-based day offsets of a horizon; an empty array when there is none."""
    return F.when(days > 0, F.sequence(F.lit(0), (days - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def spent_so_far(burndown: DataFrame) -> DataFrame:
    costed = burndown.filter(F.col("daily_cost").isNotNull())
    return costed.groupBy("contract_id").agg(
        money(F.max("cumulative_cost")).alias("spent"), F.count("*").alias("history_rows"), F.max("usage_date").alias("last_date")
    )


def linear_forecast(burndown: DataFrame, contracts: DataFrame, buffer: int = FORECAST_BUFFER_DAYS, min_days: int = 30) -> DataFrame:
    """Flat mean per usage row with a 20 % band, to the contract end plus a buffer."""
    ends = contracts.filter(F.col("status") == "ACTIVE").select("contract_id", "end_date")
    horizon = F.greatest(F.datediff("end_date", "last_date") + buffer, F.lit(min_days))
    return (
        spent_so_far(burndown).join(ends, "contract_id")
        .withColumn("yhat", money(ratio(F.col("spent"), F.col("history_rows"))))
        .withColumn("i", F.explode(_future(horizon)))
        .select("contract_id", F.date_add("last_date", F.col("i") + 1).alias("ds"), "yhat",
                (F.col("yhat") * tenths(8)).alias("yhat_lower"), (F.col("yhat") * tenths(12)).alias("yhat_upper"))
    )


def trend_stats(daily: DataFrame, key: str, cost: str = "daily_cost", when: str = "usage_date") -> DataFrame:
    """Mean, sample deviation, total, days and slope per key.

    The slope is over the row number and is 0 for up to seven rows. The window
    holds one row per day of a key.
    """
    indexed = daily.withColumn("idx", F.row_number().over(W.partitionBy(key).orderBy(when)) - 1)
    y = dbl(cost)
    return indexed.groupBy(key).agg(
        F.avg(y).alias("daily_avg"), F.stddev_samp(y).alias("daily_std"), F.sum(y).alias("total"), F.count("*").alias("days"),
        F.when(F.count("*") > 7, F.regr_slope(y, dbl("idx"))).otherwise(F.lit(0.0)).alias("trend"), F.min(when).alias("first_day"),
    )


def trend_forecast(stats: DataFrame, key: str, as_of: date, horizon: Column | int) -> DataFrame:
    """Mean plus slope per day after ``as_of``; floored at 0, one deviation either side."""
    days = horizon if isinstance(horizon, Column) else F.lit(horizon)
    spread = F.coalesce("daily_std", F.lit(0.0))
    value = F.greatest(F.col("daily_avg") + F.col("trend") * F.col("i"), F.lit(0.0))
    return stats.withColumn("i", F.explode(_future(days))).select(
        key, F.date_add(day(as_of), F.col("i") + 1).alias("ds"), value.alias("yhat"),
        F.greatest(value - spread, F.lit(0.0)).alias("yhat_lower"), (value + spread).alias("yhat_upper"),
    )


def seasonal_fit(series: DataFrame, buffer: int = FORECAST_BUFFER_DAYS, cap: int = FORECAST_HORIZON_DAYS, z: float = 1.2816) -> DataFrame:
    """Seasonal values for history (``fitted``) and horizon of every contract: a line and multiplicative harmonics.

    ``series`` is ``(contract_id, ds, y, contract_end)``, one row per day; days after the
    end of the contract are not learned from. At most ``cap`` days are foreseen;
    ``forecast_output`` marks contracts that last longer as ``beyond_horizon``.
    """
    steps = F.least(F.greatest(F.datediff("contract_end", "last"), F.lit(0)) + buffer, F.lit(cap))
    return seasonal_values(series, steps, z)


def seasonal_forecast(series: DataFrame, **options) -> DataFrame:
    """Unclipped forecast rows; clipping happens after exhaustion dates are known."""
    return seasonal_fit(series, **options).filter(~F.col("fitted")).select(*FORECAST)


# --- exhaustion and output ---------------------------------------------------

EXHAUSTION = ["exhaustion_date_p10", "exhaustion_date_p50", "exhaustion_date_p90", "days_to_exhaustion"]


def with_exhaustion(forecast: DataFrame, remaining: DataFrame) -> DataFrame:
    """Forecast rows, what is left and spent, and the first day each cumulative path covers what is left.

    The upper path gives the early date (p10), the lower path the late one
    (p90). Nothing is dated when the budget is already spent. Windows of one contract
    do it in one pass; the forecast is not joined to itself.
    """
    own = W.partitionBy("contract_id")
    running = own.orderBy("ds").rowsBetween(*RUNNING)
    paths = forecast.join(remaining, "contract_id").withColumns({f"c_{name}": F.sum(name).over(running) for name in ("yhat", "yhat_upper", "yhat_lower")})
    open_budget = F.col("remaining") > 0
    first = lambda name: F.min(F.when(open_budget & (F.col(f"c_{name}") >= F.col("remaining")), F.col("ds"))).over(own)
    dated = paths.withColumns(dict(zip(EXHAUSTION, map(first, ("yhat_upper", "yhat", "yhat_lower")))) | {"first_ds": F.min("ds").over(own)})
    left = F.when(F.col("remaining") <= 0, F.lit(0)).otherwise(F.datediff("exhaustion_date_p50", "first_ds"))
    return dated.withColumn("days_to_exhaustion", left).drop("c_yhat", "c_yhat_upper", "c_yhat_lower", "first_ds")


def exhaustion_dates(forecast: DataFrame, remaining: DataFrame) -> DataFrame:
    return with_exhaustion(forecast, remaining).groupBy("contract_id").agg(*[F.first(c).alias(c) for c in EXHAUSTION])


def remaining_budget(burndown: DataFrame, contracts: DataFrame) -> DataFrame:
    values = contracts.filter(F.col("status") == "ACTIVE").select("contract_id", money("total_value").alias("value"), F.col("end_date").alias("contract_end"))
    return spent_so_far(burndown).join(values, "contract_id").select(
        "contract_id", "spent", (F.col("value") - F.col("spent")).alias("remaining"), "contract_end"
    )


def assemble_forecast(forecast: DataFrame, remaining: DataFrame, model: Column) -> DataFrame:
    """Attach exhaustion dates, clip at zero and accumulate onto the amount spent.

    ``beyond_horizon`` marks contracts that end after their last forecast day. Amounts
    that come as decimals are added up as decimals.
    """
    clip = lambda c: F.greatest(F.col(c), F.lit(0))
    window = W.partitionBy("contract_id").orderBy("forecast_date").rowsBetween(*RUNNING)
    last = F.max("ds").over(W.partitionBy("contract_id"))
    return (
        with_exhaustion(forecast, remaining)
        .select(
            "contract_id", F.col("ds").alias("forecast_date"), model.alias("model_version"),
            clip("yhat").alias("predicted_daily_cost"), clip("yhat_lower").alias("lower_bound"), clip("yhat_upper").alias("upper_bound"),
            *EXHAUSTION, (F.col("contract_end") > last).alias("beyond_horizon"), "spent",
        )
        .withColumn("predicted_cumulative", F.col("spent") + F.sum("predicted_daily_cost").over(window))
        .drop("spent")
        .withColumns({c: dbl(c) for c in ("predicted_daily_cost", "lower_bound", "upper_bound", "predicted_cumulative")})
    )


def linear_contract_forecast(burndown: DataFrame, contracts: DataFrame) -> DataFrame:
    """Complete forecast table with the flat model only."""
    return assemble_forecast(linear_forecast(burndown, contracts), remaining_budget(burndown, contracts), F.lit("linear_fallback"))


def forecast_output(burndown: DataFrame, contracts: DataFrame, series: DataFrame, min_days: int = MIN_TRAINING_DAYS) -> DataFrame:
    """Seasonal model where a contract has enough days, the flat model elsewhere."""
    gate = training_gate(series, min_days)
    seasonal_ids = gate.filter(F.col("model_version") == "seasonal").select("contract_id")
    remaining = remaining_budget(burndown, contracts)
    seasonal = assemble_forecast(
        seasonal_forecast(series.join(seasonal_ids, "contract_id", "left_semi")), remaining, F.lit("seasonal")
    )
    flat = assemble_forecast(
        linear_forecast(burndown, contracts).join(seasonal_ids, "contract_id", "left_anti"), remaining, F.lit("linear_fallback")
    )
    return seasonal.unionByName(flat)


# --- model quality -----------------------------------------------------------

def fit_metrics(actual: DataFrame, fitted: DataFrame) -> DataFrame:
    """MAPE over positive actuals, RMSE and MAE per contract."""
    y, yhat = dbl("y"), F.col("yhat")
    error = y - yhat
    return actual.select("contract_id", "ds", "y").join(fitted.select("contract_id", "ds", "yhat"), ["contract_id", "ds"]).groupBy("contract_id").agg(
        F.count("*").alias("training_points"), F.min("ds").alias("training_start_date"), F.max("ds").alias("training_end_date"),
        (F.avg(F.when(y > 0, F.abs(error) / F.nullif(y, F.lit(0.0)))) * 100).alias("mape"),
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
    )


def model_metrics_table(existing: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Registry with the new rows appended; only the latest model of a contract is active."""
    rows = fresh if existing is None else existing.drop("is_active").unionByName(fresh)
    latest = F.row_number().over(W.partitionBy("contract_id").orderBy(F.desc("trained_at"), F.desc("model_id")))
    return rows.withColumn("is_active", latest == 1)


def graded_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("grade", mape_grade(F.col("mape")))


# --- views over the forecast table -------------------------------------------

def forecast_latest(forecast: DataFrame) -> DataFrame:
    last = F.max("forecast_date").over(W.partitionBy("contract_id"))
    return forecast.withColumn("last", last).filter(F.col("forecast_date") == F.col("last")).drop("last")


def forecast_details(forecast: DataFrame, contracts: DataFrame) -> DataFrame:
    """Forecast rows with their contract and its risk.

    A contract that lasts longer than its forecast, and is not dated in it, is neither
    at risk nor on track: nothing is known about its last days.
    """
    terms = contracts.filter(F.col("status") == "ACTIVE").select(
        "contract_id", "cloud_provider", F.col("start_date").alias("contract_start"), F.col("end_date").alias("contract_end"),
        F.col("total_value").alias("contract_value"),
    )
    unknown = F.col("beyond_horizon") & F.col("exhaustion_date_p90").isNull() & (F.coalesce("days_to_exhaustion", F.lit(1)) != 0)
    status = (
        F.when(F.col("exhaustion_date_p50") < F.col("contract_end"), "AT RISK")
        .when(F.col("exhaustion_date_p90") < F.col("contract_end"), "WATCH")
        .when(unknown, "BEYOND HORIZON")
        .otherwise("ON TRACK")
    )
    return forecast.join(terms, "contract_id").withColumn("forecast_status", status)


def forecast_summary(forecast: DataFrame, contracts: DataFrame) -> DataFrame:
    values = contracts.select("contract_id", F.col("total_value").alias("contract_value"))
    return forecast.join(values, "contract_id").groupBy("contract_id", "contract_value").agg(
        F.max("forecast_date").alias("forecast_through"), F.max("exhaustion_date_p10").alias("exhaustion_optimistic"),
        F.max("exhaustion_date_p50").alias("exhaustion_median"), F.max("exhaustion_date_p90").alias("exhaustion_conservative"),
        F.max("days_to_exhaustion").alias("days_to_exhaustion"), F.max("model_version").alias("model_type"),
    )


def cumulative_band(forecast: DataFrame, burndown: DataFrame) -> DataFrame:
    window = W.partitionBy("contract_id").orderBy("forecast_date").rowsBetween(*RUNNING)
    return forecast.join(spent_so_far(burndown).select("contract_id", "spent"), "contract_id").select(
        "contract_id", "forecast_date", "predicted_cumulative",
        (dbl("spent") + F.sum("lower_bound").over(window)).alias("cumulative_lower"),
        (dbl("spent") + F.sum("upper_bound").over(window)).alias("cumulative_upper"),
    )


def projection_30_365(dashboard: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    daily = dashboard.filter(since(as_of, days)).groupBy("usage_date").agg(F.sum("actual_cost").alias("cost"))
    mean = ratio(F.sum("cost"), F.count("cost"))
    return daily.agg(
        rounded(mean, 2).alias("avg_daily_cost"), rounded(mean * 30, 2).alias("projected_30_day_cost"),
        rounded(mean * 365, 2).alias("projected_annual_cost"),
    )


def annual_forecast(forecast: DataFrame, as_of: date, years: int = 1) -> DataFrame:
    """Mean prediction over the next year, annualised, and the band over ``years``."""
    first, last = day(as_of), F.date_add(day(as_of), 365 * years)
    rows = forecast.filter((F.col("forecast_date") >= first) & (F.col("forecast_date") < last))
    yearly = lambda c: F.sum(c) * 365.0 / F.count("*") * years
    return rows.groupBy("contract_id").agg(
        F.avg("predicted_daily_cost").alias("avg_daily_forecast"), (F.avg("predicted_daily_cost") * 365).alias("annual_forecast"),
        yearly("predicted_daily_cost").alias("median"), yearly("lower_bound").alias("optimistic"), yearly("upper_bound").alias("conservative"),
    )


def seasonal_factors(forecast: DataFrame) -> DataFrame:
    """Month mean against a twelfth of the sum of month means (window over ≤ 12 rows)."""
    monthly = forecast.groupBy(F.month("forecast_date").alias("month")).agg(F.avg("predicted_daily_cost").alias("mean"))
    return monthly.select("month", (F.col("mean") / (F.sum("mean").over(W.partitionBy()) / 12)).alias("seasonal_factor"))
