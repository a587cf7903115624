"""Freshness, validation and completeness checks, each a frame of check rows."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.functions.columns import before, day, dbl, freshness_status, ratio, rounded, since
from meterline.operators.contracts import contract_costs
from meterline.operators.cost import price_interval_join

RUNNING = (W.unboundedPreceding, W.currentRow)


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def freshness(usage: DataFrame, as_of: date, ok: int = 2, warning: int = 5) -> DataFrame:
    latest = usage.filter((F.col("record_type") == "ORIGINAL") & (F.col("usage_date") <= day(as_of))).agg(F.max("usage_date").alias("latest_date"))
    behind = F.datediff(day(as_of), "latest_date")
    status = freshness_status(behind, ok, warning)
    message = (
        F.when(status == "CRITICAL", "Data is more than 5 days old").when(status == "WARNING", "Data is 3-5 days old").otherwise("Data is fresh")
    )
    return latest.select(F.lit("usage").alias("table_name"), "latest_date", behind.alias("days_behind"), status.alias("status"), message.alias("message"))


def freshness_pair(usage: DataFrame, as_of: date, ok: int = 2) -> DataFrame:
    """The consumption and the metrics row; both read the same feed, so it is scanned once."""
    latest = usage.filter(F.col("usage_date") <= day(as_of)).agg(F.max("usage_date").alias("latest_date"))
    verified = F.when(F.datediff(day(as_of), "latest_date") <= ok, "True").otherwise("False")
    return latest.select(F.explode(F.array(F.lit("Consumption"), F.lit("Metrics"))).alias("source"), "latest_date", verified.alias("verified"))


def table_freshness(burndown: DataFrame, forecast_made: DataFrame, scenarios_made: DataFrame, as_of: date) -> DataFrame:
    """Staleness of the three result tables. The last two frames hold one ``made_on`` column."""
    def row(df: DataFrame, column: str, name: str, status) -> DataFrame:
        behind = F.datediff(day(as_of), F.max(column))
        return df.agg(F.max(column).alias("latest_data"), behind.alias("days_stale"), status(behind).alias("status")).select(
            F.lit(name).alias("table_name"), "latest_data", "days_stale", "status"
        )

    return _stack([
        row(burndown, "usage_date", "contract_burndown", lambda b: freshness_status(b)),
        row(forecast_made, "made_on", "contract_forecast",
            lambda b: F.when(b <= 7, "OK").when(b <= 14, "WARNING").otherwise("CRITICAL - Retrain needed")),
        row(scenarios_made, "made_on", "scenario_summary", lambda b: F.when(b <= 7, "OK").otherwise("WARNING - Re-run What-If")),
    ])


def missing_days(df: DataFrame, date_col: str, start: date, end: date) -> DataFrame:
    """Calendar days of ``[start, end]`` that have no row."""
    spark = df.sparkSession
    expected = spark.range(1).select(F.explode(F.sequence(day(start), day(end))).alias("missing_date"))
    present = df.filter(F.col(date_col).between(day(start), day(end))).select(F.col(date_col).alias("missing_date")).distinct()
    return expected.join(present, "missing_date", "left_anti")


def cumulative_consistency(burndown: DataFrame, tolerance: float = 0.01, k: int | None = None) -> DataFrame:
    """All rows whose stored running total is off from a recomputed one, or the ``k`` largest gaps."""
    window = W.partitionBy("contract_id").orderBy("usage_date").rowsBetween(*RUNNING)
    gap = F.abs(F.col("cumulative_cost") - F.col("calculated_cumulative"))
    off = (
        burndown.select("contract_id", "usage_date", "daily_cost", "cumulative_cost", F.sum("daily_cost").over(window).alias("calculated_cumulative"))
        .withColumn("discrepancy", gap).filter(F.col("discrepancy") > tolerance)
    )
    return off if k is None else off.orderBy(F.desc("discrepancy"), "contract_id", "usage_date").limit(k)


def burndown_coverage(burndown: DataFrame, contracts: DataFrame, dashboard: DataFrame) -> DataFrame:
    span = [
        F.count("*").alias("total_data_points"), F.min("usage_date").alias("earliest_date"), F.max("usage_date").alias("latest_date"),
        F.datediff(F.max("usage_date"), F.min("usage_date")).alias("days_of_data"),
    ]
    idle = contracts.filter(F.col("status") == "ACTIVE").join(burndown.select("contract_id"), "contract_id", "left_anti")
    return _stack([
        burndown.agg(F.countDistinct("contract_id").alias("contract_count"), *span).withColumn("check_type", F.lit("Contract Coverage")),
        idle.agg(F.count("*").alias("contract_count")).withColumn("check_type", F.lit("Contracts Without Data")),
        dashboard.agg(F.countDistinct("account_id").alias("contract_count"), *span).withColumn("check_type", F.lit("Dashboard Data")),
    ])


def validate_contracts(contracts: DataFrame, accounts: DataFrame) -> DataFrame:
    """(check, count) rows: orphans, date order, duplicate ids, missing fields."""
    def row(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("issues")).select(F.lit(name).alias("check_name"), "issues", (F.col("issues") == 0).alias("passed"))

    missing = F.col("customer_name").isNull() | F.col("account_executive").isNull() | F.col("solutions_architect").isNull()
    return _stack([
        row("contracts_without_metadata", contracts.join(accounts, "account_id", "left_anti")),
        row("invalid_date_range", contracts.filter(F.col("end_date") <= F.col("start_date"))),
        row("duplicate_contract_id", contracts.groupBy("contract_id").count().filter("count > 1")),
        row("missing_required_fields", accounts.filter(missing)),
    ])


def install_report(contracts: DataFrame, accounts: DataFrame, dashboard: DataFrame, burndown: DataFrame, forecast: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Rows, distinct entities and date range of every table, and two readiness checks."""
    def row(name: str, df: DataFrame, distinct: str | None = None, dated: str | None = None, status: Column | None = None) -> DataFrame:
        return df.agg(
            F.count("*").alias("total_rows"),
            (F.countDistinct(distinct) if distinct else F.lit(None).cast("long")).alias("distinct_entities"),
            (F.min(dated) if dated else F.lit(None).cast("date")).alias("earliest_date"),
            (F.max(dated) if dated else F.lit(None).cast("date")).alias("latest_date"),
            (status if status is not None else F.when(F.count("*") > 0, "OK").otherwise("EMPTY")).alias("status"),
        ).select(F.lit(name).alias("table_name"), "total_rows", "distinct_entities", "earliest_date", "latest_date", "status")

    model = (
        F.when(F.max("model_version") == "seasonal", "OK - Seasonal model active")
        .when(F.max("model_version") == "linear_fallback", "WARNING - Using linear fallback").otherwise("UNKNOWN")
    )
    ready = F.when(F.count("*") > 0, "OK - Recommendations generated").otherwise("WARNING - No recommendations available")
    return _stack([
        row("contracts", contracts, "contract_id"), row("account_metadata", accounts, "account_id"),
        row("dashboard_data", dashboard, "usage_date", "usage_date"), row("contract_burndown", burndown, "contract_id", "usage_date"),
        row("contract_forecast", forecast, "contract_id", "forecast_date", model),
        row("auto_commit_recommendations", recommendations, "account_id", None, ready),
    ])


def validation_suite(usage: DataFrame, accounts: DataFrame, contracts: DataFrame, dashboard: DataFrame, as_of: date) -> DataFrame:
    """Pass/fail per data check, from one pass over each table.

    The daily summary has a row for each date, workspace and cloud, which is the grain
    the dashboard is first rolled up to.
    """
    some = lambda m: m > 0
    count = F.count("*")

    def rows(df: DataFrame, checks: dict) -> DataFrame:
        one = df.agg(*[measure.cast("double").alias(name) for name, (measure, _) in checks.items()])
        cells = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("measure"), F.coalesce(ok(F.col(n)), F.lit(False)).alias("passed")) for n, (_, ok) in checks.items()])
        return one.select(F.explode(cells).alias("c")).select("c.*")

    yesterday = F.col("usage_date") == before(as_of, 1)
    grain = dashboard.groupBy("usage_date", "workspace_id", "cloud_provider").agg(count.alias("n"), F.sum("actual_cost").alias("cost"))
    original = F.when(F.col("record_type") == "ORIGINAL", F.col("usage_date"))
    return _stack([
        rows(usage.filter(F.col("usage_date") <= day(as_of)), {
            "usage_last_7_days": (F.count_if(since(as_of, 7)), some), "data_freshness": (F.datediff(day(as_of), F.max(original)), lambda m: m <= 5),
        }),
        rows(grain, {
            "cost_calculation": (F.count_distinct(F.when(yesterday, F.col("cloud_provider"))), some), "dashboard_data": (F.sum("n"), some), "daily_summary": (count, some),
            "yesterday_cost": (F.round(F.sum(F.when(yesterday, F.col("cost"))), 2), lambda m: m.isNotNull()),
        }),
        rows(accounts, {"account_metadata": (count, some)}),
        rows(contracts, {"contracts": (count, some), "contract_consumption": (F.count_if(F.col("status") == "ACTIVE"), some)}),
    ])


def unpriced_skus(usage: DataFrame, prices: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """SKUs that no price row matches.

    Whether a SKU has a price does not depend on the record, so usage is
    counted first and each SKU and cloud is looked up once.
    """
    counts = usage.filter(since(as_of, days)).groupBy("sku_name", "cloud").agg(F.count("*").alias("records"))
    priced = prices.select("sku_name", "cloud").distinct().withColumn("hit", F.lit(1))
    return (
        counts.join(priced, ["sku_name", "cloud"], "left").groupBy("sku_name")
        .agg(F.sum("records").alias("usage_records"), F.count("hit").alias("matched")).filter("matched = 0").select("sku_name", "usage_records")
    )


def unpriced_records(usage: DataFrame, prices: DataFrame, as_of: date) -> DataFrame:
    """Per SKU, the records outside every price interval."""
    rows = price_interval_join(usage.filter(F.col("usage_date") <= day(as_of)), prices)
    return rows.groupBy("sku_name").agg(F.count("*").alias("usage_records"), F.count_if(F.col("effective_price").isNull()).alias("unpriced_records"))


def list_cost_coverage(dashboard: DataFrame) -> DataFrame:
    share = lambda c: rounded(ratio(F.count(c) * 100, F.count("*")), 2)
    return dashboard.agg(
        F.count("*").alias("total_records"), F.count("list_cost").alias("with_list_cost"), F.count("actual_cost").alias("with_actual_cost"),
        share("list_cost").alias("list_cost_coverage_pct"), share("actual_cost").alias("actual_cost_coverage_pct"),
    )


def row_counts(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Rows and date range per named table; the date column may be None."""
    def row(name: str, df: DataFrame, column: str | None) -> DataFrame:
        low, high = (F.min(column), F.max(column)) if column else (F.lit(None), F.lit(None))
        return df.agg(F.count("*").alias("row_count"), low.cast("date").alias("min_date"), high.cast("date").alias("max_date")).select(
            F.lit(name).alias("table_name"), "row_count", "min_date", "max_date"
        )

    return _stack([row(name, df, column) for name, (df, column) in tables.items()])


def price_join_check(usage: DataFrame, prices: DataFrame, as_of: date) -> DataFrame:
    """Prices found for one day's records, with the number of records."""
    rows = usage.filter((F.col("usage_date") == before(as_of, 1)) & (F.col("record_type") == "ORIGINAL"))
    return price_interval_join(rows, prices).groupBy("sku_name", "usage_unit", "default_price", "effective_price").agg(F.count("*").alias("record_count"))


def data_availability(usage: DataFrame) -> DataFrame:
    return usage.agg(
        F.min("usage_date").alias("first_date"), F.max("usage_date").alias("last_date"),
        F.datediff(F.max("usage_date"), F.min("usage_date")).alias("total_days"),
    )


def stale_metadata(accounts: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    return accounts.filter(F.col("updated_at") < before(as_of, days)).select(
        "account_id", "customer_name", "account_executive", "solutions_architect", "updated_at"
    )


def days_per_contract(burndown: DataFrame) -> DataFrame:
    return burndown.groupBy("contract_id").agg(F.countDistinct("usage_date").alias("days"))


def price_catalog_stats(prices: DataFrame) -> DataFrame:
    return prices.agg(F.count("*").alias("price_count"), F.countDistinct("sku_name").alias("unique_skus"))


def price_overlap_check(prices: DataFrame) -> DataFrame:
    """Price rows that start before an earlier one of their key has ended; each would double costs.

    Compared with the latest end among all earlier rows, an open end being the latest of
    all, so a row inside a long interval is found however many rows lie between.
    """
    key = ["sku_name", "cloud", "usage_unit"] + (["account_id"] if "account_id" in prices.columns else [])
    earlier = W.partitionBy(*key).orderBy("price_start_time", F.asc_nulls_last("price_end_time")).rowsBetween(W.unboundedPreceding, -1)
    opened = F.coalesce(F.max(F.col("price_end_time").isNull()).over(earlier), F.lit(False))
    reach = F.max("price_end_time").over(earlier)
    return prices.withColumns({"earlier_end": F.when(~opened, reach), "_open": opened}).filter(
        F.col("_open") | (F.col("price_start_time") < F.col("earlier_end"))
    ).select("sku_name", "cloud", "usage_unit", "price_start_time", "price_end_time", "earlier_end")
