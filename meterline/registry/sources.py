"""Loader and sink queries. Sinks are written to the session folder and read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from meterline.operators import reports
from meterline.registry.base import AS_OF, Query, ago, last, num, r, sql
from meterline.sources import readers, writers
from meterline.registry.star import Star, star_prices, star_usage

CONTRACT = "contract_id, account_id, cloud_provider, start_date, end_date, CAST(total_value AS DOUBLE) AS total_value, status"
DAY_TOTALS = f"SELECT usage_date, cloud_provider, workspace_id, CAST(SUM(usage_quantity) AS DOUBLE) AS total_dbu, {r('SUM(actual_cost)', 6)} AS total_cost, COUNT(DISTINCT sku_name) AS unique_skus FROM dashboard GROUP BY ALL"


def _fresh(s: Star, name: str) -> str:
    """A path of its own for every write; nothing is overwritten."""
    return s.folder(f"sinks/{name}-{uuid4().hex}")


def _usage(s: Star):
    path = _fresh(s, "usage")
    star_usage(s.spark, s.sf_dir).write.parquet(path)
    feed = readers.load_usage(s.spark, path)
    return feed.select("account_id", "workspace_id", "sku_name", "cloud", "usage_date", "usage_unit", "usage_quantity", "record_type",
                       F.col("usage_metadata.job_id").alias("job_id"), F.col("identity_metadata.run_as").alias("run_as"), F.col("custom_tags")["priority"].alias("priority"))


def _prices(s: Star):
    path = _fresh(s, "prices")
    star_prices(s.spark, s.sf_dir).write.parquet(path)
    return readers.load_list_prices(s.spark, path).select(
        "sku_name", "cloud", "usage_unit", F.to_date("price_start_time").alias("valid_from"), F.to_date("price_end_time").alias("valid_to"), "default_price", "effective_price"
    )


def _contract_columns(df):
    return df.select("contract_id", "account_id", "cloud_provider", "start_date", "end_date", "total_value", "status")


def _dimensions(s: Star):
    """Two configuration sets; the second one's account metadata is ignored."""
    first, second = s.contracts.filter("contract_id < 'C008'"), s.contracts.filter("contract_id >= 'C008'").drop("notes")
    accounts, contracts = readers.load_dimensions([(s.accounts, first), (s.accounts.limit(0), second)])
    return _contract_columns(contracts).join(accounts.select("account_id", "customer_name"), "account_id", "left")


def _auto(s: Star):
    odd = F.pmod(F.substring("contract_id", 4, 1).cast("int"), F.lit(2)) == 1
    text = lambda c: F.when(odd, "auto").otherwise(F.col(c).cast("string"))
    written = _contract_columns(s.contracts).withColumns({c: text(c) for c in ("account_id", "cloud_provider", "start_date", "end_date")})
    return readers.resolve_auto_values(written, s.usage, s.as_of)


def _partitioned(s: Star):
    path = _fresh(s, "daily_summary")
    writers.write_partitioned(reports.daily_summary(s.dashboard), path)
    return s.spark.read.parquet(path)


def _appended(s: Star):
    path = _fresh(s, "forecast")
    writers.append_results(s.forecast.filter("contract_id < 'C008'"), path)
    writers.append_results(s.forecast.filter("contract_id >= 'C008'"), path)
    return s.spark.read.parquet(path).select("contract_id", "forecast_date", "predicted_daily_cost", "predicted_cumulative")


def _csv(s: Star):
    path = _fresh(s, "contracts-csv")
    writers.export_csv(_contract_columns(s.contracts), path)
    schema = "contract_id string, account_id string, cloud_provider string, start_date date, end_date date, total_value decimal(18,2), status string"
    return s.spark.read.option("header", True).schema(schema).csv(path)


def _restored(s: Star):
    table = _fresh(s, "contracts")
    copy = writers.snapshot(s.contracts, table, s.as_of.strftime("%Y%m%d"))
    s.contracts.filter("status = 'ACTIVE'").write.parquet(table)
    return _contract_columns(writers.restore(s.spark, copy, table))


TOP = f"(SELECT account_id AS a, cloud AS c FROM usage WHERE {last(365)} GROUP BY account_id, cloud ORDER BY SUM(usage_quantity) DESC, account_id, cloud LIMIT 1)"
ODD = "CAST(substr(contract_id, 4, 1) AS INT) % 2 = 1"

QUERIES = [
    Query("load_usage", _usage, sql("usage", f"SELECT account_id, workspace_id, sku_name, cloud, usage_date, usage_unit, {num('usage_quantity')}, record_type, job_id, run_as, priority FROM usage")),
    Query("load_list_prices", _prices, sql(
        "prices", f"SELECT sku_name, cloud, usage_unit, CAST(price_start_time AS DATE) AS valid_from, CAST(price_end_time AS DATE) AS valid_to, {num('default_price effective_price')} FROM prices")),
    Query("load_dimensions", _dimensions, sql(
        "contracts accounts", f"SELECT c.*, a.customer_name FROM (SELECT {CONTRACT} FROM contracts) c LEFT JOIN accounts a ON a.account_id = c.account_id")),
    Query("resolve_auto_values", _auto, sql(
        "contracts usage", f"""SELECT contract_id, CASE WHEN {ODD} THEN t.a ELSE account_id END AS account_id, CASE WHEN {ODD} THEN t.c ELSE cloud_provider END AS cloud_provider,
 CASE WHEN {ODD} THEN {ago(365)} ELSE start_date END AS start_date, CASE WHEN {ODD} THEN {AS_OF} + 365 ELSE end_date END AS end_date, CAST(total_value AS DOUBLE) AS total_value, status FROM contracts CROSS JOIN {TOP} t""")),
    Query("write_partitioned", _partitioned, sql("dashboard", DAY_TOTALS), 6),
    Query("append_results", _appended, sql("forecast", f"SELECT contract_id, forecast_date, {num('predicted_daily_cost predicted_cumulative')} FROM forecast")),
    Query("export_csv", _csv, sql("contracts", f"SELECT {CONTRACT} FROM contracts")),
    Query("snapshot_restore", _restored, sql("contracts", f"SELECT {CONTRACT} FROM contracts")),
]
