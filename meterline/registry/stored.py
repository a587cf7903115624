"""Stored tables, the refreshed burndown and the stream of corrections.

Each query goes the long way, by late rows, retried batches, restarts and restored
snapshots, and is compared with the statement of the plain operator.
"""

from __future__ import annotations

from datetime import date, timedelta
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.columns import month_of
from meterline.operators import upkeep as u
from meterline.plans.burndown import BurndownStore
from meterline.plans.daily_checks import DayChecks, checks
from meterline.registry import contracts, cost, quality, sources
from meterline.registry.base import AS_OF, Query, ago, days, last, num, r, ratio, rd, sql
from meterline.registry.cost import JOIN
from meterline.registry.star import Star
from meterline.sources.stored_table import StoredTable, bucket
from meterline.streaming.corrections import net_corrections_stream, net_of, net_table

DIMS = ["account_id", "workspace_id", "sku_name", "usage_date"]


def _folder(s: Star, name: str) -> str:
    return s.folder(f"stored/{name}-{uuid4().hex}")


def _statement(module, name: str) -> str:
    return next(q.sql for q in module.QUERIES if q.name == name)


def _late(df: DataFrame) -> F.Column:
    """A tenth of the rows of the last months reach the feed after the first refresh."""
    return (F.col("usage_date") >= "2001-03-01") & (F.pmod(F.xxhash64("workspace_id", "sku_name", "usage_date"), F.lit(10)) == 0)


def _refreshed(s: Star) -> DataFrame:
    costs = s.keep("costs", lambda: s.long_history.select("account_id", "cloud_provider", "workspace_id", "sku_name", "usage_date", "actual_cost"))
    store = BurndownStore(s.spark, _folder(s, "burndown"))
    store.add_costs(costs.filter(~_late(costs)), "on time")
    store.refresh(s.contracts.filter("contract_id <> 'C003'"), s.as_of - timedelta(days=20))
    store.add_costs(costs.filter(_late(costs)), "late")
    store.add_costs(costs.filter(_late(costs)), "late")
    store.refresh(s.contracts, s.as_of)
    return store.read()


def _streamed(s: Star) -> DataFrame:
    folder = _folder(s, "corrections")
    s.usage.select(*DIMS, "usage_quantity").repartition(6).write.parquet(f"{folder}/in")
    table = net_table(s.spark, f"{folder}/net")
    for _ in range(2):  # the second run finds nothing new
        feed = s.spark.readStream.schema(s.usage.select(*DIMS, "usage_quantity").schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        net_corrections_stream(feed, table, DIMS, f"{folder}/checkpoint", buckets=8).awaitTermination()
    return net_of(table)


def _upserted(s: Star) -> DataFrame:
    bucketed = lambda df: df.withColumn("bucket", bucket(["contract_id"], 8))
    table = StoredTable(s.spark, _folder(s, "contracts"), "bucket")
    table.replace(bucketed(quality._contracts(s)))
    for _ in range(2):
        u.upsert_stored(table, bucketed(quality._new_contracts(s)), ["contract_id"], batch="changed contracts")
    return table.read().drop("bucket")


def _merged(s: Star) -> DataFrame:
    rows = s.scenario_burndown.select("scenario_id", "usage_date", "simulated_daily_cost", "simulated_cumulative").withColumn("month", month_of("usage_date"))
    table = StoredTable(s.spark, _folder(s, "scenarios"), "month")
    old = F.col("usage_date") <= F.lit(s.as_of - timedelta(days=60))
    table.replace(rows.filter(old))
    u.upsert_stored(table, rows.filter(~old).withColumn("simulated_daily_cost", -F.col("simulated_daily_cost")), ["scenario_id", "usage_date"])
    return table.read().drop("month")


def _ledger(s: Star) -> DataFrame:
    rows = s.forecast.select("contract_id", "forecast_date", "predicted_daily_cost", "predicted_cumulative").withColumn("month", month_of("forecast_date"))
    table = StoredTable(s.spark, _folder(s, "forecast"), "month")
    for batch, half in (("a", rows.filter("contract_id < 'C008'")), ("b", rows.filter("contract_id >= 'C008'"))):
        table.append(half, batch)
        table.append(half, batch)
    return table.read().drop("month")


def _restored(s: Star) -> DataFrame:
    rows = sources._contract_columns(s.contracts).withColumn("bucket", bucket(["contract_id"], 8))
    table = StoredTable(s.spark, _folder(s, "contracts"), "bucket")
    table.replace(rows)
    table.snapshot("before")
    table.replace(rows.filter("status = 'ACTIVE'"))
    table.restore("before")
    return table.read().drop("bucket")


def _checked(s: Star) -> DataFrame:
    """All days at first, with the last ten still incomplete; then those ten again, as a daily run would."""
    store, middle = DayChecks(s.spark, _folder(s, "checks")), s.as_of - timedelta(days=10)
    store.refresh(s.usage.filter((F.col("usage_date") < F.lit(middle)) | (F.length("sku_name") % 2 == 0)), s.prices, date(2000, 1, 1), s.as_of)
    store.refresh(s.usage, s.prices, middle, s.as_of)
    return checks(store.read(), s.as_of)


CHECKS = "\nUNION ALL\n".join(f"""SELECT CAST({w} AS BIGINT) AS window_days, COUNT(*) AS total_records, MIN(u.usage_date) AS first_date, MAX(u.usage_date) AS last_date, COUNT(DISTINCT u.usage_date) AS days_with_data,
 MAX(u.usage_date) FILTER (u.record_type = 'ORIGINAL') AS latest_original, {days("MAX(u.usage_date) FILTER (u.record_type = 'ORIGINAL')", AS_OF)} AS days_behind,
 CASE WHEN {days("MAX(u.usage_date) FILTER (u.record_type = 'ORIGINAL')", AS_OF)} <= 2 THEN 'OK' WHEN {days("MAX(u.usage_date) FILTER (u.record_type = 'ORIGINAL')", AS_OF)} <= 5 THEN 'WARNING' ELSE 'CRITICAL' END AS status,
 {rd(ratio("100 * COUNT(p.effective_price) FILTER (u.record_type = 'ORIGINAL')", "COUNT(*) FILTER (u.record_type = 'ORIGINAL')"))} AS price_coverage_pct,
 COUNT(*) FILTER (u.record_type = 'ORIGINAL' AND (u.usage_quantity <= 0 OR u.usage_quantity * p.effective_price <= 0)) AS non_positive,
 {r("SUM(u.usage_quantity) FILTER (u.record_type = 'ORIGINAL')")} AS total_dbu, {r("SUM(u.usage_quantity * p.effective_price) FILTER (u.record_type = 'ORIGINAL')")} AS total_cost,
 {w} + 1 - COUNT(DISTINCT u.usage_date) AS missing_days FROM usage u {JOIN} WHERE {last(w, 'u.usage_date')}""" for w in (7, 30, 365))

QUERIES = [
    Query("burndown_refresh", _refreshed, _statement(contracts, "contract_burndown")),
    Query("net_corrections_stream", _streamed, _statement(cost, "net_corrections")),
    Query("upsert_stored", _upserted, f"SELECT * EXCLUDE (_action) FROM ({_statement(quality, 'upsert')})"),
    Query("merge_scenarios_stored", _merged, sql(
        "all_sb", f"SELECT scenario_id, usage_date, {num('simulated_cumulative', 7)}, CASE WHEN usage_date <= {ago(60)} THEN 1 ELSE -1 END * CAST(ROUND(CAST(simulated_daily_cost AS DECIMAL(30,10)), 7) AS DOUBLE) AS simulated_daily_cost FROM all_sb"), 7),
    Query("append_once", _ledger, _statement(sources, "append_results")),
    Query("daily_checks", _checked, sql("usage prices", CHECKS)),
    Query("snapshot_manifest", _restored, _statement(sources, "snapshot_restore")),
]
