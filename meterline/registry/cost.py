"""Cost enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.operators import cost
from meterline.operators.cost import ACCOUNT_COLUMNS
from meterline.registry.base import AS_OF, Query, ago, last, num, r, ratio, rd, sql
from meterline.registry.star import Star

ROW = ["usage_date", "account_id", "workspace_id", "cloud", "sku_name", "usage_unit", "usage_quantity"]
ENRICHED = (
    "usage_date account_id customer_name business_unit_l0 business_unit_l1 business_unit_l2 business_unit_l3 account_executive "
    "solutions_architect workspace_id cloud_provider sku_name usage_unit product_category job_id job_name warehouse_id cluster_id run_as"
).split()
JOIN = """LEFT JOIN prices p ON p.sku_name = u.sku_name AND p.cloud = u.cloud AND p.usage_unit = u.usage_unit
 AND u.usage_end_time >= p.price_start_time AND (p.price_end_time IS NULL OR u.usage_end_time < p.price_end_time)"""
DAY_JOIN = """LEFT JOIN prices p ON p.sku_name = u.sku_name AND p.cloud = u.cloud AND u.usage_date >= CAST(p.price_start_time AS DATE)
 AND (p.price_end_time IS NULL OR u.usage_date < CAST(p.price_end_time AS DATE))"""


def _priced(s: Star):
    return cost.price_interval_join(s.usage, s.prices)


def _row_ids() -> str:
    return ", ".join(f"u.{c}" for c in ROW[:-1]) + ", CAST(u.usage_quantity AS DOUBLE) AS usage_quantity"


def _metadata(s: Star):
    flat = cost.flatten_metadata(s.usage)
    return flat.select(*ROW, "job_id", "job_name", "warehouse_id", "cluster_id", "run_as", F.col("custom_tags")["priority"].alias("priority"))


def _dashboard(s: Star):
    tags = F.col("custom_tags")["priority"].alias("priority")
    return s.dashboard.select(*ENRICHED, "usage_quantity", "price_per_unit", "list_cost", "actual_cost", tags)


def _discounts(s: Star):
    totals = s.dashboard.groupBy("account_id", "cloud_provider").agg(F.sum("list_cost").alias("list_cost"), F.sum("actual_cost").alias("actual_cost"))
    return cost.effective_discount(totals)


def _estimated(s: Star):
    rows = cost.estimated_list_cost(s.long_history)
    return rows.groupBy("account_id", "product_category").agg(
        F.round(F.sum("estimated_list_cost"), 2).alias("estimated_list_cost"), F.round(F.sum("list_cost"), 2).alias("list_cost"), F.count("*").alias("records")
    )


QUERIES = [
    Query("price_interval_join", lambda s: _priced(s).select(*ROW, "default_price", "effective_price"), sql(
        "usage prices", f"SELECT {_row_ids()}, CAST(p.default_price AS DOUBLE) AS default_price, CAST(p.effective_price AS DOUBLE) AS effective_price FROM usage u {JOIN}")),
    Query("price_index_join", lambda s: cost.price_interval_join(s.usage, s.prices, index_months=6).select(*ROW, "default_price", "effective_price"), sql(
        "usage prices", f"SELECT {_row_ids()}, CAST(p.default_price AS DOUBLE) AS default_price, CAST(p.effective_price AS DOUBLE) AS effective_price FROM usage u {JOIN}")),
    Query("cost_columns", lambda s: cost.cost_columns(_priced(s)).select(*ROW, "price_per_unit", "list_cost", "actual_cost"), sql(
        "usage prices", f"SELECT {_row_ids()}, CAST(p.effective_price AS DOUBLE) AS price_per_unit, "
        f"{r('u.usage_quantity * p.default_price', 6)} AS list_cost, {r('u.usage_quantity * p.effective_price', 6)} AS actual_cost FROM usage u {JOIN}"), 6),
    Query("product_category", lambda s: cost.with_product_category(s.usage).groupBy("sku_name", "product_category").agg(F.count("*").alias("records")), sql(
        "usage", """SELECT sku_name, COUNT(*) AS records, CASE
 WHEN sku_name LIKE '%ALL\\_PURPOSE%' ESCAPE '\\' THEN 'All Purpose Compute' WHEN sku_name LIKE '%JOBS%' THEN 'Jobs Compute'
 WHEN sku_name LIKE '%DLT%' OR sku_name LIKE '%DELTA\\_LIVE\\_TABLES%' ESCAPE '\\' THEN 'Delta Live Tables' WHEN sku_name LIKE '%SQL%' THEN 'SQL Warehouse'
 WHEN sku_name LIKE '%INFERENCE%' OR sku_name LIKE '%MODEL\\_SERVING%' ESCAPE '\\' THEN 'Model Serving'
 WHEN sku_name LIKE '%VECTOR\\_SEARCH%' ESCAPE '\\' THEN 'Vector Search' WHEN sku_name LIKE '%SERVERLESS%' THEN 'Serverless' ELSE 'Other' END AS product_category
 FROM usage GROUP BY sku_name""")),
    Query("flatten_metadata", _metadata, sql(
        "usage", f"SELECT {_row_ids()}, job_id, job_name, warehouse_id, cluster_id, run_as, priority FROM usage u")),
    Query("attach_account", lambda s: cost.attach_account(s.usage.select(*ROW), s.accounts), sql(
        "usage accounts", f"SELECT {_row_ids()}, {', '.join('a.' + c for c in ACCOUNT_COLUMNS)} FROM usage u LEFT JOIN accounts a ON a.account_id = u.account_id")),
    Query("dashboard_data", _dashboard, sql(
        "dashboard", f"SELECT {', '.join(ENRICHED)}, priority, {num('usage_quantity price_per_unit', 6)}, {r('list_cost', 6)} AS list_cost, "
        f"{r('actual_cost', 6)} AS actual_cost FROM dashboard"), 6),
    Query("cost_with_fallback_price", lambda s: cost.cost_with_fallback_price(s.usage, s.prices, s.as_of), sql(
        "usage prices", f"""SELECT u.account_id, u.usage_date, {r("SUM(u.usage_quantity * COALESCE(p.effective_price, p.default_price, 0.5))", 6)} AS daily_cost
 FROM usage u {DAY_JOIN} WHERE u.usage_date >= {ago(365)} AND u.usage_date < {AS_OF} GROUP BY u.account_id, u.usage_date"""), 6),
    Query("net_corrections", lambda s: cost.net_corrections(s.usage, ["account_id", "workspace_id", "sku_name", "usage_date"]), sql(
        "usage", """SELECT account_id, workspace_id, sku_name, usage_date, CAST(SUM(usage_quantity) AS DOUBLE) AS net_quantity, COUNT(*) AS record_count
 FROM usage GROUP BY ALL HAVING SUM(usage_quantity) > 0""")),
    Query("zero_default_cost", lambda s: cost.zero_default_cost(s.usage, s.prices, s.accounts, s.as_of), sql(
        "usage prices accounts dashboard", f"""SELECT u.usage_date, u.account_id, {', '.join('a.' + c for c in ACCOUNT_COLUMNS)}, u.workspace_id,
 u.cloud AS cloud_provider, u.sku_name, u.usage_unit, {num('usage_quantity', 6)},
 CAST(p.default_price AS DOUBLE) AS list_price_per_unit, CAST(p.default_price AS DOUBLE) AS discounted_price_per_unit,
 {', '.join(r('u.usage_quantity * COALESCE(p.default_price, 0)', 6) + f' AS {c}' for c in ('actual_cost', 'list_cost', 'discounted_cost'))}, k.product_category
 FROM usage u {DAY_JOIN} LEFT JOIN accounts a ON a.account_id = u.account_id
 LEFT JOIN (SELECT DISTINCT sku_name, product_category FROM dashboard) k ON k.sku_name = u.sku_name WHERE {last(365, 'u.usage_date')}"""), 6),
    Query("estimated_list_cost", _estimated, sql(
        "long_history", f"""SELECT account_id, product_category, {r('SUM(COALESCE(list_cost, usage_quantity * COALESCE(price_per_unit, 0.22)))')} AS estimated_list_cost,
 {r('SUM(list_cost)')} AS list_cost, COUNT(*) AS records FROM long_history GROUP BY account_id, product_category""")),
    Query("effective_discount", _discounts, sql(
        "dashboard", f"""SELECT account_id, cloud_provider, {r('SUM(list_cost)', 4)} AS list_cost, {r('SUM(actual_cost)', 4)} AS actual_cost,
 {rd('1 - ' + ratio('SUM(actual_cost)', 'SUM(list_cost)'), 4)} AS effective_discount FROM dashboard GROUP BY account_id, cloud_provider""")),
    Query("compute_vs_other", lambda s: cost.compute_vs_other(s.dashboard, s.as_of), sql(
        "dashboard", f"""SELECT category, {r('SUM(actual_cost)')} AS cost, {rd(ratio('SUM(actual_cost) * 100', 'SUM(SUM(actual_cost)) OVER ()'), 1)} AS pct
 FROM (SELECT actual_cost, CASE WHEN regexp_matches(sku_name, 'ALL_PURPOSE|JOBS') THEN 'Compute' WHEN contains(sku_name, 'SQL') THEN 'SQL'
  WHEN contains(sku_name, 'DLT') THEN 'DLT' ELSE 'Other' END AS category FROM dashboard WHERE {last(30)}) GROUP BY category""")),
    Query("detailed_usage", lambda s: cost.detailed_usage(s.usage, s.prices, s.as_of), sql(
        "dashboard", f"""SELECT usage_date, account_id, workspace_id, cloud_provider AS cloud, sku_name, usage_unit, CAST(SUM(usage_quantity) AS DOUBLE) AS total_usage,
 {r('SUM(list_cost)', 6)} AS list_cost, {r('SUM(actual_cost)', 6)} AS actual_cost, COUNT(*) AS record_count FROM dashboard GROUP BY ALL"""), 6),
]
