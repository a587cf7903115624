"""Report, top-k, anomaly and monthly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.operators import anomalies as n
from meterline.operators import reports as a
from meterline.operators import rollup
from meterline.operators.cost import cost_columns, price_interval_join
from meterline.registry.base import AS_OF, Query, ago, days, extend, grouped, last, month, num, r, ratio, rd, sql
from meterline.registry.cost import DAY_JOIN, JOIN
from meterline.registry.star import Star

PREV_MONTH = "usage_date BETWEEN DATE '2001-05-01' AND DATE '2001-05-31'"


def mean(column: str, digits: int = 2) -> str:
    return rd(ratio(f"SUM({column})", f"COUNT({column})"), digits)


def top(select: str, keys: str, days_back: int, extra: str = "TRUE", k: int = 10) -> str:
    order = ", ".join(f"{key} NULLS LAST" for key in keys.split(", "))
    return f"SELECT {keys}, {select} FROM dashboard WHERE {last(days_back)} AND {extra} GROUP BY {keys} ORDER BY total_cost DESC NULLS LAST, {order} LIMIT {k}"


DBU, COST = f"{r('SUM(usage_quantity)')} AS total_dbu", f"{r('SUM(actual_cost)')} AS total_cost"
TOP_WS = top(f"COUNT(DISTINCT usage_date) AS active_days, COUNT(DISTINCT sku_name) AS unique_skus, {DBU}, {COST}, {mean('actual_cost')} AS avg_daily_cost", "workspace_id, cloud_provider", 30)
TOP_SKU = top(f"COUNT(DISTINCT workspace_id) AS workspace_count, {r('SUM(usage_quantity)')} AS total_usage, {COST}, {mean('price_per_unit', 4)} AS avg_price_per_unit", "sku_name, cloud_provider, product_category", 30)
TOP_JOB = top(f"COUNT(DISTINCT usage_date) AS run_days, {DBU}, {COST}, {mean('actual_cost')} AS avg_run_cost", "job_id, job_name, cloud_provider", 30, "job_id IS NOT NULL")
TOP_USER = top(f"COUNT(DISTINCT usage_date) AS active_days, COUNT(DISTINCT workspace_id) AS workspace_count, {DBU}, {COST}", "run_as, cloud_provider", 30, "run_as IS NOT NULL")

extend("daily_prev", "dashboard", f"""
SELECT usage_date, cloud_provider, workspace_id, SUM(actual_cost) AS cost,
  LAG(SUM(actual_cost)) OVER (PARTITION BY cloud_provider, workspace_id ORDER BY usage_date) AS prev
FROM dashboard WHERE {last(30)} GROUP BY usage_date, cloud_provider, workspace_id""")
extend("spikes", "daily_prev", f"""
SELECT usage_date, cloud_provider, workspace_id, {r('cost')} AS today_cost, {r('prev')} AS yesterday_cost, {r('cost - prev')} AS cost_change,
  {rd(ratio('cost - prev', 'prev') + ' * 100', 1)} AS pct_change
FROM daily_prev WHERE prev > 0 AND ABS({ratio('cost - prev', 'prev')}) > 0.5""")
extend("weekend", "dashboard", f"""
SELECT usage_date, CAST(dayofweek(usage_date) + 1 AS BIGINT) AS day_of_week, workspace_id, cloud_provider, {r('SUM(actual_cost)')} AS cost
FROM dashboard WHERE {last(30)} AND dayofweek(usage_date) IN (0, 6) AND actual_cost > 100 GROUP BY ALL""")
extend("new_ws", "long_history", f"""
SELECT f.workspace_id, f.cloud_provider, f.first_seen, {days('f.first_seen', AS_OF)} AS days_active, COUNT(DISTINCT d.usage_date) AS usage_days, {r('SUM(d.actual_cost)')} AS total_cost
FROM (SELECT workspace_id, cloud_provider, MIN(usage_date) AS first_seen FROM long_history GROUP BY ALL) f
JOIN long_history d ON d.workspace_id = f.workspace_id AND d.cloud_provider = f.cloud_provider
WHERE f.first_seen >= {ago(30)} GROUP BY ALL""")


def _new(s: Star):
    return n.new_workspaces(s.long_history, s.as_of)


def _spikes(s: Star):
    return n.daily_spikes(s.dashboard, s.as_of)


def _costed(s: Star):
    return cost_columns(price_interval_join(s.usage, s.prices))


def _month_range(s: Star):
    bounds = a.prev_month_range(s.spark, s.as_of)
    month_rows = s.dashboard.filter(F.col("usage_date").between(*[F.lit(d) for d in a.month_bounds(s.as_of)]))
    return month_rows.groupBy(a.month_of("usage_date").alias("month_start")).agg(F.count("*").alias("records")).join(bounds, "month_start")


MONTHLY = f"""SELECT d.cloud_provider, COUNT(DISTINCT d.usage_date) AS days_with_data, COUNT(DISTINCT d.workspace_id) AS active_workspaces,
 COUNT(DISTINCT d.sku_name) AS unique_skus, {r('SUM(d.usage_quantity)')} AS total_dbu, {r('SUM(d.actual_cost)')} AS total_cost,
 {rd('AVG(CAST(t.day_cost AS DOUBLE))')} AS avg_daily_cost, {r('MAX(t.day_cost)')} AS max_daily_cost, {r('MIN(t.day_cost)')} AS min_daily_cost
 FROM dashboard d JOIN (SELECT usage_date, SUM(actual_cost) AS day_cost FROM dashboard GROUP BY usage_date) t ON t.usage_date = d.usage_date
 WHERE d.{PREV_MONTH} GROUP BY d.cloud_provider"""
DAY_COST = f"SELECT u.usage_date, SUM(u.usage_quantity * COALESCE(p.default_price, 0)) AS c FROM usage u {DAY_JOIN}"
OVERRUN = f"""SELECT c.contract_id, c.total_value, {ratio(days('c.start_date', AS_OF), days('c.start_date', 'c.end_date'))} AS elapsed,
 {ratio('SUM(d.actual_cost)', 'c.total_value')} AS spent FROM contracts c LEFT JOIN long_history d ON d.account_id = c.account_id
 AND d.cloud_provider = c.cloud_provider AND d.usage_date BETWEEN c.start_date AND {AS_OF} WHERE c.status = 'ACTIVE'
 GROUP BY c.contract_id, c.total_value, c.start_date, c.end_date"""

QUERIES = [
    Query("daily_summary", lambda s: a.daily_summary(s.dashboard), sql(
        "dashboard", f"SELECT usage_date, cloud_provider, workspace_id, CAST(SUM(usage_quantity) AS DOUBLE) AS total_dbu, {r('SUM(actual_cost)', 6)} AS total_cost, COUNT(DISTINCT sku_name) AS unique_skus FROM dashboard GROUP BY ALL"), 6),
    Query("refresh_summary", lambda s: a.refresh_summary(s.dashboard), sql(
        "dashboard", f"SELECT COUNT(*) AS total_records, MIN(usage_date) AS earliest_date, MAX(usage_date) AS latest_date, {r('SUM(actual_cost)', 6)} AS total_cost FROM dashboard"), 6),
    Query("yesterday_cost", lambda s: a.yesterday_cost(s.dashboard, s.as_of), sql(
        "dashboard", f"SELECT cloud_provider, {r('SUM(actual_cost)')} AS cost, {r('SUM(usage_quantity)')} AS dbu, COUNT(DISTINCT workspace_id) AS workspaces FROM dashboard WHERE usage_date = {ago(1)} GROUP BY cloud_provider")),
    Query("month_to_date", lambda s: a.month_to_date(s.dashboard, s.as_of), sql(
        "dashboard", f"SELECT cloud_provider, COUNT(DISTINCT workspace_id) AS workspaces, {r('SUM(actual_cost)')} AS mtd_cost FROM dashboard WHERE usage_date >= date_trunc('month', {AS_OF}) GROUP BY cloud_provider")),
    Query("total_spend", lambda s: a.total_spend(s.dashboard, s.as_of), sql(
        "dashboard", f"SELECT customer_name, cloud_provider, MIN(usage_date) AS start_date, MAX(usage_date) AS end_date, {r('SUM(usage_quantity)', 3)} AS dbu, {r('SUM(list_cost)')} AS list_cost, {COST} FROM dashboard GROUP BY ALL")),
    Query("flat_discount_spend", lambda s: a.flat_discount_spend(s.usage, s.prices, s.accounts, s.as_of), sql(
        "usage prices accounts", f"""SELECT a.customer_name, u.cloud, strftime(MIN(u.usage_date), '%Y%m%d') || '0000' AS start_date, strftime(MAX(u.usage_date), '%Y%m%d') || '0000' AS end_date,
 {r('SUM(u.usage_quantity)', 3)} AS dbu, {r('SUM(u.usage_quantity * COALESCE(p.default_price, 0))')} AS list_price,
 {r('CAST(SUM(u.usage_quantity * COALESCE(p.default_price, 0)) AS DECIMAL(24,6)) * 0.85')} AS discounted_price, {r('SUM(u.usage_quantity * COALESCE(p.default_price, 0))')} AS revenue
 FROM usage u {DAY_JOIN} LEFT JOIN accounts a ON a.account_id = u.account_id WHERE {last(365, 'u.usage_date')} GROUP BY a.customer_name, u.cloud""")),
    Query("account_overview", lambda s: a.account_overview(s.usage, s.as_of), sql(
        "usage", f"SELECT COUNT(DISTINCT sku_name) AS top_sku_count, COUNT(DISTINCT workspace_id) AS top_workspace_count, MAX(usage_date) AS latest_usage_date, MIN(usage_date) AS earliest_usage_date, {days('MIN(usage_date)', 'MAX(usage_date)')} AS days_of_data FROM usage WHERE {last(365)}")),
    Query("account_info_counts", lambda s: a.account_info_counts(s.accounts, s.usage, s.as_of), sql(
        "accounts usage", f"""SELECT a.customer_name, a.business_unit_l0, a.business_unit_l1, a.business_unit_l2, a.business_unit_l3, a.account_executive, a.solutions_architect,
 a.delivery_solutions_architect, COUNT(DISTINCT u.workspace_id) AS total_workspaces, COUNT(DISTINCT u.sku_name) AS total_skus
 FROM accounts a LEFT JOIN usage u ON u.account_id = a.account_id AND {last(365, 'u.usage_date')} GROUP BY ALL""")),
    Query("account_info_label", lambda s: a.account_info_label(s.accounts), sql(
        "accounts", "SELECT customer_name, concat_ws(' > ', business_unit_l0, business_unit_l1, business_unit_l2, business_unit_l3) AS business_unit, account_executive, solutions_architect, delivery_solutions_architect FROM accounts")),
    Query("monthly_trend", lambda s: a.monthly_trend(s.dashboard, s.as_of), sql(
        "dashboard", f"SELECT {month('usage_date')} AS month, cloud_provider, {r('SUM(usage_quantity)')} AS monthly_dbu, {r('SUM(actual_cost)')} AS monthly_cost, COUNT(DISTINCT workspace_id) AS active_workspaces, COUNT(DISTINCT sku_name) AS unique_skus FROM dashboard GROUP BY ALL")),
    Query("category_trend", lambda s: a.category_trend(s.dashboard, s.as_of), sql(
        "dashboard", f"SELECT {month('usage_date')} AS month, product_category AS category, cloud_provider, {DBU}, {COST} FROM dashboard GROUP BY ALL")),
    Query("weekend_vs_weekday", lambda s: a.weekend_vs_weekday(s.dashboard, s.as_of), sql(
        "dashboard", f"SELECT CASE dayofweek(usage_date) WHEN 0 THEN 'Sunday' WHEN 6 THEN 'Saturday' ELSE 'Weekday' END AS day_type, {rd(ratio('SUM(c)', 'COUNT(c)'))} AS avg_cost FROM (SELECT usage_date, SUM(actual_cost) AS c FROM dashboard WHERE {last(90)} GROUP BY usage_date) GROUP BY day_type")),
    Query("daily_cost_by_cloud", lambda s: a.daily_cost_by_cloud(s.dashboard, s.as_of), sql(
        "dashboard", f"SELECT usage_date, cloud_provider, COUNT(*) AS record_count, CAST(SUM(usage_quantity) AS DOUBLE) AS total_dbu, {COST}, {mean('actual_cost', 4)} AS avg_cost FROM dashboard WHERE {last(30)} GROUP BY ALL")),
    Query("daily_cumulative_by_cloud", lambda s: a.daily_cumulative_by_cloud(s.dashboard, s.as_of), sql(
        "dashboard", f"SELECT usage_date, cloud_provider, CAST(SUM(usage_quantity) AS DOUBLE) AS daily_dbu, {r('SUM(actual_cost)', 6)} AS daily_cost, {r('SUM(SUM(actual_cost)) OVER (PARTITION BY cloud_provider ORDER BY usage_date)', 6)} AS cumulative_cost FROM dashboard GROUP BY usage_date, cloud_provider"), 6),
    Query("job_cost", lambda s: a.job_cost(s.usage, s.prices, s.as_of), sql(
        "dashboard", f"SELECT job_id, job_name, COUNT(DISTINCT job_run_id) AS run_count, CAST(SUM(usage_quantity) AS DOUBLE) AS total_dbu, {COST} FROM dashboard WHERE {last(30)} AND job_id IS NOT NULL GROUP BY ALL")),
    Query("summary_metrics_long", lambda s: a.summary_metrics_long(s.usage, s.prices, s.as_of), sql(
        "usage prices", f"""SELECT 'Total Spend (Last 365 days)' AS metric, 'USD ' || {grouped('ROUND(SUM(c), 2)', 2)} AS value FROM ({DAY_COST} WHERE {last(365, 'u.usage_date')} GROUP BY u.usage_date)
 UNION ALL SELECT 'Total DBUs Consumed', {grouped('SUM(usage_quantity)', 2)} FROM usage WHERE {last(365)}
 UNION ALL SELECT 'Active Workspaces', CAST(COUNT(DISTINCT workspace_id) AS VARCHAR) FROM usage WHERE {last(90)}
 UNION ALL SELECT 'Unique SKUs Used', CAST(COUNT(DISTINCT sku_name) AS VARCHAR) FROM usage WHERE {last(365)}
 UNION ALL SELECT 'Average Daily Spend', 'USD ' || {grouped('AVG(CAST(c AS DOUBLE))', 2)} FROM ({DAY_COST} WHERE {last(90, 'u.usage_date')} GROUP BY u.usage_date)""")),
    Query("high_cost_days", lambda s: a.high_cost_days(s.dashboard, s.as_of), sql(
        "dashboard", f"SELECT usage_date, {r('SUM(actual_cost)', 6)} AS daily_cost FROM dashboard WHERE {last(30)} GROUP BY usage_date ORDER BY SUM(actual_cost) DESC NULLS LAST, usage_date LIMIT 10"), 6),
    Query("time_series", lambda s: a.time_series(s.dashboard, s.as_of, "WEEK", ("cloud_provider", "product_category")), sql(
        "dashboard", f"SELECT CAST(date_trunc('week', usage_date) AS DATE) AS period, cloud_provider, product_category, {r('SUM(actual_cost)')} AS cost FROM dashboard WHERE {last(90)} GROUP BY ALL")),
    Query("cost_by", lambda s: a.cost_by(s.dashboard, s.as_of, ("account_id", "product_category"), 60, F.col("cloud_provider") != "GCP"), sql(
        "dashboard", f"SELECT account_id, product_category, COUNT(DISTINCT usage_date) AS active_days, {DBU}, {COST} FROM dashboard WHERE {last(60)} AND cloud_provider <> 'GCP' GROUP BY ALL")),
    Query("period_summary", lambda s: a.period_summary(s.dashboard, s.as_of), sql(
        "dashboard", "\nUNION ALL\n".join(f"SELECT '{label}' AS period, COUNT(DISTINCT usage_date) AS days_with_data, {r('SUM(c)')} AS total_cost, {rd(ratio('SUM(c)', 'COUNT(c)'))} AS avg_daily_cost, COUNT(DISTINCT workspace_id) AS active_workspaces FROM (SELECT usage_date, workspace_id, SUM(actual_cost) AS c FROM dashboard WHERE {cond} GROUP BY ALL)"
            for label, cond in (("Last Week", f"usage_date >= {ago(7)} AND usage_date < {AS_OF}"), ("Last Month", PREV_MONTH))))),
    Query("account_list", lambda s: a.account_list(s.dashboard, s.as_of, filters=F.col("business_unit_l0") == "AMER"), sql(
        "dashboard", "SELECT DISTINCT customer_name FROM dashboard WHERE business_unit_l0 = 'AMER'")),
    Query("recent_rows", lambda s: a.recent_rows(s.dashboard, s.as_of), sql(
        "dashboard", f"SELECT usage_date, account_id, workspace_id, cloud_provider, sku_name, {num('usage_quantity')}, {r('actual_cost', 4)} AS actual_cost, run_as FROM dashboard d ORDER BY usage_date DESC, account_id NULLS LAST, workspace_id, cloud_provider, sku_name, d.usage_quantity, d.actual_cost NULLS LAST, run_as LIMIT 100")),
    # top-k
    Query("top_workspaces", lambda s: a.top_workspaces(s.dashboard, s.as_of), sql("dashboard", TOP_WS)),
    Query("top_skus", lambda s: a.top_skus(s.dashboard, s.as_of), sql("dashboard", TOP_SKU)),
    Query("top_jobs", lambda s: a.top_jobs(s.dashboard, s.as_of), sql("dashboard", TOP_JOB)),
    Query("top_users", lambda s: a.top_users(s.dashboard, s.as_of), sql("dashboard", TOP_USER)),
    Query("top_consumers_report", lambda s: rollup.top_consumers(s.rollup, s.as_of), sql(
        "dashboard", f"""SELECT 'TOP WORKSPACES' AS report_section, workspace_id AS name, cloud_provider, active_days, unique_skus, total_dbu, total_cost, avg_daily_cost FROM ({TOP_WS})
 UNION ALL SELECT 'TOP SKUS', sku_name, cloud_provider, workspace_count, NULL, total_usage, total_cost, NULL FROM ({TOP_SKU})
 UNION ALL SELECT 'TOP JOBS', COALESCE(job_name, job_id), cloud_provider, run_days, NULL, total_dbu, total_cost, avg_run_cost FROM ({TOP_JOB})
 UNION ALL SELECT 'TOP USERS', run_as, cloud_provider, active_days, workspace_count, total_dbu, total_cost, NULL FROM ({TOP_USER})""")),
    Query("top_workspaces_90d", lambda s: a.top_workspaces_90d(s.dashboard, s.as_of), sql(
        "dashboard", top(f"COUNT(DISTINCT sku_name) AS sku_count, {DBU}, {COST}, COUNT(DISTINCT usage_date) AS active_days", "workspace_id, cloud_provider", 90))),
    Query("top_skus_90d", lambda s: a.top_skus_90d(s.dashboard, s.as_of), sql(
        "dashboard", top(f"{r('SUM(usage_quantity)')} AS total_usage, {COST}, COUNT(DISTINCT workspace_id) AS workspace_count, COUNT(DISTINCT usage_date) AS active_days", "sku_name, cloud_provider, usage_unit", 90))),
    # anomalies
    Query("daily_spikes", _spikes, sql("spikes", "SELECT * FROM spikes")),
    Query("weekend_usage", lambda s: n.weekend_usage(s.dashboard, s.as_of), sql("weekend", "SELECT * FROM weekend")),
    Query("new_workspaces", _new, sql("new_ws", "SELECT * FROM new_ws")),
    Query("anomaly_summary", lambda s: n.anomaly_summary(_spikes(s), n.weekend_usage(s.dashboard, s.as_of), _new(s)), sql(
        "spikes weekend new_ws", """SELECT 'Daily Anomalies' AS anomaly_type, COUNT(*) AS count, ROUND(SUM(cost_change), 2) AS total_impact FROM spikes
 UNION ALL SELECT 'Weekend Usage', COUNT(*), ROUND(SUM(cost), 2) FROM weekend UNION ALL SELECT 'New Workspaces', COUNT(*), ROUND(SUM(total_cost), 2) FROM new_ws""")),
    Query("spike_alerts", lambda s: n.spike_alerts(_spikes(s)), sql(
        "spikes", "SELECT 'DAILY SPIKE' AS alert_type, usage_date, cloud_provider, workspace_id, today_cost, yesterday_cost, pct_change FROM spikes WHERE pct_change > 0 ORDER BY pct_change DESC, usage_date, cloud_provider, workspace_id LIMIT 10")),
    Query("workspace_spikes", lambda s: n.workspace_spikes(s.dashboard, s.as_of), sql(
        "dashboard", f"""SELECT usage_date, workspace_id, {r('cost')} AS today_cost, {r('prev')} AS yesterday_cost, {rd(ratio('cost - prev', 'prev') + ' * 100', 1)} AS pct_change
 FROM (SELECT usage_date, workspace_id, SUM(actual_cost) AS cost, LAG(SUM(actual_cost)) OVER (PARTITION BY workspace_id ORDER BY usage_date) AS prev FROM dashboard WHERE {last(30)} GROUP BY usage_date, workspace_id)
 WHERE prev > 0 AND {ratio('cost - prev', 'prev')} > 0.5 ORDER BY pct_change DESC, usage_date, workspace_id LIMIT 10""")),
    Query("day_over_day_change", lambda s: n.day_over_day_change(s.dashboard, s.as_of), sql(
        "dashboard", f"""SELECT usage_date, {r('cost')} AS cost, {r('cost - prev')} AS change, {rd(ratio('cost - prev', 'prev') + ' * 100', 1)} AS pct_change
 FROM (SELECT usage_date, SUM(actual_cost) AS cost, LAG(SUM(actual_cost)) OVER (ORDER BY usage_date) AS prev FROM dashboard WHERE {last(7)} GROUP BY usage_date)""")),
    Query("high_spend_alert", lambda s: n.high_spend_alert(s.dashboard, s.as_of), sql(
        "dashboard", f"""SELECT {rd('y')} AS yesterday_spend, {rd('m')} AS avg_daily_spend, CASE WHEN y > m * 1.5 THEN 'HIGH SPEND ALERT' ELSE 'No alert' END AS alert_message
 FROM (SELECT MAX(c) FILTER (usage_date = {ago(1)}) AS y, AVG(c) FILTER (usage_date < {ago(1)}) AS m
 FROM (SELECT usage_date, CAST(SUM(actual_cost) AS DOUBLE) AS c FROM dashboard WHERE usage_date >= {ago(30)} AND usage_date < {AS_OF} GROUP BY usage_date))""")),
    Query("non_positive_usage", lambda s: n.non_positive_usage(_costed(s), s.as_of), sql(
        "usage prices", f"""SELECT u.usage_date, u.workspace_id, u.sku_name, {num('usage_quantity', 6)}, {r('u.usage_quantity * p.effective_price', 6)} AS actual_cost, 'Negative or zero cost' AS issue
 FROM usage u {JOIN} WHERE {last(30, 'u.usage_date')} AND (u.usage_quantity * p.effective_price <= 0 OR u.usage_quantity <= 0)"""), 6),
    Query("first_seen_recent", lambda s: n.first_seen_recent(s.long_history, s.as_of), sql(
        "long_history", f"SELECT workspace_id, MIN(usage_date) AS first_seen FROM long_history GROUP BY workspace_id HAVING MIN(usage_date) >= {ago(7)}")),
    Query("exhaustion_alert", lambda s: n.exhaustion_alert(s.forecast, s.as_of, 120), sql(
        "forecast", f"SELECT DISTINCT contract_id, exhaustion_date_p50 AS predicted_exhaustion, {days(AS_OF, 'exhaustion_date_p50')} AS days_until_exhaustion, 'ALERT: Contract exhausting soon' AS alert_message FROM forecast WHERE {days(AS_OF, 'exhaustion_date_p50')} BETWEEN 1 AND 120")),
    Query("contract_overrun_alert", lambda s: n.contract_overrun_alert(s.contracts, s.long_history, s.as_of), sql(
        "contracts long_history", f"""SELECT contract_id, ROUND(spent * 100, 1) AS pct_spent, ROUND(elapsed * 100, 1) AS pct_elapsed,
 'CONTRACT ALERT: ' || contract_id || ' is consuming faster than expected. ' || ROUND(spent * 100, 1) || '% spent with ' || ROUND(elapsed * 100, 1) || '% time elapsed' AS alert_message
 FROM ({OVERRUN}) WHERE spent > elapsed * 1.1""")),
    Query("staleness_alert", lambda s: n.staleness_alert(s.burndown, "usage_date", s.as_of), sql(
        "burndown", f"SELECT MAX(usage_date) AS latest_date, {days('MAX(usage_date)', AS_OF)} AS max_staleness_days, CASE WHEN {days('MAX(usage_date)', AS_OF)} > 3 THEN 'ALERT: Data pipeline may be failing' ELSE 'OK' END AS alert_status FROM burndown")),
    # monthly
    Query("prev_month_range", _month_range, sql(
        "dashboard", f"SELECT DATE '2001-05-01' AS month_start, DATE '2001-05-31' AS month_end, COUNT(*) AS records FROM dashboard WHERE {PREV_MONTH}")),
    Query("monthly_stats", lambda s: rollup.monthly_stats(s.rollup, s.as_of), sql("dashboard", MONTHLY)),
    Query("product_breakdown", lambda s: a.product_breakdown(s.dashboard, s.as_of), sql(
        "dashboard", f"SELECT product_category, {r('SUM(actual_cost)')} AS cost, {rd(ratio('SUM(actual_cost) * 100', 'SUM(SUM(actual_cost)) OVER ()'), 1)} AS cost_pct FROM dashboard WHERE {PREV_MONTH} GROUP BY product_category")),
    Query("month_over_month", lambda s: a.month_over_month(s.dashboard, s.as_of), sql(
        "dashboard", f"""SELECT month, cloud_provider, CAST(m AS DOUBLE) AS monthly_cost, CAST(p AS DOUBLE) AS prev_month_cost, {r('m - p')} AS cost_change, {rd(ratio('m - p', 'p') + ' * 100', 1)} AS pct_change
 FROM (SELECT *, LAG(m) OVER (PARTITION BY cloud_provider ORDER BY month) AS p FROM (SELECT {month('usage_date')} AS month, cloud_provider, ROUND(SUM(actual_cost), 2) AS m FROM dashboard WHERE {last(90)} GROUP BY ALL)) WHERE p IS NOT NULL""")),
    Query("monthly_report", lambda s: rollup.monthly_report(s.rollup, s.as_of), sql(
        "dashboard", f"SELECT DATE '2001-05-01' AS report_month, 'MONTHLY SUMMARY' AS section, m.* FROM ({MONTHLY}) m")),
    Query("monthly_change_total", lambda s: a.monthly_change_total(s.dashboard, s.as_of), sql(
        "dashboard", f"""SELECT month, {r('m')} AS cost, {r('p')} AS prev_cost, {rd(ratio('m - p', 'p') + ' * 100', 1)} AS month_over_month_pct
 FROM (SELECT *, LAG(m) OVER (ORDER BY month) AS p FROM (SELECT {month('usage_date')} AS month, SUM(actual_cost) AS m FROM dashboard WHERE {last(180)} GROUP BY ALL)) WHERE p IS NOT NULL""")),
]
