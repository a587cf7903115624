"""Dimension upkeep and data-quality queries."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from meterline.operators import quality as q
from meterline.operators import upkeep as u
from meterline.operators import whatif as w
from meterline.registry import whatif as whatif_queries  # noqa: F401  its tables are used below
from meterline.registry.base import AS_OF, Query, ago, days, extend, last, num, r, ratio, rd, rn, sql
from meterline.registry.cost import JOIN
from meterline.registry.star import Star

# Changed contract tables of the upsert checks: same ids, values raised, one note emptied, one id new.
extend("new_contracts", "contracts", """
SELECT CASE WHEN contract_id = 'C901' THEN 'C999' ELSE contract_id END AS contract_id, account_id, total_value * 2 AS total_value, 'PENDING' AS status
FROM contracts WHERE contract_id >= 'C010'""")
extend("changed_terms", "contracts", """
SELECT CASE WHEN contract_id = 'C902' THEN 'C998' ELSE contract_id END AS contract_id, account_id, CASE WHEN cloud_provider = 'AWS' THEN total_value + 1000 ELSE total_value END AS total_value,
  CASE WHEN cloud_provider = 'GCP' THEN NULL ELSE notes END AS notes FROM contracts WHERE start_date >= DATE '2000-01-01'""")


def _terms(s: Star):
    return s.contracts.select("contract_id", "account_id", "total_value", "notes")


def _changed_terms(s: Star):
    cloud = F.col("cloud_provider")
    return s.contracts.filter(F.col("start_date") >= F.lit(date(2000, 1, 1))).select(
        F.when(F.col("contract_id") == "C902", "C998").otherwise(F.col("contract_id")).alias("contract_id"), "account_id",
        F.when(cloud == "AWS", F.col("total_value") + 1000).otherwise(F.col("total_value")).cast("decimal(18,2)").alias("total_value"),
        F.when(cloud != "GCP", F.col("notes")).alias("notes"),
    )


def _contracts(s: Star):
    return s.contracts.select("contract_id", "account_id", "total_value", "status", "created_at")


def _new_contracts(s: Star):
    return _contracts(s).filter("contract_id >= 'C010'").select(
        F.when(F.col("contract_id") == "C901", "C999").otherwise(F.col("contract_id")).alias("contract_id"), "account_id",
        (F.col("total_value") * 2).cast("decimal(18,2)").alias("total_value"), F.lit("PENDING").alias("status"),
        F.lit(s.as_of + timedelta(days=1)).cast("timestamp").alias("created_at"),
    )


def _scenario_merge(s: Star):
    columns = ["scenario_id", "usage_date", "simulated_daily_cost", "simulated_cumulative"]
    rows = s.scenario_burndown.select(*columns)
    stale = rows.filter(F.col("usage_date") <= F.lit(s.as_of - timedelta(days=60))).withColumn("simulated_daily_cost", F.lit(0.0))
    return u.merge_scenarios(stale, rows, ["scenario_id", "usage_date"])


def _flagged(s: Star):
    best = w.sweet_spot_simple(s.scenario_summary).filter("is_sweet_spot")
    return u.flag_best(s.scenarios.select("scenario_id", "contract_id", "scenario_name", "is_recommended"), best, "is_recommended")


def _archived(s: Star):
    kept, old = u.archive_split(s.long_history, s.as_of)
    return u.archive_summary(kept).withColumn("part", F.lit("kept")).unionByName(u.archive_summary(old).withColumn("part", F.lit("archived")))


def _deleted(s: Star):
    kept, removed = u.delete_where(s.contracts, (F.col("status") == "EXPIRED") & (F.col("end_date") < F.lit(s.as_of - timedelta(days=365))))
    return kept.select("contract_id", "status", F.lit("kept").alias("part")).unionByName(removed.select("contract_id", "status", F.lit("removed").alias("part")))


def _known_accounts(s: Star):
    return s.accounts.filter("account_id <> 'MACHINERY'").select("account_id", "customer_name", "business_unit_l0", "account_executive")


def _teams(s: Star):
    units = s.accounts.select("business_unit_l0").distinct().filter("business_unit_l0 <> 'APAC'")
    return units.select("business_unit_l0", F.concat("business_unit_l0", F.lit(" lead")).alias("account_executive"), F.concat("business_unit_l0", F.lit(" SA")).alias("solutions_architect"))


def _table_freshness(s: Star):
    made = s.forecast.select((F.min("forecast_date").over(q.W.partitionBy("contract_id")) - F.expr("INTERVAL 1 DAY")).cast("date").alias("made_on"))
    calculated = s.scenario_summary.select(F.lit(s.as_of - timedelta(days=9)).alias("made_on"))
    return q.table_freshness(s.burndown, made, calculated, s.as_of)


def _missing(s: Star):
    """The whole history, from a month before the first record on."""
    return q.missing_days(s.usage, "usage_date", date(1994, 12, 1), s.as_of - timedelta(days=1))


def _broken_burndown(s: Star):
    """A stored running total damaged on Mondays, to be found again."""
    bad = F.when(F.dayofweek("usage_date") == 2, F.col("cumulative_cost") + F.datediff(F.lit(s.as_of), "usage_date")).otherwise(F.col("cumulative_cost"))
    return q.cumulative_consistency(s.burndown.withColumn("cumulative_cost", bad))


def _overlapping(s: Star):
    """Price intervals with the ends of one price year moved too far."""
    late = F.when(F.year("price_start_time") == 1998, F.col("price_end_time") + F.expr("INTERVAL 10 DAYS")).otherwise(F.col("price_end_time"))
    return q.price_overlap_check(s.prices.withColumn("price_end_time", late)).select(
        "sku_name", "cloud", "usage_unit", *[F.to_date(c).alias(c) for c in ("price_start_time", "price_end_time", "earlier_end")]
    )


def _few_prices(s: Star):
    return q.unpriced_skus(s.usage, s.prices.filter("sku_name NOT LIKE '%STORAGE'"), s.as_of)


def _counts(s: Star):
    return q.row_counts({
        "contracts": (s.contracts, "start_date"), "account_metadata": (s.accounts, None), "contract_burndown": (s.burndown, "usage_date"),
        "contract_forecast": (s.forecast, "forecast_date"), "dashboard_data": (s.dashboard, "usage_date"), "discount_tiers": (s.tiers, None),
    })


def _install(s: Star):
    return q.install_report(s.contracts, s.accounts, s.dashboard, s.burndown, s.forecast, s.commitment.recommendations)


def _suite(s: Star):
    return q.validation_suite(s.usage, s.accounts, s.contracts, s.dashboard, s.as_of)


FRESH = "CASE WHEN n <= 2 THEN 'OK' WHEN n <= 5 THEN 'WARNING' ELSE 'CRITICAL' END"
NULL_SPAN = "CAST(NULL AS DATE), CAST(NULL AS DATE)"

QUERIES = [
    # upkeep
    Query("upsert", lambda s: u.upsert(_contracts(s), _new_contracts(s), ["contract_id"]), sql(
        "contracts new_contracts", f"""SELECT COALESCE(t.contract_id, s.contract_id) AS contract_id, COALESCE(s.account_id, t.account_id) AS account_id, CAST(COALESCE(s.total_value, t.total_value) AS DOUBLE) AS total_value,
 COALESCE(s.status, t.status) AS status, CAST(CASE WHEN t.contract_id IS NULL THEN {AS_OF} + 1 ELSE {AS_OF} END AS TIMESTAMP) AS created_at,
 CASE WHEN t.contract_id IS NULL THEN 'insert' WHEN s.contract_id IS NULL THEN 'unchanged' ELSE 'update' END AS _action FROM contracts t FULL JOIN new_contracts s ON s.contract_id = t.contract_id""")),
    Query("upsert_changed", lambda s: u.upsert_changed(_terms(s), _changed_terms(s), ["contract_id"], ["account_id", "total_value", "notes"]), sql(
        "contracts changed_terms", """SELECT COALESCE(t.contract_id, s.contract_id) AS contract_id, CASE WHEN s.contract_id IS NULL THEN t.account_id ELSE s.account_id END AS account_id,
 CAST(CASE WHEN s.contract_id IS NULL THEN t.total_value ELSE s.total_value END AS DOUBLE) AS total_value, CASE WHEN s.contract_id IS NULL THEN t.notes ELSE s.notes END AS notes,
 CASE WHEN t.contract_id IS NULL THEN 'insert' WHEN s.contract_id IS NOT NULL AND (t.account_id IS DISTINCT FROM s.account_id OR t.total_value IS DISTINCT FROM s.total_value OR t.notes IS DISTINCT FROM s.notes) THEN 'update'
 ELSE 'unchanged' END AS _action FROM contracts t FULL JOIN changed_terms s ON s.contract_id = t.contract_id""")),
    Query("replace_by_prefix", lambda s: u.replace_by_prefix(_terms(s), _changed_terms(s), "contract_id", ("C00%", "C9_1")), sql(
        "contracts changed_terms", """SELECT contract_id, account_id, CAST(total_value AS DOUBLE) AS total_value, notes FROM contracts WHERE NOT (starts_with(contract_id, 'C00') OR contract_id = 'C901')
 UNION ALL SELECT contract_id, account_id, CAST(total_value AS DOUBLE), notes FROM changed_terms""")),
    Query("merge_scenarios", _scenario_merge, sql(
        "all_sb", f"SELECT scenario_id, usage_date, {num('simulated_daily_cost simulated_cumulative', 7)}, CASE WHEN usage_date <= {ago(60)} THEN 'update' ELSE 'insert' END AS _action FROM all_sb"), 7),
    Query("flag_best", _flagged, sql("simple", "SELECT scenario_id, contract_id, scenario_name, is_sweet_spot AS is_recommended FROM simple")),
    Query("archive_split", _archived, sql(
        "long_history", "\nUNION ALL\n".join(f"SELECT '{part}' AS part, COUNT(*) AS archived_records, MIN(usage_date) AS oldest_date, MAX(usage_date) AS newest_date, {r('SUM(actual_cost)')} AS total_archived_cost FROM long_history WHERE usage_date {op} {ago(730)}" for part, op in (("kept", ">="), ("archived", "<"))))),
    Query("derive_status", lambda s: u.status_changes(s.contracts, s.as_of), sql(
        "contracts", f"SELECT contract_id, status AS old_status, n AS new_status, end_date FROM (SELECT *, CASE WHEN end_date < {AS_OF} THEN 'EXPIRED' WHEN start_date > {AS_OF} THEN 'PENDING' ELSE 'ACTIVE' END AS n FROM contracts) WHERE status <> n")),
    Query("delete_where", _deleted, sql("contracts", f"SELECT contract_id, status, CASE WHEN status = 'EXPIRED' AND end_date < {ago(365)} THEN 'removed' ELSE 'kept' END AS part FROM contracts")),
    Query("drop_orphan_accounts", lambda s: u.drop_orphan_accounts(s.accounts, s.contracts).select("account_id", "customer_name"), sql(
        "accounts contracts", "SELECT account_id, customer_name FROM accounts WHERE account_id IN (SELECT account_id FROM contracts)")),
    Query("insert_missing_accounts", lambda s: u.insert_missing_accounts(_known_accounts(s), s.usage, s.as_of, {"customer_name": "New customer", "business_unit_l0": "AMER"}).drop("created_at", "updated_at"), sql(
        "accounts usage", f"""SELECT account_id, customer_name, business_unit_l0, account_executive FROM accounts WHERE account_id <> 'MACHINERY'
 UNION ALL SELECT DISTINCT account_id, 'New customer', 'AMER', NULL FROM usage WHERE {last(30)} AND account_id NOT IN (SELECT account_id FROM accounts WHERE account_id <> 'MACHINERY')""")),
    Query("seed_contract", lambda s: u.seed_contract(s.usage, s.as_of), sql(
        "usage", f"""SELECT 'CONTRACT_' || CAST(epoch({AS_OF}) AS BIGINT) AS contract_id, account_id, cloud AS cloud_provider, {AS_OF} AS start_date, {AS_OF} + 365 AS end_date, CAST(5000 AS DOUBLE) AS total_value,
 'USD' AS currency, 'SPEND' AS commitment_type, 'ACTIVE' AS status FROM usage WHERE {last(30)} GROUP BY account_id, cloud ORDER BY SUM(usage_quantity) DESC, account_id, cloud LIMIT 1""")),
    Query("bulk_assign", lambda s: u.bulk_assign(s.accounts, _teams(s)).select("account_id", "business_unit_l0", "account_executive", "solutions_architect"), sql(
        "accounts", "SELECT account_id, business_unit_l0, CASE WHEN business_unit_l0 <> 'APAC' THEN business_unit_l0 || ' lead' ELSE account_executive END AS account_executive, CASE WHEN business_unit_l0 <> 'APAC' THEN business_unit_l0 || ' SA' ELSE solutions_architect END AS solutions_architect FROM accounts")),
    Query("drop_columns", lambda s: u.drop_columns(s.contracts, "notes", "currency", "created_at", "updated_at"), sql(
        "contracts", "SELECT contract_id, account_id, cloud_provider, start_date, end_date, CAST(total_value AS DOUBLE) AS total_value, commitment_type, status FROM contracts")),
    # quality
    Query("freshness", lambda s: q.freshness(s.usage, s.as_of), sql(
        "usage", f"""SELECT 'usage' AS table_name, d AS latest_date, n AS days_behind, {FRESH} AS status, CASE WHEN n <= 2 THEN 'Data is fresh' WHEN n <= 5 THEN 'Data is 3-5 days old' ELSE 'Data is more than 5 days old' END AS message
 FROM (SELECT MAX(usage_date) AS d, {days('MAX(usage_date)', AS_OF)} AS n FROM usage WHERE record_type = 'ORIGINAL' AND usage_date <= {AS_OF})""")),
    Query("freshness_pair", lambda s: q.freshness_pair(s.usage, s.as_of), sql(
        "usage", f"SELECT unnest(['Consumption', 'Metrics']) AS source, d AS latest_date, CASE WHEN {days('d', AS_OF)} <= 2 THEN 'True' ELSE 'False' END AS verified FROM (SELECT MAX(usage_date) AS d FROM usage WHERE usage_date <= {AS_OF})")),
    Query("table_freshness", _table_freshness, sql(
        "burndown spent ss", f"""SELECT 'contract_burndown' AS table_name, d AS latest_data, n AS days_stale, {FRESH} AS status FROM (SELECT MAX(usage_date) AS d, {days('MAX(usage_date)', AS_OF)} AS n FROM burndown)
 UNION ALL SELECT 'contract_forecast', d, n, CASE WHEN n <= 7 THEN 'OK' WHEN n <= 14 THEN 'WARNING' ELSE 'CRITICAL - Retrain needed' END FROM (SELECT MAX(last_date) AS d, {days('MAX(last_date)', AS_OF)} AS n FROM spent)
 UNION ALL SELECT 'scenario_summary', {ago(9)}, 9, 'WARNING - Re-run What-If' FROM (SELECT COUNT(*) FROM ss)""")),
    Query("missing_days", _missing, sql(
        "usage", f"SELECT CAST(d AS DATE) AS missing_date FROM generate_series(DATE '1994-12-01', {ago(1)}, INTERVAL 1 DAY) t(d) WHERE CAST(d AS DATE) NOT IN (SELECT usage_date FROM usage)")),
    Query("cumulative_consistency", _broken_burndown, sql(
        "burndown", f"""SELECT contract_id, usage_date, {num('daily_cost')}, {rn('cumulative_cost + n')} AS cumulative_cost, {rn('cumulative_cost')} AS calculated_cumulative, CAST(n AS DOUBLE) AS discrepancy
 FROM (SELECT *, {days('usage_date', AS_OF)} AS n FROM burndown WHERE dayofweek(usage_date) = 1) WHERE n > 0""")),
    Query("burndown_coverage", lambda s: q.burndown_coverage(s.burndown, s.contracts, s.dashboard), sql(
        "burndown contracts dashboard", f"""SELECT 'Contract Coverage' AS check_type, COUNT(DISTINCT contract_id) AS contract_count, COUNT(*) AS total_data_points, MIN(usage_date) AS earliest_date, MAX(usage_date) AS latest_date, {days('MIN(usage_date)', 'MAX(usage_date)')} AS days_of_data FROM burndown
 UNION ALL SELECT 'Contracts Without Data', COUNT(*), NULL, NULL, NULL, NULL FROM contracts c WHERE status = 'ACTIVE' AND NOT EXISTS (SELECT 1 FROM burndown b WHERE b.contract_id = c.contract_id)
 UNION ALL SELECT 'Dashboard Data', COUNT(DISTINCT account_id), COUNT(*), MIN(usage_date), MAX(usage_date), {days('MIN(usage_date)', 'MAX(usage_date)')} FROM dashboard""")),
    Query("validate_contracts", lambda s: q.validate_contracts(s.contracts, s.accounts), sql(
        "contracts accounts", """SELECT check_name, n AS issues, n = 0 AS passed FROM (
 SELECT 'contracts_without_metadata' AS check_name, COUNT(*) AS n FROM contracts c LEFT JOIN accounts a ON a.account_id = c.account_id WHERE a.account_id IS NULL
 UNION ALL SELECT 'invalid_date_range', COUNT(*) FROM contracts WHERE end_date <= start_date
 UNION ALL SELECT 'duplicate_contract_id', COUNT(*) FROM (SELECT contract_id FROM contracts GROUP BY contract_id HAVING COUNT(*) > 1)
 UNION ALL SELECT 'missing_required_fields', COUNT(*) FROM accounts WHERE customer_name IS NULL OR account_executive IS NULL OR solutions_architect IS NULL)""")),
    Query("install_report", _install, sql(
        "contracts accounts dashboard burndown forecast kstats", f"""SELECT 'contracts' AS table_name, COUNT(*) AS total_rows, COUNT(DISTINCT contract_id) AS distinct_entities, CAST(NULL AS DATE) AS earliest_date, CAST(NULL AS DATE) AS latest_date, 'OK' AS status FROM contracts
 UNION ALL SELECT 'account_metadata', COUNT(*), COUNT(DISTINCT account_id), {NULL_SPAN}, 'OK' FROM accounts
 UNION ALL SELECT 'dashboard_data', COUNT(*), COUNT(DISTINCT usage_date), MIN(usage_date), MAX(usage_date), 'OK' FROM dashboard
 UNION ALL SELECT 'contract_burndown', COUNT(*), COUNT(DISTINCT contract_id), MIN(usage_date), MAX(usage_date), 'OK' FROM burndown
 UNION ALL SELECT 'contract_forecast', COUNT(*), COUNT(DISTINCT contract_id), MIN(forecast_date), MAX(forecast_date), CASE WHEN MAX(model_version) = 'seasonal' THEN 'OK - Seasonal model active' ELSE 'WARNING - Using linear fallback' END FROM forecast
 UNION ALL SELECT 'auto_commit_recommendations', COUNT(*) * 3, COUNT(DISTINCT account_id), {NULL_SPAN}, 'OK - Recommendations generated' FROM kstats""")),
    Query("validation_suite", _suite, sql(
        "usage accounts contracts dashboard", f"""SELECT check_name, CAST(m AS DOUBLE) AS measure, CASE check_name WHEN 'data_freshness' THEN m <= 5 WHEN 'yesterday_cost' THEN m IS NOT NULL ELSE m > 0 END AS passed FROM (
 SELECT 'usage_last_7_days' AS check_name, CAST(COUNT(*) AS DOUBLE) AS m FROM usage WHERE {last(7)}
 UNION ALL SELECT 'data_freshness', {days('MAX(usage_date)', AS_OF)} FROM usage WHERE record_type = 'ORIGINAL' AND usage_date <= {AS_OF}
 UNION ALL SELECT 'cost_calculation', COUNT(DISTINCT cloud_provider) FROM dashboard WHERE usage_date = {ago(1)} UNION ALL SELECT 'account_metadata', COUNT(*) FROM accounts
 UNION ALL SELECT 'contracts', COUNT(*) FROM contracts UNION ALL SELECT 'dashboard_data', COUNT(*) FROM dashboard
 UNION ALL SELECT 'daily_summary', COUNT(*) FROM (SELECT DISTINCT usage_date, cloud_provider, workspace_id FROM dashboard)
 UNION ALL SELECT 'contract_consumption', COUNT(*) FROM contracts WHERE status = 'ACTIVE' UNION ALL SELECT 'yesterday_cost', {r('SUM(actual_cost)')} FROM dashboard WHERE usage_date = {ago(1)})""")),
    Query("unpriced_skus", _few_prices, sql("usage", f"SELECT sku_name, COUNT(*) AS usage_records FROM usage WHERE {last(7)} AND sku_name LIKE '%STORAGE' GROUP BY sku_name")),
    Query("list_cost_coverage", lambda s: q.list_cost_coverage(s.long_history), sql(
        "long_history", f"SELECT COUNT(*) AS total_records, COUNT(list_cost) AS with_list_cost, COUNT(actual_cost) AS with_actual_cost, {rd(ratio('COUNT(list_cost) * 100', 'COUNT(*)'))} AS list_cost_coverage_pct, {rd(ratio('COUNT(actual_cost) * 100', 'COUNT(*)'))} AS actual_cost_coverage_pct FROM long_history")),
    Query("unpriced_records", lambda s: q.unpriced_records(s.usage, s.prices, s.as_of), sql(
        "usage prices", f"SELECT u.sku_name, COUNT(*) AS usage_records, COUNT(*) FILTER (p.effective_price IS NULL) AS unpriced_records FROM usage u {JOIN} WHERE u.usage_date <= {AS_OF} GROUP BY u.sku_name")),
    Query("row_counts", _counts, sql(
        "contracts accounts burndown forecast dashboard tiers", """SELECT 'contracts' AS table_name, COUNT(*) AS row_count, MIN(start_date) AS min_date, MAX(start_date) AS max_date FROM contracts
 UNION ALL SELECT 'account_metadata', COUNT(*), NULL, NULL FROM accounts UNION ALL SELECT 'contract_burndown', COUNT(*), MIN(usage_date), MAX(usage_date) FROM burndown
 UNION ALL SELECT 'contract_forecast', COUNT(*), MIN(forecast_date), MAX(forecast_date) FROM forecast UNION ALL SELECT 'dashboard_data', COUNT(*), MIN(usage_date), MAX(usage_date) FROM dashboard
 UNION ALL SELECT 'discount_tiers', COUNT(*), NULL, NULL FROM tiers""")),
    Query("price_join_check", lambda s: q.price_join_check(s.usage, s.prices, s.as_of), sql(
        "usage prices", f"SELECT u.sku_name, u.usage_unit, CAST(p.default_price AS DOUBLE) AS default_price, CAST(p.effective_price AS DOUBLE) AS effective_price, COUNT(*) AS record_count FROM usage u {JOIN} WHERE u.usage_date = {ago(1)} AND u.record_type = 'ORIGINAL' GROUP BY ALL")),
    Query("data_availability", lambda s: q.data_availability(s.usage), sql(
        "usage", f"SELECT MIN(usage_date) AS first_date, MAX(usage_date) AS last_date, {days('MIN(usage_date)', 'MAX(usage_date)')} AS total_days FROM usage")),
    Query("stale_metadata", lambda s: q.stale_metadata(s.accounts, s.as_of), sql(
        "accounts", f"SELECT account_id, customer_name, account_executive, solutions_architect, updated_at FROM accounts WHERE updated_at < {ago(90)}")),
    Query("days_per_contract", lambda s: q.days_per_contract(s.burndown), sql("burndown", "SELECT contract_id, COUNT(DISTINCT usage_date) AS days FROM burndown GROUP BY contract_id")),
    Query("price_catalog_stats", lambda s: q.price_catalog_stats(s.prices), sql("prices", "SELECT COUNT(*) AS price_count, COUNT(DISTINCT sku_name) AS unique_skus FROM prices")),
    Query("price_overlap_check", _overlapping, sql(
        "prices", """SELECT sku_name, cloud, usage_unit, CAST(price_start_time AS DATE) AS price_start_time, CAST(price_end_time AS DATE) AS price_end_time, CAST(price_start_time AS DATE) + 10 AS earlier_end
 FROM prices WHERE year(price_start_time) = 1999""")),
]
