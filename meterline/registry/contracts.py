"""Contract burndown, pace and status queries."""

from __future__ import annotations

from meterline.functions.columns import pace_status, projected_end_date
from meterline.operators import contracts as c
from meterline.registry.base import AS_OF, Query, ago, days, grouped, half_even, last, month, num, r, ratio, rd, rn, sql
from meterline.registry.star import Star

from pyspark.sql import functions as F

MONEY = "daily_cost cumulative_cost remaining_budget commitment projected_linear_burn time_pct_complete budget_pct_consumed"


def joined(select: str, end: str = "c.end_date", where: str = "c.status = 'ACTIVE'") -> str:
    return f"""SELECT {select} FROM (SELECT c.contract_id, c.cloud_provider, c.start_date, c.end_date, c.total_value, SUM(d.actual_cost) AS consumed,
  SUM(d.list_cost) AS list_consumed, MIN(d.usage_date) AS earliest_usage, MAX(d.usage_date) AS latest_usage, COUNT(d.usage_date) AS data_points
 FROM contracts c LEFT JOIN long_history d ON d.account_id = c.account_id AND d.cloud_provider = c.cloud_provider
 AND d.usage_date BETWEEN c.start_date AND {end} WHERE {where}
 GROUP BY c.contract_id, c.cloud_provider, c.start_date, c.end_date, c.total_value) c"""


ELAPSED = days("c.start_date", AS_OF)
TERM = days("c.start_date", "c.end_date")
SHARES = joined(f"c.contract_id, c.total_value, c.start_date, c.end_date, c.consumed, {ratio('c.consumed', 'c.total_value')} AS sp, {ratio(ELAPSED, TERM)} AS el", AS_OF)
LABEL = f"contract_id || ' (USD ' || {grouped('commitment')} || ')'"


def pct(x: str, digits: int = 1) -> str:
    return rd(f"{x} * 100", digits)


def _pace_points(s: Star):
    share = F.col("days_elapsed") * 100.0 / F.nullif(F.col("total_contract_days"), F.lit(0))
    return s.burndown.select("contract_id", "usage_date", pace_status(F.col("budget_pct_consumed"), share).alias("pace_status"))


def _projected(s: Star):
    end = projected_end_date(F.col("start_date"), F.col("commitment"), F.col("days_elapsed"), F.col("cumulative_cost"), F.col("end_date"))
    return s.burndown.select("contract_id", "usage_date", end.alias("projected_end_date"))


QUERIES = [
    Query("contract_burndown", lambda s: c.contract_burndown(s.contracts, s.long_history, s.as_of), sql(
        "burndown", f"SELECT contract_id, cloud_provider, start_date, end_date, currency, commitment_type, notes, usage_date, days_elapsed, total_contract_days, {num(MONEY)} FROM burndown")),
    Query("burndown_summary", lambda s: c.burndown_summary(c.contract_burndown(s.contracts, s.long_history, s.as_of), s.as_of), sql(
        "summary", f"SELECT contract_id, cloud_provider, start_date, end_date, pace_status, projected_end_date, last_usage_date, days_into_contract, days_remaining, {num('commitment total_consumed budget_remaining consumed_pct')} FROM summary")),
    Query("pace_status", _pace_points, sql("burndown", """SELECT contract_id, usage_date, CASE WHEN b > t * 1.2 THEN 'OVER PACE' WHEN b > t * 1.1 THEN 'ABOVE PACE' WHEN b < t * 0.8 THEN 'UNDER PACE' ELSE 'ON PACE' END AS pace_status
 FROM (SELECT contract_id, usage_date, budget_pct_consumed AS b, days_elapsed * CAST(100 AS DOUBLE) / NULLIF(total_contract_days, 0) AS t FROM burndown)""")),
    Query("projected_end_date", _projected, sql("burndown", """SELECT contract_id, usage_date, LEAST(CASE WHEN cumulative_cost > 0 AND days_elapsed > 0
 THEN start_date + CAST(LEAST(trunc(CAST(commitment AS DOUBLE) * days_elapsed / CAST(cumulative_cost AS DOUBLE)), 200000) AS INT) ELSE end_date END, DATE '2032-12-31') AS projected_end_date FROM burndown""")),
    Query("contract_analysis", lambda s: c.contract_analysis(s.contracts, s.long_history, s.as_of), sql(
        "contracts long_history", f"""SELECT contract_id, cloud_provider, start_date, end_date, CAST(total_value AS DOUBLE) AS total_value, {r('consumed')} AS consumed, {r('total_value - consumed')} AS remaining,
 {pct('sp')} AS consumed_pct, {pct('el')} AS time_elapsed_pct, {days(AS_OF, 'end_date')} AS remaining_days,
 CASE WHEN sp > el * 1.2 THEN 'OVER PACE' WHEN sp > el * 1.1 THEN 'ABOVE PACE' WHEN sp < el * 0.8 THEN 'UNDER PACE' ELSE 'ON PACE' END AS pace_status,
 {AS_OF} + CAST(trunc(CAST(total_value - consumed AS DOUBLE) / NULLIF(CAST(consumed AS DOUBLE) / NULLIF({days('start_date', AS_OF)}, 0), 0)) AS INT) AS projected_end_date
 FROM ({joined(f"c.contract_id, c.cloud_provider, c.start_date, c.end_date, c.total_value, c.consumed, {ratio('c.consumed', 'c.total_value')} AS sp, {ratio(ELAPSED, TERM)} AS el",
                 where=f"c.status = 'ACTIVE' AND c.end_date >= {AS_OF}")})""")),
    Query("consumption_rate", lambda s: c.consumption_rate(s.contracts, s.long_history, s.as_of), sql(
        "contracts long_history", f"SELECT contract_id, CAST(total_value AS DOUBLE) AS total_value, {r('consumed')} AS spent, {pct('sp')} AS pct_consumed, {pct('el')} AS pct_elapsed, CASE WHEN sp > el THEN 'OVER PACE' WHEN sp < el * 0.8 THEN 'UNDER PACE' ELSE 'ON PACE' END AS consumption_status FROM ({SHARES})")),
    Query("contracts_with_consumption", lambda s: c.contracts_with_consumption(s.contracts, s.long_history, s.as_of, "list_cost"), sql(
        "contracts long_history", joined(f"c.cloud_provider AS platform, c.contract_id, c.start_date, c.end_date, CAST(c.total_value AS DOUBLE) AS total_value, {r('COALESCE(c.list_consumed, 0)', 4)} AS consumed, {pct(ratio('COALESCE(c.list_consumed, 0)', 'c.total_value'))} AS consumed_pct"))),
    Query("combined_burndown", lambda s: c.combined_burndown(s.burndown, s.as_of), sql(
        "burndown", f"SELECT usage_date AS date, CAST(SUM(commitment) AS DOUBLE) AS total_commitment, {r('SUM(cumulative_cost)', 4)} AS total_consumption, {pct(ratio('SUM(cumulative_cost)', 'SUM(commitment)'))} AS overall_pct_consumed FROM burndown WHERE {last(365)} GROUP BY usage_date")),
    Query("burndown_chart", lambda s: c.burndown_chart(s.burndown, s.as_of), sql(
        "burndown", f"SELECT contract_id, {LABEL} AS contract_label, usage_date AS date, {r('cumulative_cost')} AS actual_consumption, {rd('projected_linear_burn')} AS ideal_consumption, CAST(commitment AS DOUBLE) AS contract_value, {r('remaining_budget')} AS remaining_budget, {rd('budget_pct_consumed', 1)} AS pct_consumed FROM burndown WHERE {last(180)}")),
    Query("contract_summary_table", lambda s: c.contract_summary_table(s.summary), sql(
        "summary", f"""SELECT contract_id, cloud_provider, start_date, end_date, 'USD ' || {grouped('commitment')} AS total_value, 'USD ' || {grouped(half_even('total_consumed'), 2)} AS consumed,
 'USD ' || {grouped(half_even('budget_remaining'), 2)} AS remaining, CAST({rd('consumed_pct', 1)} AS VARCHAR) || '%' AS pct_consumed, pace_status, days_remaining AS days_left, projected_end_date AS projected_end FROM summary""")),
    Query("daily_consumption", lambda s: c.daily_consumption(s.burndown, s.as_of), sql(
        "burndown", f"SELECT usage_date AS date, {r('SUM(daily_cost)')} AS daily_cost, COUNT(DISTINCT contract_id) AS active_contracts FROM burndown WHERE usage_date = {ago(1)} GROUP BY usage_date")),
    Query("pace_distribution", lambda s: c.pace_distribution(s.summary), sql(
        "summary", f"SELECT pace_status, COUNT(*) AS contract_count, {rd('AVG(consumed_pct)', 1)} AS avg_consumed_pct, {rd('AVG(days_remaining)', 0)} AS avg_days_remaining FROM summary GROUP BY pace_status")),
    Query("contract_monthly", lambda s: c.contract_monthly(s.burndown, s.as_of), sql(
        "burndown", f"SELECT {month('usage_date')} AS month, contract_id, {r('SUM(daily_cost)', 4)} AS monthly_cost, COUNT(*) AS days_active FROM burndown WHERE {last(365)} GROUP BY ALL")),
    Query("budget_health", lambda s: c.budget_health(s.summary), sql(
        "summary", f"""SELECT contract_id, CAST(commitment AS DOUBLE) AS value, {r('total_consumed')} AS spent, {rd('consumed_pct', 1)} AS pct_used, pace_status, days_remaining, {days('end_date', 'projected_end_date')} AS days_variance,
 CASE WHEN projected_end_date < end_date THEN 'Will deplete early' WHEN projected_end_date > end_date THEN 'Under budget' ELSE 'On track' END AS budget_health,
 projected_end_date AS est_depletion_date, end_date AS contract_end_date FROM summary""")),
    Query("expiring_contracts", lambda s: c.expiring_contracts(s.contracts, s.as_of, 190), sql(
        "contracts", f"""SELECT contract_id, CAST(total_value AS DOUBLE) AS total_value, end_date, n AS days_remaining, CASE WHEN n <= 30 THEN 'URGENT' WHEN n <= 60 THEN 'SOON' WHEN n <= 90 THEN 'UPCOMING' ELSE 'OK' END AS urgency
 FROM (SELECT *, {days(AS_OF, 'end_date')} AS n FROM contracts WHERE status = 'ACTIVE') WHERE n <= 190""")),
    Query("near_completion", lambda s: c.near_completion(s.summary), sql(
        "summary", f"SELECT contract_id, {rd('consumed_pct', 1)} AS pct_used, days_remaining, pace_status FROM summary WHERE consumed_pct > 80 OR days_remaining < 30")),
    Query("overrun_risk_ranking", lambda s: c.overrun_risk_ranking(s.contracts, s.long_history, s.as_of), sql(
        "contracts long_history", f"SELECT contract_id, {r('consumed')} AS spent, CAST(total_value AS DOUBLE) AS total_value, {pct('sp')} AS pct_consumed, {pct('el')} AS pct_elapsed, CASE WHEN sp > el * 1.2 THEN 'OVERRUN RISK' WHEN sp > el * 1.1 THEN 'MONITOR' ELSE 'ON TRACK' END AS risk_status, {rn('sp / NULLIF(el, 0)')} AS pace_ratio FROM ({SHARES})")),
    Query("daily_pace_status", lambda s: c.daily_pace_status(s.contracts, s.long_history, s.as_of), sql(
        "burndown", f"""SELECT contract_id, usage_date, {r('daily_cost')} AS daily_cost, {r('cumulative_cost')} AS cumulative_cost, CAST(commitment AS DOUBLE) AS commitment, CASE WHEN a > b * 1.2 THEN 'OVER_PACE' WHEN a < b * 0.8 THEN 'UNDER_PACE' ELSE 'ON_PACE' END AS pace_status
 FROM (SELECT *, {ratio('cumulative_cost', 'commitment')} AS a, {ratio('days_elapsed', 'total_contract_days')} AS b FROM burndown)""")),
    Query("rolling_burn_rate_7d", lambda s: c.rolling_burn_rate_7d(s.features), sql(
        "features", f"SELECT contract_id, ds, {r('y', 4)} AS y, {rn(ratio('SUM(y) OVER w', 'COUNT(y) OVER w'))} AS burn_rate_7d FROM features WINDOW w AS (PARTITION BY contract_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")),
    Query("linear_exhaustion", lambda s: c.linear_exhaustion(s.burndown), sql(
        "burndown", f"""SELECT contract_id, CAST(commitment AS DOUBLE) AS commitment, {r('spent')} AS total_spent, {rd('a')} AS avg_daily_spend, {r('commitment - spent')} AS remaining_budget, {rd('(v - s) / a', 1)} AS days_to_exhaustion,
 last_date + CAST(floor((v - s) / a) AS INT) AS projected_exhaustion_date
 FROM (SELECT *, CAST(spent AS DOUBLE) AS s, CAST(commitment AS DOUBLE) AS v, CAST(spent AS DOUBLE) / n AS a FROM (SELECT contract_id, commitment, MAX(cumulative_cost) AS spent, {days('MIN(usage_date)', 'MAX(usage_date)')} AS n, MAX(usage_date) AS last_date FROM burndown GROUP BY ALL)) WHERE n > 0 AND spent > 0""")),
    Query("contract_account_view", lambda s: c.contract_account_view(s.contracts, s.accounts), sql(
        "contracts accounts", """SELECT c.contract_id, c.account_id, a.customer_name, c.cloud_provider, c.start_date, c.end_date, CAST(c.total_value AS DOUBLE) AS total_value, c.status, a.account_executive, a.solutions_architect,
 concat_ws(' > ', a.business_unit_l0, a.business_unit_l1, a.business_unit_l2) AS business_unit FROM contracts c LEFT JOIN accounts a ON a.account_id = c.account_id""")),
    Query("entity_statistics", lambda s: c.entity_statistics(s.contracts, s.accounts), sql(
        "contracts accounts", """SELECT 'Contracts' AS entity, COUNT(*) AS total_records, COUNT(DISTINCT account_id) AS unique_accounts, COUNT(*) FILTER (status = 'ACTIVE') AS active_count,
 COUNT(*) FILTER (status = 'EXPIRED') AS expired_count, COUNT(*) FILTER (status = 'PENDING') AS pending_count, CAST(SUM(total_value) AS DOUBLE) AS total_contract_value FROM contracts
 UNION ALL SELECT 'Account Metadata', COUNT(*), COUNT(DISTINCT account_id), COUNT(DISTINCT business_unit_l0), COUNT(DISTINCT account_executive), COUNT(DISTINCT solutions_architect), NULL FROM accounts""")),
    Query("active_contracts", lambda s: c.active_contracts(s.contracts, s.as_of), sql(
        "contracts", f"SELECT contract_id, cloud_provider, start_date, end_date, CAST(total_value AS DOUBLE) AS total_value, currency, status, {TERM} AS contract_days, {ELAPSED} AS days_elapsed, {days(AS_OF, 'c.end_date')} AS days_remaining, notes FROM contracts c WHERE status = 'ACTIVE'")),
    Query("usage_coverage", lambda s: c.usage_coverage(s.contracts, s.long_history, s.as_of), sql(
        "contracts long_history", joined("c.contract_id, c.start_date, c.end_date, c.earliest_usage, c.latest_usage, c.data_points", where="TRUE"))),
    Query("actual_plus_forecast", lambda s: c.actual_plus_forecast(s.burndown, s.forecast), sql(
        "burndown forecast", f"""SELECT contract_id, usage_date AS date, {r('daily_cost', 4)} AS daily_cost, {r('cumulative_cost', 4)} AS cumulative_cost, 'ACTUAL' AS source FROM burndown
 UNION ALL SELECT f.contract_id, f.forecast_date, {rn('f.predicted_daily_cost')}, {rn('f.predicted_cumulative')}, 'FORECAST' FROM forecast f
 WHERE f.forecast_date > (SELECT MAX(b.usage_date) FROM burndown b WHERE b.contract_id = f.contract_id)""")),
]
