"""Commitment sizing queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from meterline.functions.columns import risk_level
from meterline.operators import commitment as k
from meterline.registry.base import AS_OF, Query, ago, days, extend, num, r, rd, rn, sql
from meterline.registry.cost import DAY_JOIN
from meterline.registry.star import Star
from meterline.sources.tiers import TIER_SETS

BEGUN = 180
KEY = "account_id, CAST(duration_years AS BIGINT) AS duration_years"
PROJECTION = "daily_avg historical_total forecasted_total forecasted_daily_avg forecast_lower forecast_upper projected_total projected_lower projected_upper"
ECON = "projected_total commitment discount_rate utilization effective_cost savings_vs_list waste_amount waste_cost net_benefit roi_score"
SCORED = f"{KEY}, CAST(candidate_order AS BIGINT) AS candidate_order, candidate_type, tier_id, tier_name, {num(ECON)}"

extend("acct", "usage prices", f"""
SELECT u.account_id, u.usage_date, CAST(SUM(u.usage_quantity * COALESCE(p.effective_price, p.default_price, 0.5)) AS DOUBLE) AS daily_cost
FROM usage u {DAY_JOIN} WHERE u.usage_date >= {ago(365)} AND u.usage_date < {AS_OF} GROUP BY u.account_id, u.usage_date""")
extend("kstats", "acct", """
SELECT account_id, AVG(daily_cost) AS daily_avg, STDDEV_SAMP(daily_cost) AS daily_std, SUM(daily_cost) AS total, COUNT(*) AS days,
  CASE WHEN COUNT(*) > 7 THEN regr_slope(daily_cost, i) ELSE 0 END AS trend, MIN(usage_date) AS first_day
FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY usage_date) - 1 AS DOUBLE) AS i FROM acct) GROUP BY account_id""")
extend("kfc", "kstats", f"""
SELECT account_id, {AS_OF} + CAST(i + 1 AS INT) AS ds, v AS yhat, GREATEST(v - s, 0) AS lo, v + s AS hi
FROM (SELECT account_id, i, GREATEST(daily_avg + trend * i, 0) AS v, COALESCE(daily_std, 0) AS s FROM kstats, unnest(range(0, 1095)) t(i))""")
extend("proj", "kstats kfc", f"""
SELECT s.account_id, y.d AS duration_years, {AS_OF} AS proposed_start, {AS_OF} + CAST(365 * y.d AS INT) AS proposed_end, s.daily_avg, CAST(0 AS DOUBLE) AS historical_total,
  SUM(f.yhat) AS forecasted_total, AVG(f.yhat) AS forecasted_daily_avg, SUM(f.lo) AS forecast_lower, SUM(f.hi) AS forecast_upper,
  SUM(f.yhat) AS projected_total, SUM(f.lo) AS projected_lower, SUM(f.hi) AS projected_upper
FROM kstats s CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS d) y JOIN kfc f ON f.account_id = s.account_id AND f.ds <= {AS_OF} + CAST(365 * y.d AS INT)
GROUP BY s.account_id, y.d, s.daily_avg""")
extend("cand", "proj tiers", """
SELECT account_id, duration_years, projected_total, 0 AS candidate_order, 'target' AS candidate_type, projected_total / CAST(0.95 AS DOUBLE) AS commitment FROM proj
UNION ALL SELECT account_id, duration_years, projected_total, 1, 'conservative', projected_total FROM proj
UNION ALL SELECT account_id, duration_years, projected_total, 2, 'aggressive', projected_upper / CAST(0.90 AS DOUBLE) FROM proj
UNION ALL SELECT p.account_id, p.duration_years, p.projected_total, t.n * 2 + 1 + e.x, 'tier_boundary', t.low * CASE e.x WHEN 0 THEN CAST(1 AS DOUBLE) ELSE CAST(1.01 AS DOUBLE) END
FROM proj p JOIN (SELECT duration_years, CAST(min_commitment AS DOUBLE) AS low, ROW_NUMBER() OVER (PARTITION BY duration_years ORDER BY min_commitment, tier_id) AS n FROM tiers WHERE min_commitment > 0) t
  ON t.duration_years = p.duration_years CROSS JOIN (SELECT unnest([0, 1]) AS x) e""")
extend("tiered", "cand tiers", """
SELECT c.*, CASE WHEN q.reached THEN q.tier_id END AS tier_id, CASE WHEN q.reached THEN q.tier_name ELSE 'Below minimum' END AS tier_name, CASE WHEN q.reached THEN q.rate ELSE 0 END AS discount_rate
FROM cand c JOIN (
  SELECT c.account_id, c.duration_years, c.candidate_order, t.tier_id, t.tier_name, CAST(t.discount_rate AS DOUBLE) AS rate,
    MAX(CAST(t.min_commitment <= c.commitment AS INT)) OVER (PARTITION BY c.account_id, c.duration_years, c.candidate_order) = 1 AS reached,
    ROW_NUMBER() OVER (PARTITION BY c.account_id, c.duration_years, c.candidate_order
      ORDER BY t.min_commitment <= c.commitment AND (t.max_commitment IS NULL OR c.commitment <= t.max_commitment) DESC, t.discount_rate DESC, t.min_commitment) AS n
  FROM cand c JOIN tiers t ON t.duration_years = c.duration_years) q
ON q.account_id = c.account_id AND q.duration_years = c.duration_years AND q.candidate_order = c.candidate_order AND q.n = 1""")
extend("econ", "tiered", """
SELECT *, savings_vs_list - waste_cost AS net_benefit, (savings_vs_list - waste_cost) / commitment * 100 AS roi_score
FROM (SELECT *, projected_total - effective_cost AS savings_vs_list, waste_amount * (1 - discount_rate) AS waste_cost
  FROM (SELECT *, projected_total / commitment AS utilization, GREATEST(commitment - projected_total, 0) AS waste_amount,
      LEAST(commitment, projected_total) * (1 - discount_rate) + CASE WHEN projected_total > commitment THEN projected_total - commitment ELSE 0 END AS effective_cost
    FROM tiered WHERE commitment > 0))""")
extend("opt", "econ", """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id, duration_years ORDER BY utilization >= 0.95 * 0.9 DESC,
  CASE WHEN utilization >= 0.95 * 0.9 THEN ROUND(net_benefit, 4) ELSE ROUND(roi_score, 4) END DESC, candidate_order) AS rn FROM econ) WHERE rn = 1""")
extend("alt", "econ opt", """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id, duration_years, alternative ORDER BY CASE alternative WHEN 'aggressive' THEN discount_rate ELSE 0 END DESC, ROUND(net_benefit, 4) DESC, candidate_order) AS rn
  FROM (SELECT e.*, CASE WHEN e.commitment < o.commitment * 0.95 AND e.utilization > o.utilization THEN 'conservative'
      WHEN e.commitment > o.commitment * 1.05 AND e.discount_rate >= o.discount_rate THEN 'aggressive' END AS alternative
    FROM econ e JOIN opt o ON o.account_id = e.account_id AND o.duration_years = e.duration_years WHERE ROUND(e.net_benefit, 4) > 0) WHERE alternative IS NOT NULL) WHERE rn = 1""")
extend("rec", "proj kstats opt alt", f"""
SELECT sha256(p.account_id || '|' || p.duration_years || '|2001-06-30') AS recommendation_id, p.account_id, {AS_OF} AS analysis_date, {AS_OF} - 365 AS historical_start, {AS_OF} AS historical_end, p.proposed_start, p.proposed_end,
  p.duration_years, s.daily_avg AS historical_daily_avg, p.historical_total, p.forecasted_daily_avg, p.forecasted_total, p.projected_total, o.commitment AS optimal_commitment,
  o.discount_rate AS optimal_discount_rate, o.tier_name AS optimal_tier_name, o.utilization * 100 AS optimal_utilization_pct, p.projected_total AS list_price_total, o.effective_cost AS committed_price_total,
  o.savings_vs_list AS total_savings, o.savings_vs_list / p.projected_total * 100 AS savings_pct, c.commitment AS conservative_commitment, c.discount_rate AS conservative_discount_rate,
  a.commitment AS aggressive_commitment, a.discount_rate AS aggressive_discount_rate
FROM proj p JOIN kstats s ON s.account_id = p.account_id JOIN opt o ON o.account_id = p.account_id AND o.duration_years = p.duration_years
LEFT JOIN alt c ON c.account_id = p.account_id AND c.duration_years = p.duration_years AND c.alternative = 'conservative'
LEFT JOIN alt a ON a.account_id = p.account_id AND a.duration_years = p.duration_years AND a.alternative = 'aggressive'""")

REC_DATES = "recommendation_id, account_id, analysis_date, historical_start, historical_end, proposed_start, proposed_end, CAST(duration_years AS BIGINT) AS duration_years, optimal_tier_name"
REC_NUM = num("historical_daily_avg historical_total forecasted_daily_avg forecasted_total projected_total optimal_commitment optimal_discount_rate optimal_utilization_pct list_price_total "
              "committed_price_total total_savings savings_pct conservative_commitment conservative_discount_rate aggressive_commitment aggressive_discount_rate")
REC = f"SELECT {REC_DATES}, {REC_NUM}, 'linear_fallback' AS model_used, CAST(0.5 AS DOUBLE) AS confidence_level, 'ACTIVE' AS status FROM rec"

GRID = [(float(low), year, pct / 100) for (_, low, _), rates in zip(TIER_SETS["default"].bands, TIER_SETS["default"].rates) for year, pct in enumerate(rates[:3], start=1)]
# The same grid, written out for the SQL.
GRID_SQL = """
  (0, 50000.0, 1, CAST(0.05 AS DOUBLE)), (1, 50000.0, 2, CAST(0.08 AS DOUBLE)), (2, 50000.0, 3, CAST(0.1 AS DOUBLE)), (3, 100000.0, 1, CAST(0.1 AS DOUBLE)), (4,
  100000.0, 2, CAST(0.15 AS DOUBLE)), (5, 100000.0, 3, CAST(0.18 AS DOUBLE)), (6, 250000.0, 1, CAST(0.15 AS DOUBLE)), (7, 250000.0, 2, CAST(0.2 AS DOUBLE)), (8,
  250000.0, 3, CAST(0.25 AS DOUBLE)), (9, 500000.0, 1, CAST(0.2 AS DOUBLE)), (10, 500000.0, 2, CAST(0.25 AS DOUBLE)), (11, 500000.0, 3, CAST(0.3 AS DOUBLE)), (12,
  1000000.0, 1, CAST(0.25 AS DOUBLE)), (13, 1000000.0, 2, CAST(0.3 AS DOUBLE)), (14, 1000000.0, 3, CAST(0.35 AS DOUBLE)), (15, 5000000.0, 1, CAST(0.3 AS DOUBLE)),
  (16, 5000000.0, 2, CAST(0.35 AS DOUBLE)), (17, 5000000.0, 3, CAST(0.4 AS DOUBLE))"""


def _annual(s: Star):
    return s.account_daily.groupBy("account_id").agg((F.avg("daily_cost") * 365).alias("annual"))


def _risk(s: Star):
    return s.commitment.scored.select("account_id", "duration_years", "candidate_order", risk_level(F.col("utilization")).alias("risk_level"))


def _begun(s: Star):
    """Terms that began half a year before ``as_of``: part history, part forecast."""
    return k.contract_horizon(s.commitment.stats, s.as_of - timedelta(days=BEGUN), (1, 2, 3), s.as_of)


def _horizons(s: Star):
    return s.commitment.horizon.unionByName(_begun(s))


def _projected(s: Star):
    project = lambda horizon: k.projected_consumption(s.account_daily, s.commitment.stats, horizon, s.commitment.forecast, s.as_of)
    return project(s.commitment.horizon).unionByName(project(_begun(s)))


def _details(s: Star):
    detail = lambda horizon: k.commitment_forecast_detail(s.account_daily, s.commitment.forecast, horizon, s.as_of)
    return detail(s.commitment.horizon).withColumn("begun", F.lit(False)).unionByName(detail(_begun(s)).withColumn("begun", F.lit(True)))


def _older(s: Star):
    """Two runs of the analysis, a week apart, so that the latest has to be found."""
    fresh = s.commitment.recommendations
    return fresh.unionByName(fresh.withColumn("analysis_date", F.date_sub("analysis_date", 7)))


QUERIES = [
    Query("consumption_stats", lambda s: s.commitment.stats, sql("kstats", f"SELECT account_id, days, first_day, {num('daily_avg daily_std total trend')} FROM kstats")),
    Query("contract_horizon", _horizons, sql(
        "acct", f"""SELECT account_id, CAST(d AS BIGINT) AS duration_years, CAST({AS_OF} - p AS DATE) AS proposed_start, CAST({AS_OF} - p + CAST(365 * d AS INT) AS DATE) AS proposed_end, CAST(p AS BIGINT) AS historical_days, CAST(365 * d - p AS BIGINT) AS forecast_days
 FROM (SELECT DISTINCT account_id FROM acct), unnest([1, 2, 3]) t(d), unnest([0, {BEGUN}]) u(p)""")),
    Query("projected_consumption", _projected, sql("proj acct kfc kstats", f"""SELECT {KEY}, proposed_start, proposed_end, {num(PROJECTION)} FROM proj
 UNION ALL SELECT {KEY}, proposed_start, proposed_end, {num(PROJECTION)} FROM (
  SELECT s.account_id, y.d AS duration_years, {AS_OF} - {BEGUN} AS proposed_start, {AS_OF} - {BEGUN} + CAST(365 * y.d AS INT) AS proposed_end, s.daily_avg, h.t AS historical_total, SUM(f.yhat) AS forecasted_total,
   AVG(f.yhat) AS forecasted_daily_avg, SUM(f.lo) AS forecast_lower, SUM(f.hi) AS forecast_upper, h.t + SUM(f.yhat) AS projected_total, h.t + SUM(f.lo) AS projected_lower, h.t + SUM(f.hi) AS projected_upper
  FROM kstats s CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS d) y JOIN kfc f ON f.account_id = s.account_id AND f.ds <= {AS_OF} - {BEGUN} + CAST(365 * y.d AS INT)
  JOIN (SELECT k.account_id, COALESCE(SUM(a.daily_cost), 0) + MAX(GREATEST({days(f"{AS_OF} - {BEGUN}", 'k.first_day')}, 0) * k.daily_avg) AS t FROM kstats k
   LEFT JOIN acct a ON a.account_id = k.account_id AND a.usage_date >= {AS_OF} - {BEGUN} GROUP BY k.account_id) h ON h.account_id = s.account_id GROUP BY s.account_id, y.d, s.daily_avg, h.t)""")),
    Query("commitment_candidates", lambda s: s.commitment.candidates, sql(
        "cand", f"SELECT {KEY}, CAST(candidate_order AS BIGINT) AS candidate_order, candidate_type, {num('projected_total commitment')} FROM cand WHERE commitment > 0")),
    Query("best_tier", lambda s: k.best_tier(s.commitment.candidates, s.commitment.tiers), sql(
        "tiered", f"SELECT {KEY}, CAST(candidate_order AS BIGINT) AS candidate_order, candidate_type, tier_id, tier_name, {num('projected_total commitment discount_rate')} FROM tiered WHERE commitment > 0")),
    Query("commitment_economics", lambda s: k.commitment_economics(k.best_tier(s.commitment.candidates, s.commitment.tiers)), sql("econ", f"SELECT {SCORED} FROM econ")),
    Query("optimal_commitment", lambda s: s.commitment.optimal, sql("opt", f"SELECT {SCORED} FROM opt")),
    Query("alternatives", lambda s: s.commitment.alternatives, sql("alt", f"SELECT {SCORED}, alternative FROM alt")),
    Query("risk_level", _risk, sql("econ", f"SELECT {KEY}, CAST(candidate_order AS BIGINT) AS candidate_order, CASE WHEN ROUND(utilization, 9) >= 0.95 THEN 'LOW' WHEN ROUND(utilization, 9) >= 0.85 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM econ")),
    Query("commitment_recommendations", lambda s: s.commitment.recommendations, sql("rec", REC)),
    Query("commitment_scenarios", lambda s: k.commitment_scenarios(s.commitment.scored, s.commitment.optimal, s.commitment.alternatives), sql(
        "econ rec", f"""SELECT e.account_id, CAST(e.duration_years AS BIGINT) AS duration_years, CAST(e.candidate_order AS BIGINT) AS candidate_order, {rn('e.commitment')} AS commitment_amount, e.tier_id AS discount_tier_id, e.tier_name AS discount_tier_name,
 {num('e.discount_rate e.effective_cost e.savings_vs_list e.waste_amount e.net_benefit e.roi_score')}, {rn('e.projected_total')} AS projected_consumption, {rn('e.utilization * 100')} AS utilization_pct, {rn('e.savings_vs_list')} AS savings_vs_baseline,
 COALESCE(e.commitment = r.optimal_commitment, FALSE) AS is_optimal, COALESCE(e.commitment = r.conservative_commitment, FALSE) AS is_conservative, COALESCE(e.commitment = r.aggressive_commitment, FALSE) AS is_aggressive,
 CASE WHEN ROUND(e.utilization, 9) >= 0.95 THEN 'LOW' WHEN ROUND(e.utilization, 9) >= 0.85 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM econ e JOIN rec r ON r.account_id = e.account_id AND r.duration_years = e.duration_years""")),
    Query("latest_recommendation", lambda s: k.latest_recommendation(_older(s)), sql("rec", REC)),
    Query("recommendation_summary", lambda s: k.recommendation_summary(_older(s), s.accounts), sql(
        "rec accounts", f"""SELECT r.recommendation_id, r.account_id, a.customer_name, r.analysis_date, CAST(r.duration_years AS BIGINT) AS duration_years, r.proposed_start, r.proposed_end, {num('r.historical_daily_avg r.forecasted_daily_avg r.projected_total r.optimal_commitment r.optimal_discount_rate')},
 CAST(CAST(ROUND(r.optimal_discount_rate * 100) AS INT) AS VARCHAR) || '%' AS discount_display, r.optimal_tier_name, {num('r.optimal_utilization_pct r.total_savings r.savings_pct r.conservative_commitment r.aggressive_commitment')},
 'linear_fallback' AS model_used, CAST(0.5 AS DOUBLE) AS confidence_level, 'ACTIVE' AS status FROM rec r LEFT JOIN accounts a ON a.account_id = r.account_id""")),
    Query("auto_total_value", lambda s: k.auto_total_value(s.contracts, s.account_daily, s.as_of), sql(
        "contracts kstats", f"""SELECT contract_id, account_id, start_date, end_date, CASE WHEN MAX(daily_avg) IS NULL THEN 10000 ELSE GREATEST(round_even((MAX(past) * MAX(daily_avg) + SUM(CASE WHEN i >= 0 THEN GREATEST(daily_avg + trend * (past + i), 0) ELSE 0 END)) / CAST(0.95 AS DOUBLE) / 1000, 0) * 1000, 1000) END AS auto_total_value
 FROM (SELECT *, unnest(range(-1, CAST(len - past AS BIGINT))) AS i FROM (SELECT c.contract_id, c.account_id, c.start_date, c.end_date, s.daily_avg, s.trend, {days('c.start_date', 'c.end_date')} AS len,
   GREATEST(LEAST({days('c.start_date', AS_OF)}, {days('c.start_date', 'c.end_date')}), 0) AS past FROM contracts c LEFT JOIN kstats s ON s.account_id = c.account_id)) GROUP BY contract_id, account_id, start_date, end_date""")),
    Query("commitment_forecast_detail", _details, sql(
        "kfc acct", f"""SELECT account_id, d AS duration_years, ds AS forecast_date, {rn('y')} AS daily_cost, {rn('lo')} AS lower_bound, {rn('hi')} AS upper_bound, past AS is_historical, p > 0 AS begun,
 {rn('SUM(y) OVER (PARTITION BY account_id, d, p ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS cumulative_cost
 FROM (SELECT account_id, ds, yhat AS y, lo, hi, FALSE AS past FROM kfc UNION ALL SELECT account_id, usage_date, daily_cost, daily_cost, daily_cost, TRUE FROM acct),
  (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS d), unnest([0, {BEGUN}]) u(p)
 WHERE ds >= {AS_OF} - p AND ds <= {AS_OF} - p + CAST(365 * d AS INT)""")),
    Query("commitment_search", lambda s: k.commitment_search(_annual(s), GRID), sql(
        "acct", f"""SELECT account_id, CAST(duration AS BIGINT) AS duration, {num('annual commitment discount_rate total_savings utilization savings_per_dollar_committed')}
 FROM (SELECT *, total_savings / (commitment * duration) AS savings_per_dollar_committed, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY utilization >= 0.85 DESC, CASE WHEN utilization >= 0.85 THEN ROUND(total_savings, 4) ELSE -commitment END DESC, n) AS rn
  FROM (SELECT account_id, annual, n, CAST(commitment AS DOUBLE) AS commitment, duration, discount_rate, annual * (1 - discount_rate) / commitment AS utilization, (annual - GREATEST(annual * (1 - discount_rate), commitment)) * duration AS total_savings
   FROM (SELECT account_id, AVG(daily_cost) * 365 AS annual FROM acct GROUP BY account_id) CROSS JOIN (VALUES {GRID_SQL}) g(n, commitment, duration, discount_rate))) WHERE rn = 1""")),
]
