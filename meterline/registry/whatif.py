"""What-if scenario queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.operators import whatif as w
from meterline.registry.base import AS_OF, Query, days, extend, grouped, num, r, ratio, rd, rn, sql
from meterline.registry.star import Star
from meterline.sources.tiers import default_tiers

COMMITMENTS = [100000.0, 250000.0, 500000.0]
WIN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

extend("terms", "contracts", f"""
SELECT contract_id, start_date, end_date, total_value AS value, CAST(LEAST(GREATEST(ROUND({days('start_date', 'end_date')} / CAST(365.0 AS DOUBLE)), 1), 5) AS INT) AS term
FROM contracts WHERE status = 'ACTIVE'""")
extend("rates", "terms tiers", """
SELECT contract_id, value, years, COALESCE(
  (SELECT MAX(discount_rate) FROM tiers t WHERE t.duration_years = years AND t.min_commitment <= value AND (t.max_commitment IS NULL OR t.max_commitment >= value)),
  (SELECT MAX(discount_rate) FROM tiers t WHERE years IN (4, 5) AND t.duration_years = 3 AND t.min_commitment <= value AND (t.max_commitment IS NULL OR t.max_commitment >= value)),
  0.05) AS rate
FROM (SELECT contract_id, value, CAST(unnest([1, 2, 3, 4, 5]) AS INT) AS years FROM terms)""")
extend("sized", "terms rates", """
SELECT t.*, CAST(r.rate * 100 AS DECIMAL(5,2)) AS top FROM terms t JOIN rates r ON r.contract_id = t.contract_id AND r.years = t.term""")
extend("scenarios", "sized rates", """
SELECT sha256(contract_id || '|' || kind || '|' || CAST(pct AS VARCHAR) || '|' || COALESCE(CAST(years AS VARCHAR), '-')) AS scenario_id, contract_id, kind,
  CASE kind WHEN 'extension' THEN 'Extend to ' || years || 'yr (+' || (years - term) || 'yr)' WHEN 'longer' THEN CAST(pct AS INT) || '% (If ' || years || 'yr commit)'
    ELSE CASE WHEN pct = 0 THEN 'Baseline (No Discount)' WHEN pct = top THEN CAST(pct AS INT) || '% Discount (Max for ' || term || 'yr)' ELSE CAST(pct AS INT) || '% Discount' END END AS scenario_name,
  CASE kind WHEN 'extension' THEN 'Runs ' || (years - term) || ' more years, until ' || CAST(start_date + to_years(years) AS DATE) || ', on the same $' || format('{:,.0f}', CAST(value AS DOUBLE)) || ' at ' || CAST(pct AS INT) || '% off'
    WHEN 'longer' THEN 'Rate open to a term of ' || years || ' years (' || CAST(pct - top AS INT) || ' points above the present one)'
    ELSE CASE WHEN pct = 0 THEN 'Pays list price for the usage so far'
      WHEN pct = top THEN 'Best rate of the present term: ' || term || ' years on $' || format('{:,.0f}', CAST(value AS DOUBLE))
      ELSE 'Same term at ' || CAST(pct AS INT) || '% off' END END AS description,
  pct AS discount_pct, value AS adjusted_total_value, CASE WHEN kind = 'extension' THEN start_date END AS adjusted_start_date,
  CASE WHEN kind = 'extension' THEN CAST(start_date + to_years(years) AS DATE) END AS adjusted_end_date, kind = 'regular' AND pct = 0 AS is_baseline,
  kind <> 'regular' OR pct = top AS is_max_for_duration, term AS contract_duration_years, years AS potential_duration_years, end_date
FROM (
  SELECT s.*, 'regular' AS kind, CAST(p AS DECIMAL(5,2)) AS pct, CAST(NULL AS INT) AS years
  FROM sized s, (SELECT contract_id AS cid, unnest(list_distinct(list_append(range(0, CAST(floor(top) AS INT) + 1, 5), CAST(top AS INT)))) AS p FROM sized) g WHERE g.cid = s.contract_id
  UNION ALL SELECT s.*, 'longer', CAST(r.rate * 100 AS DECIMAL(5,2)), r.years FROM sized s JOIN rates r ON r.contract_id = s.contract_id AND r.years > s.term AND r.rate * 100 > s.top AND r.years >= 2
  UNION ALL SELECT s.*, 'extension', CAST(r.rate * 100 AS DECIMAL(5,2)), r.years FROM sized s JOIN rates r ON r.contract_id = s.contract_id AND r.years > s.term AND r.rate * 100 >= s.top AND r.years >= 3)""")
extend("sb", "scenarios burndown", f"""
SELECT scenario_id, contract_id, usage_date, o AS original_daily_cost, cumulative_cost AS original_cumulative, o * k AS simulated_daily_cost,
  SUM(o * k) OVER w AS simulated_cumulative, v AS scenario_commitment, v - SUM(o * k) OVER w AS simulated_remaining, o - o * k AS daily_savings,
  SUM(o - o * k) OVER w AS cumulative_savings
FROM (SELECT s.scenario_id, s.contract_id, b.usage_date, CAST(b.daily_cost AS DECIMAL(20,6)) AS o, b.cumulative_cost, s.adjusted_total_value AS v,
        CAST(1 - s.discount_pct / CAST(100 AS DOUBLE) AS DECIMAL(5,4)) AS k FROM scenarios s JOIN burndown b ON b.contract_id = s.contract_id)
WINDOW w AS (PARTITION BY scenario_id ORDER BY usage_date {WIN})""")
extend("ext", "scenarios burndown", f"""
SELECT scenario_id, contract_id, last_date + CAST(i AS INT) AS usage_date, m AS original_daily_cost, m * k AS simulated_daily_cost, h * k + i * m * k AS simulated_cumulative, v AS scenario_commitment,
  GREATEST(v - (h * k + i * m * k), 0) AS simulated_remaining, m * (1 - k) AS daily_savings, h * (1 - k) + i * m * (1 - k) AS cumulative_savings
FROM (SELECT s.scenario_id, s.contract_id, s.adjusted_end_date, s.adjusted_total_value AS v, CAST(1 - s.discount_pct / CAST(100 AS DOUBLE) AS DECIMAL(5,4)) AS k, t.last_date, t.h, t.m,
        CAST(unnest(range(1, 2500)) AS DECIMAL(5,0)) AS i
      FROM scenarios s JOIN (SELECT contract_id, MAX(usage_date) AS last_date, CAST(SUM(daily_cost) AS DECIMAL(20,6)) AS h,
          CAST(CAST(SUM(daily_cost) FILTER (n <= 90) AS DOUBLE) / COUNT(daily_cost) FILTER (n <= 90) AS DECIMAL(20,10)) AS m
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY contract_id ORDER BY usage_date DESC) AS n FROM burndown) GROUP BY contract_id) t ON t.contract_id = s.contract_id
      WHERE s.kind = 'extension')
WHERE last_date + CAST(i AS INT) <= adjusted_end_date AND h * k + (i - 1) * m * k < v""")
extend("all_sb", "sb ext", """
SELECT scenario_id, contract_id, usage_date, CAST(simulated_daily_cost AS DOUBLE) AS simulated_daily_cost, CAST(simulated_cumulative AS DOUBLE) AS simulated_cumulative,
  CAST(scenario_commitment AS DOUBLE) AS scenario_commitment, CAST(cumulative_savings AS DOUBLE) AS cumulative_savings FROM sb
UNION ALL SELECT scenario_id, contract_id, usage_date, CAST(simulated_daily_cost AS DOUBLE), CAST(simulated_cumulative AS DOUBLE), CAST(scenario_commitment AS DOUBLE), CAST(cumulative_savings AS DOUBLE) FROM ext""")
extend("sf", "scenarios forecast", f"""
SELECT *, MIN(CASE WHEN cu >= v THEN forecast_date END) OVER (PARTITION BY scenario_id) AS p10, MIN(CASE WHEN predicted_cumulative >= v THEN forecast_date END) OVER (PARTITION BY scenario_id) AS p50,
  MIN(CASE WHEN cl >= v THEN forecast_date END) OVER (PARTITION BY scenario_id) AS p90
FROM (SELECT scenario_id, contract_id, forecast_date, d AS predicted_daily_cost, l AS lower_bound, u AS upper_bound, base, original, v, model_version,
        SUM(d) OVER w AS predicted_cumulative, SUM(l) OVER w AS cl, SUM(u) OVER w AS cu
      FROM (SELECT scenario_id, contract_id, forecast_date, v, CAST(predicted_daily_cost AS DECIMAL(24,10)) * k AS d, CAST(lower_bound AS DECIMAL(24,10)) * k AS l, CAST(upper_bound AS DECIMAL(24,10)) * k AS u,
              exhaustion_date_p50 AS base, CAST(predicted_cumulative AS DECIMAL(24,10)) AS original, model_version
            FROM (SELECT s.scenario_id, s.adjusted_total_value AS v, CAST(1 - s.discount_pct / CAST(100 AS DOUBLE) AS DECIMAL(5,4)) AS k, f.* FROM scenarios s JOIN forecast f ON f.contract_id = s.contract_id))
      WINDOW w AS (PARTITION BY scenario_id ORDER BY forecast_date {WIN}))""")
extend("ss", "scenarios contracts sb ext sf", f"""
SELECT *, CASE WHEN actual_cumulative >= break_even_consumption THEN 'ABOVE_BREAKEVEN' WHEN actual_cumulative >= break_even_consumption * 0.8 THEN 'AT_RISK' ELSE 'BELOW_BREAKEVEN' END AS break_even_status,
  CASE WHEN scenario_exhaustion_date IS NULL OR scenario_exhaustion_date > contract_end + 30 THEN 'EXTENDED' WHEN scenario_exhaustion_date < contract_end THEN 'EARLY_EXHAUSTION' ELSE 'ON_TRACK' END AS exhaustion_status
FROM (SELECT s.scenario_id, s.contract_id, s.kind, s.scenario_name, s.description, s.discount_pct, CAST(c.total_value AS DOUBLE) AS base_commitment, c.start_date AS contract_start,
        CASE WHEN s.kind = 'extension' THEN s.adjusted_end_date ELSE c.end_date END AS contract_end, COALESCE(CAST(b.actual AS DOUBLE), 0) AS actual_cumulative,
        CAST(COALESCE(GREATEST(b.sim, e.sim), 0) AS DOUBLE) AS simulated_cumulative, CAST(COALESCE(GREATEST(b.sav, e.sav), 0) AS DOUBLE) AS cumulative_savings, f.base AS baseline_exhaustion_date,
        CASE WHEN s.kind = 'extension' THEN LEAST(b.hit, e.hit) ELSE f.p50 END AS scenario_exhaustion_date,
        CASE WHEN s.kind = 'extension' THEN {days('c.end_date', 's.adjusted_end_date')} ELSE {days('f.base', 'f.p50')} END AS days_extended,
        CAST(c.total_value AS DOUBLE) / (1 - s.discount_pct / CAST(100 AS DOUBLE)) AS break_even_consumption,
        CAST(COALESCE(GREATEST(b.sim, e.sim), 0) * 100 AS DOUBLE) / NULLIF(CAST(c.total_value AS DOUBLE), 0) AS utilization_pct,
        s.contract_duration_years, s.potential_duration_years, s.is_max_for_duration
      FROM scenarios s JOIN contracts c ON c.contract_id = s.contract_id
      LEFT JOIN (SELECT scenario_id, MAX(original_cumulative) AS actual, MAX(simulated_cumulative) AS sim, MAX(cumulative_savings) AS sav,
          MIN(CASE WHEN simulated_cumulative >= scenario_commitment THEN usage_date END) AS hit FROM sb GROUP BY scenario_id) b ON b.scenario_id = s.scenario_id
      LEFT JOIN (SELECT scenario_id, MAX(simulated_cumulative) AS sim, MAX(cumulative_savings) AS sav,
          MIN(CASE WHEN simulated_cumulative >= scenario_commitment THEN usage_date END) AS hit FROM ext GROUP BY scenario_id) e ON e.scenario_id = s.scenario_id
      LEFT JOIN (SELECT scenario_id, MAX(base) AS base, MIN(p50) AS p50 FROM sf GROUP BY scenario_id) f ON f.scenario_id = s.scenario_id)""")
extend("pruned", "ss", """
SELECT * FROM ss a WHERE NOT (a.kind = 'extension' AND EXISTS (SELECT 1 FROM ss b WHERE b.contract_id = a.contract_id AND b.kind = 'extension'
  AND b.potential_duration_years < a.potential_duration_years AND b.utilization_pct >= 100))""")
extend("chosen", "pruned", f"""
SELECT *, CASE WHEN is_sweet_spot THEN CASE mode WHEN 1 THEN '{w.OPTIMAL}' WHEN 2 THEN CASE WHEN contract_duration_years < 5 THEN '{w.SUBOPTIMAL}' ELSE '{w.MAX_DURATION}' END ELSE '{w.RISK}' END END AS strategy_recommendation
FROM (SELECT *, ok AND ROW_NUMBER() OVER (PARTITION BY contract_id ORDER BY ok DESC, discount_pct DESC, kind = 'regular' DESC, potential_duration_years NULLS FIRST, scenario_id) = 1 AS is_sweet_spot
  FROM (SELECT *, kind <> 'longer' AND CASE mode WHEN 1 THEN exhaustion_status = 'ON_TRACK' WHEN 2 THEN exhaustion_status = 'EARLY_EXHAUSTION' ELSE discount_pct = 0 END AS ok
    FROM (SELECT *, CASE WHEN MAX(CAST(kind <> 'longer' AND exhaustion_status = 'ON_TRACK' AS INT)) OVER (PARTITION BY contract_id) = 1 THEN 1
        WHEN MAX(CAST(kind <> 'longer' AND exhaustion_status = 'EARLY_EXHAUSTION' AS INT)) OVER (PARTITION BY contract_id) = 1 THEN 2 ELSE 3 END AS mode FROM pruned)))""")
extend("simple", "ss", """
SELECT *, ROW_NUMBER() OVER (PARTITION BY contract_id ORDER BY CASE WHEN utilization_pct >= 85 OR discount_pct = 0 THEN ROUND(cumulative_savings, 4) ELSE -1 END DESC, discount_pct, kind,
  potential_duration_years NULLS FIRST, scenario_id) = 1 AS is_sweet_spot FROM ss""")
extend("rates_grid", "tiers", f"""
SELECT c.commitment, d.duration, CAST(MAX(t.discount_rate) AS DOUBLE) AS rate FROM (SELECT unnest({COMMITMENTS}) AS commitment) c CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS duration) d
JOIN tiers t ON t.duration_years = d.duration AND t.min_commitment <= c.commitment AND (t.max_commitment IS NULL OR t.max_commitment >= c.commitment) GROUP BY c.commitment, d.duration""")
extend("annual", "dashboard rates_grid", f"""
SELECT g.cloud_provider, g.cost AS on_demand_cost, g.commitment, g.duration, g.rate AS discount_rate, g.cost * (1 - g.rate) AS discounted_annual_cost, g.cost * g.duration AS total_list_cost,
  GREATEST(g.cost * (1 - g.rate) * g.duration, g.commitment) AS total_effective_cost, g.cost * g.duration - GREATEST(g.cost * (1 - g.rate) * g.duration, g.commitment) AS total_savings,
  {rd("g.cost * (1 - g.rate) * g.duration / g.commitment * 100")} AS commitment_utilization_pct,
  CASE WHEN g.cost * (1 - g.rate) * g.duration >= g.commitment THEN 'FULLY UTILIZED' WHEN g.cost * (1 - g.rate) * g.duration >= g.commitment * 0.8 THEN 'WELL UTILIZED' ELSE 'UNDER-UTILIZED' END AS utilization_status
FROM (SELECT s.cloud_provider, s.cost, r.commitment, r.duration, r.rate FROM (SELECT cloud_provider, CAST(SUM(list_cost) AS DOUBLE) * (365 / CAST(GREATEST({days('MIN(usage_date)', 'MAX(usage_date)')}, 1) AS DOUBLE)) AS cost
        FROM dashboard GROUP BY cloud_provider) s CROSS JOIN rates_grid r) g""")
extend("even", "sized spent", """
SELECT z.contract_id AS name, CAST(z.value AS DOUBLE) AS commitment, CAST(z.top AS DOUBLE) / 100 AS discount_rate, CAST(s.spent AS DOUBLE) AS projected FROM sized z JOIN spent s ON s.contract_id = z.contract_id""")


# The published alternative sets, as code, lower and upper edge, and percent for one, two and three years; upper edges touch the next band.
ALTERNATIVES = {
    "market_aligned": "('50K', 50000, 100000, [10, 15, 20]), ('100K', 100000, 250000, [15, 20, 25]), ('250K', 250000, 500000, [20, 27, 33]), ('500K', 500000, 1000000, [25, 32, 37]), ('1M', 1000000, 5000000, [30, 37, 42]), ('5M', 5000000, NULL, [35, 42, 50])",
    "aggressive": "('50K', 50000, 100000, [12, 18, 22]), ('100K', 100000, 250000, [18, 25, 30]), ('250K', 250000, 500000, [25, 32, 38]), ('500K', 500000, 1000000, [30, 37, 43]), ('1M', 1000000, 5000000, [35, 42, 48]), ('5M', 5000000, NULL, [40, 47, 55])",
    "stackable_base": "('50K', 50000, 100000, [8, 12, 15]), ('100K', 100000, 250000, [12, 18, 22]), ('250K', 250000, 500000, [18, 24, 30]), ('500K', 500000, 1000000, [22, 30, 35]), ('1M', 1000000, 5000000, [28, 35, 40]), ('5M', 5000000, NULL, [33, 40, 45])",
}


def _edges(s: Star):
    """Contract values, the edges of all bands and the cents beside them, for one to five years."""
    tenth = [F.lit(x).cast("decimal(18,2)") for x in ("50000", "100000", "250000", "500000", "1000000", "5000000")]
    near = [(e + d).cast("decimal(18,2)") for e in tenth for d in (F.lit("-0.01").cast("decimal(18,2)"), F.lit(0), F.lit("0.01").cast("decimal(18,2)"))]
    return s.contracts.select("contract_id", F.explode(F.array("total_value", *near)).alias("value"))


def _alternative(name: str) -> Query:
    of = "(SELECT MAX(b.pct[{y}]) FROM bands b WHERE b.low <= e.value AND (b.high IS NULL OR b.high >= e.value))"
    text = sql("contracts", f"""SELECT contract_id, CAST(value AS DOUBLE) AS value, CAST(y AS BIGINT) AS years,
 COALESCE(CASE y WHEN 1 THEN {of.format(y=1)} WHEN 2 THEN {of.format(y=2)} ELSE {of.format(y=3)} END, 5) / 100 AS discount_rate
FROM (SELECT contract_id, CAST(unnest(list_concat([total_value], [50000, 100000, 250000, 500000, 1000000, 5000000], [x - 0.01 FOR x IN [50000, 100000, 250000, 500000, 1000000, 5000000]], [x + 0.01 FOR x IN [50000, 100000, 250000, 500000, 1000000, 5000000]])) AS DECIMAL(18,2)) AS value FROM contracts) e,
 unnest([1, 2, 3, 4, 5]) t(y)""").replace("WITH RECURSIVE ", f"WITH RECURSIVE bands(code, low, high, pct) AS (VALUES {ALTERNATIVES[name]}),\n", 1)
    return Query(f"tier_lookup_{name}", lambda s: w.discount_by_duration(_edges(s), default_tiers(s.spark, name)), text)


def _terms(s: Star):
    return w.contract_duration_years(s.contracts.filter("status = 'ACTIVE'")).select(
        "contract_id", F.col("total_value").alias("value"), F.col("duration_years").alias("years")
    )


def _scenario_columns(s: Star):
    return w.generate_scenarios(s.contracts, s.tiers).drop("discount_type", "is_recommended", "status", "created_by")


def _summary(s: Star):
    return w.scenario_summary(s.scenarios, s.contracts, s.scenario_burndown, s.scenario_forecast)


def _chosen(s: Star):
    return w.sweet_spot_strategy(w.drop_redundant_extensions(s.scenario_summary))


def _annual(s: Star):
    return w.annualised_scenarios(s.dashboard, COMMITMENTS, s.tiers)


def _even(s: Star):
    values = _terms(s)
    spent = s.burndown.groupBy("contract_id").agg(F.max("cumulative_cost").cast("double").alias("projected"))
    return w.tier_lookup(values, s.tiers).join(spent, "contract_id").select(
        F.col("contract_id").alias("name"), F.col("value").cast("double").alias("commitment"), F.col("discount_rate").cast("double").alias("discount_rate"), "projected"
    )


def _cases(s: Star):
    spread = lambda f: (F.col("projected") * f)
    return w.three_case_cost(_even(s).withColumn("duration", F.lit(2)).withColumns(
        {"consumption_p10": spread(0.8), "consumption_p50": spread(1.0), "consumption_p90": spread(1.2)}
    ))


def _reach(s: Star):
    reached = w.tier_reach(s.tiers, s.contracts.filter("status = 'ACTIVE'"))
    return w.tier_table(s.tiers).join(reached.select("tier_id", "contracts_in_tier"), "tier_id")


def _estimate(s: Star):
    days_left = s.forecast.groupBy("contract_id").agg(F.max("days_to_exhaustion").alias("baseline_days"))
    return w.days_extended_estimate(s.scenarios.select("scenario_id", "contract_id", "discount_pct").join(days_left, "contract_id"))


HELD = "t.duration_years = k.term AND k.value >= t.min_commitment AND (t.max_commitment IS NULL OR k.value <= t.max_commitment)"
BURN = "original_daily_cost simulated_daily_cost simulated_cumulative scenario_commitment simulated_remaining daily_savings cumulative_savings"
SUMMARY = "contract_id, scenario_id, kind, scenario_name, contract_start, contract_end, baseline_exhaustion_date, scenario_exhaustion_date, days_extended, break_even_status, exhaustion_status, is_max_for_duration"
SUMMARY_NUM = num("discount_pct base_commitment actual_cumulative simulated_cumulative cumulative_savings break_even_consumption utilization_pct")
FULL = f"""{SUMMARY}, {SUMMARY_NUM}, {rn('base_commitment')} AS scenario_commitment, {rn('discount_pct')} AS pct_savings,
 CAST(contract_duration_years AS BIGINT) AS contract_duration_years, CAST(potential_duration_years AS BIGINT) AS potential_duration_years"""
SB_ALL = f"""SELECT scenario_id, contract_id, usage_date, {num(BURN, 5)}, {rn('original_cumulative', 5)} AS original_cumulative, FALSE AS is_projected FROM sb"""
EXT_ALL = f"""SELECT scenario_id, contract_id, usage_date, {num(BURN)}, CAST(NULL AS DOUBLE) AS original_cumulative, TRUE AS is_projected FROM ext"""

QUERIES = [
    Query("active_tiers", lambda s: w.tier_reach(w.active_tiers(s.tiers, s.as_of), s.contracts).select("tier_id", "duration_years", "discount_rate", "contracts_in_tier"), sql(
        "tiers contracts", f"""SELECT t.tier_id, CAST(t.duration_years AS BIGINT) AS duration_years, CAST(t.discount_rate AS DOUBLE) AS discount_rate, COUNT(k.value) AS contracts_in_tier FROM tiers t
 LEFT JOIN (SELECT total_value AS value, LEAST(GREATEST(ROUND({days('start_date', 'end_date')} / CAST(365 AS DOUBLE)), 1), 5) AS term FROM contracts) k ON {HELD} GROUP BY ALL""")),
    Query("tier_lookup", lambda s: w.tier_lookup(_terms(s), s.tiers), sql(
        "sized", "SELECT contract_id, CAST(value AS DOUBLE) AS value, CAST(term AS BIGINT) AS years, CAST(top AS DOUBLE) / 100 AS discount_rate FROM sized")),
    Query("discount_by_duration", lambda s: w.discount_by_duration(_terms(s), s.tiers), sql(
        "rates", "SELECT contract_id, CAST(value AS DOUBLE) AS value, CAST(years AS BIGINT) AS years, CAST(rate AS DOUBLE) AS discount_rate FROM rates")),
    *[_alternative(name) for name in ALTERNATIVES],
    Query("contract_duration_years", lambda s: w.contract_duration_years(s.contracts).select("contract_id", "start_date", "end_date", "duration_years"), sql(
        "contracts", f"SELECT contract_id, start_date, end_date, CAST(LEAST(GREATEST(ROUND({days('start_date', 'end_date')} / CAST(365 AS DOUBLE)), 1), 5) AS BIGINT) AS duration_years FROM contracts")),
    Query("generate_scenarios", _scenario_columns, sql(
        "scenarios", f"""SELECT scenario_id, contract_id, kind, scenario_name, description, {num('discount_pct adjusted_total_value')}, adjusted_start_date, adjusted_end_date, is_baseline, is_max_for_duration,
 CAST(contract_duration_years AS BIGINT) AS contract_duration_years, CAST(potential_duration_years AS BIGINT) AS potential_duration_years FROM scenarios""")),
    Query("scenario_burndown", lambda s: w.scenario_burndown(s.scenarios, s.burndown), sql("sb", SB_ALL), 5),
    Query("extension_projection", lambda s: w.extension_projection(s.scenarios, s.burndown), sql("ext", EXT_ALL)),
    Query("scenario_forecast", lambda s: w.scenario_forecast(s.scenarios, s.forecast, s.contracts), sql(
        "sf", f"""SELECT scenario_id, contract_id, forecast_date, {num('predicted_daily_cost predicted_cumulative lower_bound upper_bound', 3)}, p10 AS exhaustion_date_p10, p50 AS exhaustion_date_p50, p90 AS exhaustion_date_p90,
 CASE WHEN p50 IS NOT NULL THEN GREATEST({days('forecast_date', 'p50')}, 0) END AS days_to_exhaustion, base AS baseline_exhaustion_date, {days('base', 'p50')} AS days_extended,
 CASE WHEN forecast_date <= base THEN {rn('original - predicted_cumulative', 3)} END AS savings_at_exhaustion, model_version FROM sf"""), 3),
    Query("scenario_summary", lambda s: _summary(s).drop("is_sweet_spot"), sql("ss", f"SELECT {FULL} FROM ss")),
    Query("drop_redundant_extensions", lambda s: w.drop_redundant_extensions(s.scenario_summary).drop("is_sweet_spot"), sql("pruned", f"SELECT {FULL} FROM pruned")),
    Query("sweet_spot_strategy", _chosen, sql("chosen", f"SELECT {FULL}, is_sweet_spot, strategy_recommendation FROM chosen")),
    Query("sweet_spot_simple", lambda s: w.sweet_spot_simple(s.scenario_summary), sql("simple", f"SELECT {FULL}, is_sweet_spot FROM simple")),
    Query("scenario_comparison", lambda s: w.scenario_comparison(s.scenarios, _chosen(s)), sql(
        "chosen", f"""SELECT scenario_id, contract_id, scenario_name, kind = 'regular' AND discount_pct = 0 AS is_baseline, FALSE AS is_recommended, {num('discount_pct base_commitment actual_cumulative simulated_cumulative cumulative_savings utilization_pct')},
 {rn('base_commitment')} AS scenario_commitment, {rn('discount_pct')} AS pct_savings, baseline_exhaustion_date, scenario_exhaustion_date, days_extended, is_sweet_spot, exhaustion_status, break_even_status FROM chosen""")),
    Query("scenario_burndown_chart", lambda s: w.scenario_burndown_chart(s.scenarios, s.scenario_burndown), sql(
        "all_sb scenarios", f"""SELECT b.contract_id, b.usage_date, s.scenario_name, CAST(s.discount_pct AS DOUBLE) AS discount_pct, {rn('b.simulated_cumulative', 7)} AS cumulative_cost, CAST(b.scenario_commitment AS DOUBLE) AS commitment,
 {rn('b.cumulative_savings', 7)} AS cumulative_savings, s.is_baseline FROM all_sb b JOIN scenarios s ON s.scenario_id = b.scenario_id"""), 7),
    Query("sweet_spot_recommendation", lambda s: w.sweet_spot_recommendation(_chosen(s)), sql(
        "chosen", f"SELECT contract_id, scenario_id, scenario_name, days_extended, {num('discount_pct cumulative_savings utilization_pct')}, {rn('discount_pct')} AS pct_savings FROM chosen WHERE is_sweet_spot")),
    Query("scenario_report", lambda s: w.scenario_report(s.scenarios, _chosen(s)), sql(
        "chosen", f"""SELECT CASE WHEN kind = 'longer' THEN 'LONGER DURATION' ELSE 'CURRENT DURATION' END AS report_section, contract_id, scenario_name, CAST(discount_pct AS DOUBLE) AS discount_pct, {rd('cumulative_savings')} AS savings_to_date,
 scenario_exhaustion_date, days_extended, {rd('utilization_pct', 1)} AS utilization_pct, exhaustion_status, CASE WHEN is_sweet_spot THEN 'RECOMMENDED' ELSE '' END AS recommendation, CASE WHEN kind = 'longer' THEN description END AS opportunity FROM chosen""")),
    Query("tier_table", _reach, sql(
        "tiers terms", f"""SELECT t.tier_id, t.tier_name, '$' || {grouped('t.min_commitment')} || ' - ' || COALESCE('$' || {grouped('t.max_commitment')}, 'Unlimited') AS commitment_range, CAST(t.duration_years AS BIGINT) AS years,
 CAST(CAST(t.discount_rate * 100 AS INT) AS VARCHAR) || '%' AS discount, COUNT(k.value) AS contracts_in_tier FROM tiers t LEFT JOIN terms k ON {HELD} GROUP BY ALL""")),
    Query("default_tiers", lambda s: w.tier_reach(s.tiers, s.contracts.filter("status = 'ACTIVE'")).select(
        "tier_id", "tier_name", "min_commitment", "max_commitment", "duration_years", "discount_rate", "contracts_in_tier"), sql(
        "tiers terms", f"""SELECT t.tier_id, t.tier_name, CAST(t.min_commitment AS DOUBLE) AS min_commitment, CAST(t.max_commitment AS DOUBLE) AS max_commitment, CAST(t.duration_years AS BIGINT) AS duration_years,
 CAST(t.discount_rate AS DOUBLE) AS discount_rate, COUNT(k.value) AS contracts_in_tier FROM tiers t LEFT JOIN terms k ON {HELD} GROUP BY ALL""")),
    Query("commitment_matrix", lambda s: w.commitment_matrix(s.contracts.select("contract_id", F.col("total_value").alias("commitment"))), sql(
        "contracts", "SELECT contract_id, CAST(total_value AS DOUBLE) AS commitment, CAST(d AS BIGINT) AS duration FROM contracts, unnest([1, 2, 3]) t(d)")),
    Query("annualised_scenarios", _annual, sql("annual", f"SELECT cloud_provider, duration, utilization_status, {num('on_demand_cost commitment discount_rate discounted_annual_cost total_list_cost total_effective_cost total_savings commitment_utilization_pct')} FROM annual")),
    Query("npv_savings", lambda s: w.npv_savings(_annual(s)).select("cloud_provider", "commitment", "duration", "total_savings", "npv_savings"), sql(
        "annual", f"SELECT cloud_provider, duration, {num('commitment total_savings')}, {rn('total_savings / pow(1.05, duration - 1)')} AS npv_savings FROM annual")),
    Query("ranked_scenarios", lambda s: w.ranked_scenarios(_annual(s)).select("cloud_provider", "commitment", "duration", "total_savings", "commitment_utilization_pct", "savings_rank", "recommendation"), sql(
        "annual", f"""SELECT cloud_provider, duration, {num('commitment total_savings commitment_utilization_pct')}, RANK() OVER (PARTITION BY cloud_provider ORDER BY sc DESC) AS savings_rank,
 CASE WHEN ROW_NUMBER() OVER (PARTITION BY cloud_provider ORDER BY sc DESC, commitment, duration) = 1 THEN 'RECOMMENDED' ELSE '' END AS recommendation
 FROM (SELECT *, CASE WHEN commitment_utilization_pct >= 85 THEN ROUND(total_savings, 4) ELSE -1000000 END AS sc FROM annual)""")),
    Query("break_even_table", lambda s: w.break_even_table(_even(s)), sql(
        "even", f"""SELECT name, {num('commitment discount_rate projected')}, {rn('commitment / (1 - discount_rate)')} AS break_even_point, {rn('1 - discount_rate')} AS break_even_utilization,
 {rn('commitment * (1 - discount_rate)')} AS risk_threshold, {rn('projected - commitment / (1 - discount_rate)')} AS safety_margin FROM even""")),
    Query("usage_sensitivity", lambda s: w.usage_sensitivity(_even(s).withColumnRenamed("name", "contract_id")), sql(
        "even", f"""SELECT contract_id, usage_change_pct, discount_pct, {rn('a')} AS adjusted_usage, {rn('a * (1 - discount_pct / 100.0)')} AS discounted_cost, {rn('GREATEST(a * (1 - discount_pct / 100.0), commitment)')} AS effective_cost,
 {rn('a - a * (1 - discount_pct / 100.0)')} AS savings, {rn('a * (1 - discount_pct / 100.0) / commitment * 100')} AS utilization_pct
 FROM (SELECT name AS contract_id, commitment, CAST(u AS BIGINT) AS usage_change_pct, CAST(d AS BIGINT) AS discount_pct, projected * (1 + u / 100.0) AS a FROM even, unnest([-20, -10, 0, 10, 20]) x(u), unnest([0, 5, 10, 15, 20]) y(d))""")),
    Query("discount_lines", lambda s: w.discount_lines(s.forecast), sql(
        "forecast", f"SELECT contract_id, forecast_date AS date, {rn('predicted_cumulative * (1 - p / 100.0)', 3)} AS value, CASE WHEN p = 0 THEN 'Baseline (No Discount)' ELSE p || '% Discount' END AS scenario FROM forecast, unnest([0, 5, 10]) t(p)"), 3),
    Query("three_case_cost", _cases, sql(
        "even", f"""SELECT name, {num('commitment')}, CAST(2 AS BIGINT) AS duration, {rn('projected * 0.8 * 2')} AS total_consumption_low, {rn('GREATEST(projected * 0.8 * 2 * (1 - discount_rate), commitment * 2)')} AS cost_low,
 {rn('projected * 2')} AS total_consumption_med, {rn('GREATEST(projected * 2 * (1 - discount_rate), commitment * 2)')} AS cost_med, {rn('projected * 1.2 * 2')} AS total_consumption_high,
 {rn('projected * 1.2 * 2 * (1 - discount_rate)')} AS cost_high FROM even""")),
    Query("days_extended_estimate", _estimate, sql(
        "scenarios forecast", f"""SELECT s.scenario_id, s.contract_id, CAST(s.discount_pct AS DOUBLE) AS discount_pct, e.days_to_exhaustion AS baseline_days,
 {rn('e.days_to_exhaustion * CAST(s.discount_pct AS DOUBLE) / (100 - CAST(s.discount_pct AS DOUBLE))')} AS days_extended_estimate FROM scenarios s
 JOIN (SELECT contract_id, MAX(days_to_exhaustion) AS days_to_exhaustion FROM forecast GROUP BY contract_id) e ON e.contract_id = s.contract_id""")),
]
