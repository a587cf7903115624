"""Series, forecast and model-quality queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from meterline.operators import forecast as f
from meterline.registry.base import AS_OF, Query, days, extend, last, num, r, ratio, rd, rn, sql
from meterline.registry.star import Star

TERM = "contract_id, account_id, cloud_provider, contract_start, contract_end"
FC = "contract_id, forecast_date, model_version, exhaustion_date_p10, exhaustion_date_p50, exhaustion_date_p90, days_to_exhaustion, beyond_horizon"
FC_MONEY = "predicted_daily_cost lower_bound upper_bound predicted_cumulative"

extend("feature_summary", "features", f"""
SELECT contract_id, cloud_provider, contract_start, contract_end, contract_value, COUNT(*) AS total_days, CAST(SUM(has_actual_data) AS BIGINT) AS days_with_data,
  {rd(ratio('SUM(has_actual_data) * 100', 'COUNT(*)'))} AS data_coverage_pct, MIN(ds) AS first_data_date, MAX(ds) AS last_data_date, {r('SUM(y)')} AS total_spent,
  {rd(ratio('SUM(y)', 'COUNT(*)'))} AS avg_daily_cost, {rd('STDDEV_SAMP(CAST(y AS DOUBLE))')} AS stddev_daily_cost, {r('MAX(y)')} AS max_daily_cost,
  {r('MAX(cumulative_cost)')} AS current_cumulative, {rd(ratio('MAX(cumulative_cost)', 'contract_value') + ' * 100')} AS pct_consumed,
  {r('contract_value - SUM(y)')} AS budget_remaining,
  CASE WHEN SUM(has_actual_data) >= 30 THEN 'READY' WHEN SUM(has_actual_data) >= 14 THEN 'LIMITED' ELSE 'INSUFFICIENT' END AS readiness
FROM features GROUP BY contract_id, cloud_provider, contract_start, contract_end, contract_value""")
extend("series", "features", """
SELECT contract_id, ds, CAST(y AS DOUBLE) AS y, CAST(ROW_NUMBER() OVER (PARTITION BY contract_id ORDER BY ds) - 1 AS DOUBLE) AS i FROM features""")
extend("trend", "series", """
SELECT contract_id, AVG(y) AS m, STDDEV_SAMP(y) AS sd, CASE WHEN COUNT(*) > 7 THEN regr_slope(y, i) ELSE 0 END AS b FROM series GROUP BY contract_id""")
extend("metrics", "series", """
SELECT s.contract_id, COUNT(*) AS training_points, MIN(s.ds) AS training_start_date, MAX(s.ds) AS training_end_date,
  AVG(ABS(s.y - t.m) / s.y) FILTER (s.y > 0) * 100 AS mape, SQRT(AVG((s.y - t.m) * (s.y - t.m))) AS rmse, AVG(ABS(s.y - t.m)) AS mae
FROM series s JOIN (SELECT contract_id, AVG(y) AS m FROM series GROUP BY contract_id) t ON t.contract_id = s.contract_id GROUP BY s.contract_id""")

def _design() -> str:
    """Intercept, trend and the harmonics of 7 days (3), 30.5 days (5) and, from two years on, 365.25 days (10), times the level."""
    columns = ["1.0::DOUBLE", "(x - first_x) / GREATEST(last_x - first_x, 1)"]
    for period, order, span in ((7, 3, 0), (30.5, 5, 0), (365.25, 10, 730)):
        for k in range(1, order + 1):
            weight = f"(CASE WHEN last_x - first_x >= {span} THEN level ELSE 0 END)"
            columns += [f"{weight} * {wave}(2 * pi() * {k} * x / {period})" for wave in ("sin", "cos")]
    return "[" + ", ".join(columns) + "]"


SIZE = 38
extend("past", "features", f"""
SELECT contract_id, ds, CAST(y AS DOUBLE) AS y, contract_end, CAST({days("DATE '1970-01-01'", 'ds')} AS DOUBLE) AS x FROM features WHERE ds <= contract_end""")
extend("lines", "past", """
SELECT contract_id, AVG(y) AS mean, AVG(x) AS center, COALESCE(CASE WHEN COUNT(*) > 1 THEN regr_slope(y, x) END, 0) AS slope, MIN(x) AS first_x, MAX(x) AS last_x, COUNT(*) AS n,
  MAX(ds) AS last, MAX(contract_end) AS contract_end FROM past GROUP BY contract_id""")
extend("design", "past lines", f"""
SELECT contract_id, ds, y, fitted, mean, n, {_design()} AS v
FROM (SELECT l.*, d.ds, d.y, d.x, d.fitted, GREATEST(mean + slope * (d.x - center), mean * 0.1) AS level FROM lines l JOIN (
  SELECT contract_id, ds, y, x, TRUE AS fitted FROM past
  UNION ALL SELECT contract_id, last + CAST(i AS INT), NULL, last_x + i, FALSE
  FROM (SELECT *, unnest(range(1, LEAST(GREATEST({days('last', 'contract_end')}, 0) + 90, 365) + 1)) AS i FROM lines)) d ON d.contract_id = l.contract_id)""")
extend("gram", "design", f"""
SELECT contract_id, i, list(s ORDER BY j) AS line FROM (
  SELECT contract_id, i, j, SUM(v[i] * (CASE WHEN j <= {SIZE} THEN v[j] ELSE y END))
    + CASE WHEN i = j THEN CASE WHEN i <= 2 THEN MAX(n) * 1e-9 ELSE MAX(n) * MAX(mean) * MAX(mean) * 0.01 + 1e-6 END ELSE 0 END AS s
  FROM design, unnest(range(1, {SIZE + 1})) a(i), unnest(range(1, {SIZE + 2})) b(j) WHERE fitted GROUP BY contract_id, i, j) GROUP BY contract_id, i""")
# Elimination by Gauss and Jordan: in step k line k is made one at place k, all others zero there.
extend("eliminated", "gram", f"""
SELECT 0 AS k, contract_id, i, line FROM gram
UNION ALL
SELECT k + 1, contract_id, i, CASE WHEN i = k + 1 THEN [x / head[k + 1] FOR x IN head] ELSE list_transform(list_zip(line, head), lambda z: z[1] - z[2] * line[k + 1] / head[k + 1]) END
FROM (SELECT *, MAX(CASE WHEN i = k + 1 THEN line END) OVER (PARTITION BY contract_id) AS head FROM eliminated) WHERE k < {SIZE}""")
extend("seasonal", "design eliminated", f"""
SELECT contract_id, ds, v AS yhat, v - 1.2816 * sigma AS yhat_lower, v + 1.2816 * sigma AS yhat_upper
FROM (SELECT contract_id, ds, fitted, v, STDDEV_POP(y - v) FILTER (fitted) OVER (PARTITION BY contract_id) AS sigma
  FROM (SELECT d.contract_id, ds, y, fitted, list_dot_product(d.v, b.beta) AS v FROM design d
    JOIN (SELECT contract_id, list(line[{SIZE + 1}] ORDER BY i) AS beta FROM eliminated WHERE k = {SIZE} GROUP BY contract_id) b ON b.contract_id = d.contract_id)) WHERE NOT fitted""")


def _assembled(source: str, model: str, chosen: str) -> str:
    double = lambda x, name: f"CAST({x} AS DOUBLE) AS {name}"
    return f"""
SELECT contract_id, ds AS forecast_date, '{model}' AS model_version, {double('GREATEST(yhat, 0)', 'predicted_daily_cost')}, {double('GREATEST(yhat_lower, 0)', 'lower_bound')}, {double('GREATEST(yhat_upper, 0)', 'upper_bound')},
 p10 AS exhaustion_date_p10, p50 AS exhaustion_date_p50, p90 AS exhaustion_date_p90, CASE WHEN remaining <= 0 THEN 0 ELSE date_diff('day', first_ds, p50) END AS days_to_exhaustion, end_date > last_ds AS beyond_horizon,
 {double('spent + SUM(GREATEST(yhat, 0)) OVER (PARTITION BY contract_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'predicted_cumulative')}
 FROM (SELECT *, MIN(ds) OVER k AS first_ds, MAX(ds) OVER k AS last_ds, MIN(CASE WHEN remaining > 0 AND cu >= remaining THEN ds END) OVER k AS p10, MIN(CASE WHEN remaining > 0 AND cm >= remaining THEN ds END) OVER k AS p50,
   MIN(CASE WHEN remaining > 0 AND cl >= remaining THEN ds END) OVER k AS p90
  FROM (SELECT s.contract_id, s.ds, s.yhat, s.yhat_lower, s.yhat_upper, t.end_date, t.spent, t.value - t.spent AS remaining, SUM(yhat) OVER w AS cm, SUM(yhat_upper) OVER w AS cu, SUM(yhat_lower) OVER w AS cl
   FROM {source} s JOIN spent t ON t.contract_id = s.contract_id WHERE {chosen} WINDOW w AS (PARTITION BY s.contract_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  WINDOW k AS (PARTITION BY contract_id))"""


ENOUGH = "(SELECT contract_id FROM features GROUP BY contract_id HAVING COUNT(*) >= 30)"
extend("forecast", "features seasonal flat spent", _assembled("seasonal", "seasonal", f"s.contract_id IN {ENOUGH}") + "\nUNION ALL" + _assembled("flat", "linear_fallback", f"s.contract_id NOT IN {ENOUGH}"))


def _daily(s: Star):
    return f.contract_daily_costs(s.contracts, s.long_history, s.as_of)


def _trend(s: Star):
    daily = s.features.select("contract_id", F.col("ds").alias("usage_date"), F.col("y").alias("daily_cost"))
    return f.trend_forecast(f.trend_stats(daily, "contract_id"), "contract_id", s.as_of, 90)


def _metrics(s: Star):
    means = s.features.groupBy("contract_id").agg(F.avg(F.col("y").cast("double")).alias("yhat"))
    return f.fit_metrics(s.features, s.features.select("contract_id", "ds").join(means, "contract_id"))


def _registry_rows(s: Star):
    fresh = _metrics(s).select(
        F.concat("contract_id", F.lit("-new")).alias("model_id"), "contract_id", F.lit(s.as_of).alias("trained_at"), "training_points",
        "mape", "rmse",
    )
    older = fresh.withColumns({
        "model_id": F.concat("contract_id", F.lit("-old")), "trained_at": F.lit(s.as_of - timedelta(days=7)), "is_active": F.lit(True)
    })
    return f.model_metrics_table(older, fresh)


def _exhaustion(s: Star):
    return f.exhaustion_dates(f.linear_forecast(s.burndown, s.contracts), f.remaining_budget(s.burndown, s.contracts))


def _band(s: Star):
    return f.cumulative_band(s.forecast, s.burndown)


NEXT_YEAR = f"forecast_date >= {AS_OF} AND forecast_date < {AS_OF} + 365"
RUN = "PARTITION BY f.contract_id ORDER BY f.forecast_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

QUERIES = [
    Query("contract_daily_costs", _daily, sql("contract_days", f"SELECT {TERM}, usage_date, record_count, {num('contract_value daily_cost')} FROM contract_days")),
    Query("date_spine", lambda s: f.date_spine(_daily(s)), sql("features", f"SELECT {TERM}, CAST(contract_value AS DOUBLE) AS contract_value, ds FROM features")),
    Query("forecast_features", lambda s: f.forecast_features(_daily(s)), sql(
        "features", f"SELECT {TERM}, ds, day_of_week, month, quarter, days_elapsed, CAST(has_actual_data AS BIGINT) AS has_actual_data, {num('contract_value y cumulative_cost remaining_budget')} FROM features")),
    Query("forecast_feature_summary", lambda s: f.forecast_feature_summary(s.features), sql(
        "feature_summary", "SELECT * REPLACE (CAST(contract_value AS DOUBLE) AS contract_value) FROM feature_summary")),
    Query("readiness_counts", lambda s: f.readiness_counts(f.forecast_feature_summary(s.features)), sql(
        "feature_summary", "SELECT COUNT(DISTINCT contract_id) AS contracts_prepared, COUNT(*) FILTER (readiness = 'READY') AS ready_for_forecast, COUNT(*) FILTER (readiness = 'LIMITED') AS limited_data, COUNT(*) FILTER (readiness = 'INSUFFICIENT') AS insufficient_data FROM feature_summary")),
    Query("training_gate", lambda s: f.training_gate(s.features), sql(
        "features", "SELECT contract_id, COUNT(*) AS training_points, CASE WHEN COUNT(*) >= 30 THEN 'seasonal' ELSE 'linear_fallback' END AS model_version FROM features GROUP BY contract_id")),
    Query("linear_forecast", lambda s: f.linear_forecast(s.burndown, s.contracts), sql("flat", f"SELECT contract_id, ds, {num('yhat yhat_lower yhat_upper')} FROM flat")),
    Query("trend_forecast", _trend, sql(
        "trend", f"""SELECT contract_id, {AS_OF} + CAST(i + 1 AS INT) AS ds, {rn('v')} AS yhat, {rn('GREATEST(v - sd, 0)')} AS yhat_lower, {rn('v + sd')} AS yhat_upper
 FROM (SELECT contract_id, i, GREATEST(m + b * i, 0) AS v, COALESCE(sd, 0) AS sd FROM trend, unnest(range(0, 90)) t(i))""")),
    Query("seasonal_forecast", lambda s: f.seasonal_forecast(s.features), sql("seasonal", f"SELECT contract_id, ds, {num('yhat yhat_lower yhat_upper')} FROM seasonal")),
    Query("exhaustion_dates", _exhaustion, sql("exhaustion", "SELECT * FROM exhaustion")),
    Query("forecast_output", lambda s: f.forecast_output(s.burndown, s.contracts, s.features), sql("forecast", f"SELECT {FC}, {num(FC_MONEY)} FROM forecast")),
    Query("fit_metrics", _metrics, sql("metrics", f"SELECT contract_id, training_points, training_start_date, training_end_date, {num('mape rmse mae')} FROM metrics")),
    Query("model_metrics_table", _registry_rows, sql(
        "metrics", f"""SELECT contract_id || '-new' AS model_id, contract_id, {AS_OF} AS trained_at, training_points, {num('mape rmse')}, TRUE AS is_active FROM metrics
 UNION ALL SELECT contract_id || '-old', contract_id, {AS_OF} - 7, training_points, {num('mape rmse')}, FALSE FROM metrics""")),
    Query("mape_grade", lambda s: f.graded_metrics(_metrics(s)).select("contract_id", "mape", "grade"), sql(
        "metrics", f"SELECT contract_id, {num('mape')}, CASE WHEN mape < 10 THEN 'excellent' WHEN mape < 20 THEN 'good' WHEN mape < 30 THEN 'acceptable' ELSE 'investigate' END AS grade FROM metrics")),
    Query("forecast_latest", lambda s: f.forecast_latest(s.forecast), sql(
        "forecast", f"SELECT {FC}, {num(FC_MONEY)} FROM forecast f WHERE forecast_date = (SELECT MAX(forecast_date) FROM forecast g WHERE g.contract_id = f.contract_id)")),
    Query("forecast_details", lambda s: f.forecast_details(s.forecast, s.contracts), sql(
        "forecast contracts", f"""SELECT f.contract_id, f.forecast_date, f.model_version, f.exhaustion_date_p10, f.exhaustion_date_p50, f.exhaustion_date_p90, f.days_to_exhaustion, f.beyond_horizon,
 {num(' '.join('f.' + c for c in FC_MONEY.split()))}, c.cloud_provider, c.start_date AS contract_start, c.end_date AS contract_end, CAST(c.total_value AS DOUBLE) AS contract_value,
 CASE WHEN f.exhaustion_date_p50 < c.end_date THEN 'AT RISK' WHEN f.exhaustion_date_p90 < c.end_date THEN 'WATCH'
   WHEN f.beyond_horizon AND f.exhaustion_date_p90 IS NULL AND COALESCE(f.days_to_exhaustion, 1) <> 0 THEN 'BEYOND HORIZON' ELSE 'ON TRACK' END AS forecast_status
 FROM forecast f JOIN contracts c ON c.contract_id = f.contract_id WHERE c.status = 'ACTIVE'""")),
    Query("forecast_summary", lambda s: f.forecast_summary(s.forecast, s.contracts), sql(
        "forecast contracts", """SELECT f.contract_id, CAST(c.total_value AS DOUBLE) AS contract_value, MAX(f.forecast_date) AS forecast_through, MAX(f.exhaustion_date_p10) AS exhaustion_optimistic,
 MAX(f.exhaustion_date_p50) AS exhaustion_median, MAX(f.exhaustion_date_p90) AS exhaustion_conservative, MAX(f.days_to_exhaustion) AS days_to_exhaustion, MAX(f.model_version) AS model_type
 FROM forecast f JOIN contracts c ON c.contract_id = f.contract_id GROUP BY ALL""")),
    # As in the other running totals of forecasts, three digits: the model is solved by two methods, and a year of doubles is added up.
    Query("cumulative_band", _band, sql(
        "forecast spent", f"""SELECT f.contract_id, f.forecast_date, {rn('f.predicted_cumulative', 3)} AS predicted_cumulative, {rn(f'CAST(s.spent AS DOUBLE) + SUM(f.lower_bound) OVER ({RUN})', 3)} AS cumulative_lower,
 {rn(f'CAST(s.spent AS DOUBLE) + SUM(f.upper_bound) OVER ({RUN})', 3)} AS cumulative_upper FROM forecast f JOIN spent s ON s.contract_id = f.contract_id"""), 3),
    Query("projection_30_365", lambda s: f.projection_30_365(s.dashboard, s.as_of), sql(
        "dashboard", f"SELECT {rd('m')} AS avg_daily_cost, {rd('m * 30')} AS projected_30_day_cost, {rd('m * 365')} AS projected_annual_cost FROM (SELECT {ratio('SUM(c)', 'COUNT(c)')} AS m FROM (SELECT SUM(actual_cost) AS c FROM dashboard WHERE {last(30)} GROUP BY usage_date))")),
    Query("annual_forecast", lambda s: f.annual_forecast(s.forecast, s.as_of), sql(
        "forecast", f"""SELECT contract_id, {rd('AVG(predicted_daily_cost)')} AS avg_daily_forecast, {rd('AVG(predicted_daily_cost) * 365')} AS annual_forecast, {rd('SUM(predicted_daily_cost) * 365 / COUNT(*)')} AS median,
 {rd('SUM(lower_bound) * 365 / COUNT(*)')} AS optimistic, {rd('SUM(upper_bound) * 365 / COUNT(*)')} AS conservative FROM forecast WHERE {NEXT_YEAR} GROUP BY contract_id"""), 2),
    Query("seasonal_factors", lambda s: f.seasonal_factors(s.forecast), sql(
        "forecast", f"SELECT month, {rn('m / (SUM(m) OVER () / 12)')} AS seasonal_factor FROM (SELECT month(forecast_date) AS month, AVG(predicted_daily_cost) AS m FROM forecast GROUP BY ALL)")),
]
