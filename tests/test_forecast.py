from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from meterline.operators import contracts as c
from meterline.operators import forecast as f
from tests.helpers import by, contract, contracts, costs, d, daily_run, one

AS_OF = d("2024-06-30")


def test_spine_fills_gaps_and_keeps_one_day_histories(spark):
    terms = contracts(spark, contract())
    single = f.forecast_features(f.contract_daily_costs(terms, costs(spark, [("2024-02-01", 5)]), AS_OF))
    assert single.count() == 1
    rows = f.forecast_features(f.contract_daily_costs(terms, costs(spark, [("2024-02-01", 5), ("2024-02-05", 7)]), AS_OF))
    out = by(rows, "ds")
    assert len(out) == 5 and float(out[d("2024-02-03")].y) == 0 and out[d("2024-02-03")].has_actual_data == 0
    assert float(out[d("2024-02-05")].cumulative_cost) == 12


def test_daily_costs_run_past_the_end_date(spark):
    rows = f.contract_daily_costs(contracts(spark, contract(end="2024-02-01")), daily_run(spark, "2024-01-25", 20, 1), AS_OF)
    assert rows.count() == 20


@pytest.mark.parametrize("days,model", [(29, "linear_fallback"), (30, "seasonal")])
def test_training_gate(spark, days, model):
    terms = contracts(spark, contract())
    series = f.forecast_features(f.contract_daily_costs(terms, daily_run(spark, "2024-01-01", days, 5), AS_OF))
    assert one(f.training_gate(series)).model_version == model


@pytest.mark.parametrize("days,slope", [(7, 0.0), (8, 2.0)])
def test_slope_needs_more_than_seven_rows(spark, days, slope):
    daily = spark.createDataFrame([("A", d("2024-01-01") + timedelta(days=i), 10.0 + 2 * i) for i in range(days)], "account_id string, usage_date date, daily_cost double")
    assert one(f.trend_stats(daily, "account_id")).trend == pytest.approx(slope)


def test_trend_is_floored_at_zero(spark):
    stats = spark.createDataFrame([("A", 10.0, 3.0, -4.0)], "k string, daily_avg double, daily_std double, trend double")
    rows = f.trend_forecast(stats, "k", AS_OF, 5).orderBy("ds").collect()
    assert [r.yhat for r in rows] == [10, 6, 2, 0, 0] and [r.yhat_lower for r in rows] == [7, 3, 0, 0, 0]
    assert rows[0].ds == d("2024-07-01") and rows[3].yhat_upper == 3


def test_linear_horizon_and_band(spark):
    terms = contracts(spark, contract(end="2024-02-01"))
    burn = c.contract_burndown(terms, daily_run(spark, "2024-01-01", 10, 10), AS_OF)
    rows = f.linear_forecast(burn, terms).orderBy("ds").collect()
    assert len(rows) == 22 + 90 and rows[0].ds == d("2024-01-11")
    assert (rows[0].yhat, rows[0].yhat_lower, rows[0].yhat_upper) == (10, 8, 12)


def _flat(spark, days=100, value=10.0):
    return spark.createDataFrame([("C1", d("2024-01-01") + timedelta(days=i), value, value * 0.8, value * 1.2) for i in range(days)],
                                 "contract_id string, ds date, yhat double, yhat_lower double, yhat_upper double")


def _remaining(spark, amount):
    return spark.createDataFrame([("C1", 0.0, float(amount))], "contract_id string, spent double, remaining double")


def test_exhaustion_dates_are_ordered(spark):
    row = one(f.exhaustion_dates(_flat(spark), _remaining(spark, 120)))
    assert (row.exhaustion_date_p10, row.exhaustion_date_p50, row.exhaustion_date_p90) == (d("2024-01-10"), d("2024-01-12"), d("2024-01-15"))
    assert row.days_to_exhaustion == 11


def test_exhausted_and_never_exhausted(spark):
    spent = one(f.exhaustion_dates(_flat(spark), _remaining(spark, 0)))
    assert spent.exhaustion_date_p50 is None and spent.days_to_exhaustion == 0
    never = one(f.exhaustion_dates(_flat(spark), _remaining(spark, 1e6)))
    assert never.exhaustion_date_p10 is None and never.days_to_exhaustion is None


def test_seasonal_model_follows_the_week_and_is_clipped(spark):
    terms = contracts(spark, contract())
    shape = lambda i: 100 if i % 7 < 5 else 20
    dash = daily_run(spark, "2024-01-01", 120, shape)
    burn = c.contract_burndown(terms, dash, AS_OF)
    series = f.forecast_features(f.contract_daily_costs(terms, dash, AS_OF))
    out = f.forecast_output(burn, terms, series)
    assert out.filter("model_version <> 'seasonal' OR predicted_daily_cost < 0 OR lower_bound > predicted_daily_cost OR upper_bound < predicted_daily_cost").count() == 0
    weekday = F.dayofweek("forecast_date")
    means = out.groupBy(weekday.isin(1, 7).alias("weekend")).agg(F.avg("predicted_daily_cost").alias("m"))
    found = {r.weekend: r.m for r in means.collect()}
    assert found[False] == pytest.approx(100, abs=12) and found[True] == pytest.approx(20, abs=12)
    assert out.count() == min((d("2024-12-31") - d("2024-04-29")).days + 90, 365)
    first = out.filter("exhaustion_date_p10 > exhaustion_date_p50 OR exhaustion_date_p50 > exhaustion_date_p90")
    assert first.count() == 0


def test_short_histories_use_the_flat_model(spark):
    terms = contracts(spark, contract())
    dash = daily_run(spark, "2024-01-01", 10, 5)
    series = f.forecast_features(f.contract_daily_costs(terms, dash, AS_OF))
    out = f.forecast_output(c.contract_burndown(terms, dash, AS_OF), terms, series)
    assert {r.model_version for r in out.select("model_version").distinct().collect()} == {"linear_fallback"}


def test_metrics_skip_zero_actuals(spark):
    actual = spark.createDataFrame([("C1", d("2024-01-01"), 0.0), ("C1", d("2024-01-02"), 10.0)], "contract_id string, ds date, y double")
    fitted = actual.select("contract_id", "ds", F.lit(8.0).alias("yhat"))
    row = one(f.fit_metrics(actual, fitted))
    assert row.mape == pytest.approx(20) and row.mae == pytest.approx(5) and row.rmse == pytest.approx((34.0) ** 0.5)


def test_only_the_latest_model_is_active(spark):
    schema = "model_id string, contract_id string, trained_at date"
    old = spark.createDataFrame([("m1", "C1", d("2024-01-01")), ("m2", "C2", d("2024-01-01"))], schema).withColumn("is_active", F.lit(True))
    new = spark.createDataFrame([("m3", "C1", d("2024-02-01"))], schema)
    assert {r.model_id: r.is_active for r in f.model_metrics_table(old, new).collect()} == {"m1": False, "m2": True, "m3": True}
