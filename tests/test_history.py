"""Contracts see all history, whatever the reports look back on."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from meterline.operators import contracts as c
from meterline.operators import cost, forecast, quality
from meterline.operators import upkeep as u
from meterline.plans.refresh import daily_refresh
from meterline.session import shared_folder
from tests.helpers import USAGE, by, contract, contracts, costs, d, one, price, prices

AS_OF = d("2024-06-30")


def _feed(spark, start: str, days: int):
    """One unit a day from ``start`` on."""
    at = lambda i: datetime.combine(d(start) + timedelta(days=i), datetime.min.time())
    rows = [("A", "w1", "X", "AWS", at(i), at(i).date(), "DBU", Decimal(1), "ORIGINAL") for i in range(days)]
    return spark.createDataFrame(rows, USAGE).withColumns({
        "usage_metadata": F.struct(*[F.lit("x").alias(n) for n in ("job_id", "job_name", "warehouse_id", "cluster_id")]),
        "identity_metadata": F.struct(F.lit("u").alias("run_as")), "custom_tags": F.create_map(F.lit("a"), F.lit("b")),
    })


def _accounts(spark):
    return spark.createDataFrame([], "account_id string, " + ", ".join(f"{n} string" for n in cost.ACCOUNT_COLUMNS))


def test_refresh_burns_contracts_down_over_all_history(spark):
    terms = contracts(spark, contract(value=1000, start="2022-01-01", end="2024-12-31"))
    feed, catalog = _feed(spark, "2022-01-01", 900), prices(spark, price(start="2021-01-01"))
    out = daily_refresh(feed, catalog, _accounts(spark), terms, AS_OF)
    whole = c.burndown_summary(c.contract_burndown(terms, cost.dashboard_data(feed, catalog, _accounts(spark), AS_OF, None), AS_OF), AS_OF)
    assert out.summary.collect() == whole.collect()
    assert float(one(out.summary).total_consumed) == pytest.approx(900 * 1.8)
    assert out.dashboard.agg(F.min("usage_date")).first()[0] == AS_OF - timedelta(days=365)


def test_features_read_the_costs_once(spark, scratch):
    costs(spark, [("2024-02-01", 5), ("2024-02-05", 7), ("2024-02-06", 1)]).write.parquet(f"{scratch}/costs")
    daily = forecast.contract_daily_costs(contracts(spark, contract()), spark.read.parquet(f"{scratch}/costs"), AS_OF)
    rows = forecast.forecast_features(daily)
    assert [float(r.y) for r in rows.orderBy("ds").collect()] == [5, 0, 0, 0, 7, 1]
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") <= 2  # the adaptive plan is shown twice at most


def test_forecast_is_not_fitted_twice_or_in_python(spark):
    terms = contracts(spark, contract(end="2024-04-30"))
    daily = costs(spark, [((d("2024-01-01") + timedelta(days=i)).isoformat(), 10 + i % 7) for i in range(150)])
    burn, series = c.contract_burndown(terms, daily, AS_OF), forecast.forecast_features(forecast.contract_daily_costs(terms, daily, AS_OF))
    out = forecast.forecast_output(burn, terms, series)
    assert "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()
    assert out.agg(F.min("forecast_date")).first()[0] == d("2024-05-01")  # the day after the last one of the term


def test_seasonal_factors_multiply(spark):
    level = lambda i: (100 + i) * (1.5 if (d("2024-01-01") + timedelta(days=i)).weekday() < 5 else 0.5)
    series = spark.createDataFrame([("C1", d("2024-01-01") + timedelta(days=i), float(level(i)), d("2024-12-31")) for i in range(280)], "contract_id string, ds date, y double, contract_end date")
    rows = forecast.seasonal_forecast(series).orderBy("ds").collect()
    weekday = [r.yhat for r in rows[:28] if r.ds.weekday() < 5]
    weekend = [r.yhat for r in rows[:28] if r.ds.weekday() >= 5]
    assert sum(weekday) / 20 == pytest.approx(3 * sum(weekend) / 8, rel=0.1)
    zero = forecast.seasonal_forecast(series.withColumn("y", F.lit(0.0)))
    assert zero.filter("yhat <> 0 OR yhat IS NULL").count() == 0


def test_overlap_inside_a_long_interval(spark):
    rows = [price(start="2024-01-01", end="2024-12-31"), price(start="2024-02-01", end="2024-03-01"), price(start="2024-04-01", end="2024-05-01")]
    assert quality.price_overlap_check(prices(spark, *rows)).count() == 2


def test_duplicate_source_keys_fail(spark):
    target = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(Exception, match="several rows"):
        u.upsert(target, spark.createDataFrame([("a", 2), ("a", 3)], "k string, v int"), ["k"]).collect()
    assert by(u.upsert(target, spark.createDataFrame([("a", 2)], "k string, v int"), ["k"]), "k")["a"].v == 2


def test_far_dates_are_unknown(spark):
    terms = contracts(spark, contract(value=10**12))
    row = one(c.contract_analysis(terms, costs(spark, [("2024-01-01", 1), ("2024-01-02", 1)]), AS_OF))
    assert row.projected_end_date is None


def test_cluster_without_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
