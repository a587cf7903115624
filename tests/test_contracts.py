from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from meterline.functions.columns import pace_status, projected_end_date, whole_days
from meterline.operators import contracts as c
from tests.helpers import by, contract, contracts, costs, d, daily_run, one

AS_OF = d("2024-06-30")


def test_burndown_invariants(spark):
    rows = c.contract_burndown(contracts(spark, contract()), daily_run(spark, "2024-01-01", 120, lambda i: 1.25 * i), AS_OF)
    total = rows.agg(F.sum("daily_cost").alias("s"), F.max("cumulative_cost").alias("m")).first()
    assert total.s == total.m
    assert rows.filter(F.col("remaining_budget") + F.col("cumulative_cost") != F.col("commitment")).count() == 0


def test_only_active_contracts_inside_their_term(spark):
    terms = contracts(spark, contract("C1", end="2024-01-10"), contract("C2", status="PENDING"), contract("C3", cloud="GCP"))
    rows = c.contract_burndown(terms, daily_run(spark, "2023-12-25", 40, 10), AS_OF)
    assert {r.contract_id for r in rows.collect()} == {"C1"} and rows.count() == 10


def test_zero_length_term_is_on_pace(spark):
    terms = contracts(spark, contract(start="2024-01-05", end="2024-01-05"))
    summary = one(c.burndown_summary(c.contract_burndown(terms, daily_run(spark, "2024-01-01", 10, 10), AS_OF), AS_OF))
    assert summary.pace_status == "ON PACE" and summary.projected_end_date == d("2024-01-05")


def test_contract_without_usage_stays_in_the_analysis(spark):
    row = one(c.contract_analysis(contracts(spark, contract(account="none")), costs(spark, [("2024-01-01", 1)]), AS_OF))
    assert row.consumed is None and row.pace_status == "ON PACE" and row.projected_end_date is None


def test_pace_limits_are_strict(spark):
    points = spark.createDataFrame([(120.0,), (120.5,), (110.0,), (110.5,), (80.0,), (79.5,)], "used double")
    out = points.select(pace_status(F.col("used"), F.lit(100.0)).alias("p")).collect()
    assert [r.p for r in out] == ["ABOVE PACE", "OVER PACE", "ON PACE", "ABOVE PACE", "ON PACE", "UNDER PACE"]


def test_published_pace_example(spark):
    row = spark.range(1).select(pace_status(F.lit(36.0), F.lit(37.0)).alias("p")).first()
    assert row.p == "ON PACE"


def test_projection_is_capped_before_the_cast(spark):
    frame = spark.createDataFrame([(d("2024-01-01"), d("2024-12-31"), 1e9, 10, 1e-6), (d("2024-01-01"), d("2024-12-31"), 100.0, 10, 50.0),
                                   (d("2024-01-01"), d("2024-12-31"), 100.0, 0, 0.0)], "s date, e date, v double, n int, c double")
    out = frame.select(projected_end_date(F.col("s"), F.col("v"), F.col("n"), F.col("c"), F.col("e")).alias("p")).collect()
    assert [r.p for r in out] == [date(2032, 12, 31), d("2024-01-21"), d("2024-12-31")]


def test_whole_days_keeps_null_and_truncates(spark):
    frame = spark.createDataFrame([(None,), (2.9,), (-2.9,), (1e30,)], "x double")
    assert [r.y for r in frame.select(whole_days(F.col("x")).alias("y")).collect()] == [None, 2, -2, None]


def test_linear_exhaustion_needs_two_days(spark):
    terms = contracts(spark, contract(value=1000))
    burn = lambda rows: c.linear_exhaustion(c.contract_burndown(terms, costs(spark, rows), AS_OF))
    assert burn([("2024-01-01", 5)]).count() == 0
    row = one(burn([("2024-01-01", 50), ("2024-01-11", 50)]))
    assert row.projected_exhaustion_date == d("2024-01-11") + (d("2024-04-10") - d("2024-01-11"))


def test_rolling_rate_uses_calendar_days(spark):
    series = spark.createDataFrame([("C1", d(f"2024-01-{i:02d}"), float(i)) for i in range(1, 10)], "contract_id string, ds date, y double")
    out = by(c.rolling_burn_rate_7d(series), "ds")
    assert out[d("2024-01-01")].burn_rate_7d == 1.0 and out[d("2024-01-09")].burn_rate_7d == 6.0


def test_expiring_urgency(spark):
    terms = contracts(spark, contract("U", end="2024-07-30"), contract("S", end="2024-08-29"), contract("P", end="2024-09-28"), contract("L", end="2024-09-29"))
    assert {k: r.urgency for k, r in by(c.expiring_contracts(terms, AS_OF), "contract_id").items()} == {"U": "URGENT", "S": "SOON", "P": "UPCOMING"}


def test_number_text_rounds_half_to_even(spark):
    from meterline.functions.columns import grouped_number

    frame = spark.createDataFrame([(1234.5,), (1235.5,)], "x double").select(grouped_number(F.col("x").cast("decimal(18,2)")).alias("t"))
    assert [r.t for r in frame.collect()] == ["USD 1,234", "USD 1,236"]
