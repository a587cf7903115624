from __future__ import annotations

import math
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.operators import contracts as c
from meterline.operators import forecast as f
from meterline.operators import seasonal
from tests.helpers import contract, contracts, costs, d, daily_run

AS_OF = d("2024-06-30")
SCHEMA = "contract_id string, ds date, y double, contract_end date"


def series_of(spark, days_of, end="2027-12-31"):
    rng = np.random.default_rng(4)
    rows = []
    for name, n in days_of.items():
        for i in range(n):
            ds = d("2022-01-05") + timedelta(days=i)
            wave = 1 + 0.3 * math.sin(2 * math.pi * i / 7) + 0.1 * math.cos(2 * math.pi * i / 30.5) + 0.2 * math.sin(2 * math.pi * i / 365.25)
            rows.append((name, ds, float((80 + 0.1 * i) * wave + rng.normal(0, 3)), d(end)))
    return spark.createDataFrame(rows, SCHEMA)


def least_squares(series):
    """The same fit in numpy: yhat by day, for history and 365 days more, and the deviation of the residuals."""
    x = np.array([(r.ds - seasonal.EPOCH).days for r in series], float)
    y = np.array([r.y for r in series])
    slope = np.polyfit(x, y, 1)[0] if len(x) > 1 else 0.0
    every = np.concatenate([x, x.max() + 1 + np.arange(365)])

    def design(x_):
        level = np.maximum(y.mean() + slope * (x_ - x.mean()), 0.1 * y.mean())
        columns = [np.ones_like(x_), (x_ - x.min()) / max(x.max() - x.min(), 1)]
        for s in seasonal.SEASONS:
            for k in range(1, s.order + 1):
                weight = level if x.max() - x.min() >= s.span else 0 * level
                columns += [weight * np.sin(2 * np.pi * k * x_ / s.period), weight * np.cos(2 * np.pi * k * x_ / s.period)]
        return np.stack(columns, axis=1)

    a = design(x)
    penalty = np.full(a.shape[1], len(x) * y.mean() ** 2 * seasonal.RIDGE + 1e-6)
    penalty[:2] = len(x) * 1e-9
    beta = np.linalg.solve(a.T @ a + np.diag(penalty), a.T @ y)
    return design(every) @ beta, np.std(y - a @ beta)


def test_harmonics_equal_a_numpy_fit(spark):
    df = series_of(spark, {"short": 40, "year": 400, "long": 900, "one": 1})
    got = f.seasonal_fit(df).collect()
    for name in ("short", "year", "long", "one"):
        want, sigma = least_squares(sorted((r for r in df.collect() if r.contract_id == name), key=lambda r: r.ds))
        rows = sorted((r for r in got if r.contract_id == name), key=lambda r: r.ds)
        assert [r.fitted for r in rows].count(False) == 365 and len(rows) == len(want)
        assert [r.yhat for r in rows] == pytest.approx(list(want), rel=1e-6, abs=1e-6)
        assert rows[0].yhat_upper - rows[0].yhat == pytest.approx(1.2816 * sigma, rel=1e-6, abs=1e-6)


def test_a_year_is_learned_only_from_two(spark):
    betas = {r.contract_id: r.beta for r in seasonal.coefficients(series_of(spark, {"short": 700, "long": 1100})).collect()}
    assert all(abs(x) < 1e-9 for x in betas["short"][18:]) and max(abs(x) for x in betas["long"][18:]) > 0.1


def test_one_shuffle_and_no_python(spark):
    plan = f.seasonal_fit(series_of(spark, {"a": 50}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Join" not in plan


def test_odd_series(spark):
    rows = [("zero", d("2024-01-01") + timedelta(days=i), 0.0, d("2024-12-31")) for i in range(40)]
    rows += [("minus", d("2024-01-01") + timedelta(days=i), -5.0, d("2024-12-31")) for i in range(40)]
    rows += [("late", d("2025-01-01"), 5.0, d("2024-12-31")), ("null", d("2024-01-01"), None, d("2024-12-31"))]
    out = f.seasonal_fit(spark.createDataFrame(rows, SCHEMA))
    assert out.filter("contract_id = 'zero' AND yhat <> 0").count() == 0 and out.filter("contract_id = 'late'").count() == 0
    assert {round(r.yhat, 3) for r in out.filter("contract_id = 'minus'").collect()} == {-5.0}
    assert f.seasonal_fit(spark.createDataFrame([], SCHEMA)).count() == 0


def _forecast(spark, value, days, end="2026-12-31", cost=10.0):
    terms = contracts(spark, contract(start="2024-01-01", end=end, value=value))
    dash = daily_run(spark, "2024-01-01", days, cost)
    burn = c.contract_burndown(terms, dash, AS_OF)
    out = f.forecast_output(burn, terms, f.forecast_features(f.contract_daily_costs(terms, dash, AS_OF)))
    return terms, out


def test_a_contract_that_runs_out_beyond_the_horizon_is_not_on_track(spark):
    terms, out = _forecast(spark, 1000 + 4000, 100)  # 400 days of cost left, seen on day 100; the end is 900 days away
    row = f.forecast_details(out, terms).agg(F.min("forecast_status").alias("s"), F.max("forecast_status").alias("t"), F.min("beyond_horizon").alias("b"), F.count("*").alias("n")).first()
    assert (row.s, row.t, row.b, row.n) == ("BEYOND HORIZON", "BEYOND HORIZON", True, 365)


@pytest.mark.parametrize("value,days,end,status,beyond", [
    (1000 + 3000, 100, "2026-12-31", "AT RISK", True),
    (100_000, 100, "2024-08-31", "ON TRACK", False),
    (900, 100, "2026-12-31", "ON TRACK", True),  # spent already: nothing is dated, as published
    (5000, 10, "2026-12-31", "AT RISK", False),  # the flat model runs to the end
])
def test_horizon_statuses(spark, value, days, end, status, beyond):
    terms, out = _forecast(spark, value, days, end)
    assert {(r.forecast_status, r.beyond_horizon) for r in f.forecast_details(out, terms).select("forecast_status", "beyond_horizon").distinct().collect()} == {(status, beyond)}
