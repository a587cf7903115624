"""Interval index of prices and envelopes of tiers against plain joins and scans."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from meterline.operators import cost
from meterline.operators import whatif as w
from meterline.sources.tiers import TIER_SETS, default_tiers, tier_rows
from tests.helpers import by, price, prices, tiers, usage


def joined(df):
    return sorted(map(tuple, df.select("sku_name", "usage_end_time", "usage_quantity", "default_price", "effective_price").collect()), key=str)


def long_history(seed, days=900, overlaps=0):
    rng, out, at = random.Random(seed), [], datetime(2022, 1, 1)
    for i in range(days):
        until = at + timedelta(hours=rng.randrange(1, 40))
        if rng.random() < 0.9:  # else a gap
            out.append(price("HOT", at.isoformat(), until.isoformat(), str(i), str(i)))
        at = until
    out.append(price("HOT", at.isoformat(), None, "9999", "9999"))
    for i in range(overlaps):
        start = datetime(2022, 1, 1) + timedelta(days=rng.randrange(500))
        out.append(price("HOT", start.isoformat(), rng.choice([None, (start + timedelta(days=rng.randrange(400))).isoformat()]), f"{i}.5", "1"))
    return out + [price("COLD", "2022-03-01"), price("ODD", "2023-01-01", "2022-01-01"), price("ODD", "2023-06-01", "2023-06-01")]


def some_usage(spark, seed, n=400):
    rng = random.Random(seed)
    moments = [datetime(2021, 11, 1) + timedelta(hours=rng.randrange(24 * 1200)) for _ in range(n)]
    return usage(spark, *[(m.isoformat(), i, rng.choice(["HOT", "HOT", "COLD", "ODD", "NONE"])) for i, m in enumerate(moments)])


@pytest.mark.parametrize("months", [1, 5, 12, 240])
@pytest.mark.parametrize("overlaps", [0, 30])
@pytest.mark.parametrize("grain", [False, True])
def test_indexed_join_equals_the_plain_one(spark, months, overlaps, grain):
    table, use = prices(spark, *long_history(months, 300, overlaps)), some_usage(spark, months)
    time = "usage_date" if grain else "usage_end_time"
    plain = cost.price_interval_join(use, table, time=time, date_grain=grain)
    assert joined(cost.price_interval_join(use, table, time=time, date_grain=grain, index_months=months)) == joined(plain)


def test_index_has_no_residual_range_and_its_rows_are_bounded(spark):
    table, use = prices(spark, *long_history(1)), some_usage(spark, 2)
    plan = cost.price_interval_join(use, table, index_months=1)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 1 and ">=" not in joins[0] and "<" not in joins[0].replace("<=>", "")
    index, _ = cost.price_index(table, ("sku_name", "cloud", "usage_unit"), months=1)
    hot = index.filter("_p_sku_name = 'HOT'")
    assert hot.agg(F.max(F.size("_p_intervals"))).first()[0] < 90 < table.count() and hot.filter("NOT _p_disjoint").count() == 0


def test_index_without_prices(spark):
    empty = prices(spark, price()).limit(0)
    assert joined(cost.price_interval_join(some_usage(spark, 3, 5), empty, index_months=12)) == joined(cost.price_interval_join(some_usage(spark, 3, 5), empty))


def scanned(rows, value, years):
    held = lambda y: [r[5] for r in rows if r[4] == y and value is not None and r[2] <= value and (r[3] is None or value <= r[3])]
    return max(held(years) or (held(3) if years in (4, 5) else []) or [D("0.05")])


@pytest.mark.parametrize("name", list(TIER_SETS))
def test_envelopes_of_all_sets_equal_a_scan(spark, name):
    rows = tier_rows(name)
    values = [D(e) + d for _, low, high, *_ in [(r[0], r[2], r[3]) for r in rows] for e in (low, high) if e is not None for d in (D("-0.01"), D(0), D("0.01"))] + [D(0), D(75000), D(10**9), None]
    asked = spark.createDataFrame([(f"{i}-{y}", v, y) for i, v in enumerate(values) for y in (1, 2, 3, 4, 5, 6, None)], "contract_id string, value decimal(18,2), years int")
    got = w.tier_lookup(asked, default_tiers(spark, name)).collect()
    assert len(got) == asked.count()
    for r in got:
        assert r.discount_rate == scanned(rows, r.value, r.years)


def test_envelope_of_overlapping_bands_and_gaps(spark):
    bands = [("a", 0, 100, 1, 0.1), ("b", 50, 60, 1, 0.4), ("c", 60, 80, 1, 0.2), ("d", 55, 200, 1, 0.15), ("e", 300, None, 1, 0.3), ("f", 60, 60, 1, 0.5)]
    table = tiers(spark, bands)
    rows = [(t, t, D(lo), None if hi is None else D(hi), y, D(str(rate))) for t, lo, hi, y, rate in bands]
    values = [D(x) / 2 for x in range(-2, 700)]
    got = by(w.tier_lookup(spark.createDataFrame([(str(v), v, 1) for v in values], "contract_id string, value decimal(18,2), years int"), table), "contract_id")
    assert all(got[str(v)].discount_rate == scanned(rows, v, 1) for v in values)


def test_one_row_in_one_row_out_without_a_shuffle_of_values(spark):
    asked = spark.createDataFrame([("x", D(60000), 1)] * 3, "contract_id string, value decimal(18,2), years int")
    out = w.tier_lookup(asked, default_tiers(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 3 and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1  # the tiers, by duration
    nothing = w.tier_lookup(asked, default_tiers(spark).limit(0))
    assert {r.discount_rate for r in nothing.collect()} == {D("0.05")}


def test_crossing_dates_by_bisection_equal_a_scan(spark):
    rng = random.Random(5)
    days = [(datetime(2024, 1, 1) + timedelta(days=i)).date() for i in range(300)]
    paths = {c: [(d, *[D(rng.randrange(-40 if c == "dips" else 0, 100)) / 10 for _ in range(3)]) for d in days] for c in ("A", "B", "dips")}
    rows = [(c, d, float(x), float(x), float(x), float(x), None, "m") for c, own in paths.items() for d, x, _, _ in own]
    forecast = spark.createDataFrame(rows, "contract_id string, forecast_date date, predicted_daily_cost double, lower_bound double, upper_bound double, predicted_cumulative double, exhaustion_date_p50 date, model_version string").repartition(3)
    _, curves = w.forecast_curves(forecast)
    asked = curves.crossJoin(spark.createDataFrame([(D(g), D(f)) for g in ("-1", "0", "3.3", "250", "700", "99999") for f in ("1", "0.8", "0")], "goal decimal(24,10), factor decimal(5,4)"))
    got = asked.select("contract_id", "goal", "factor", w.crossing_date(F.col("curve"), "median", F.col("factor"), F.col("goal")).alias("d")).collect()
    for r in got:
        total, want = D(0), None
        for d, x, _, _ in paths[r.contract_id]:
            total += x
            if want is None and total * r.factor >= r.goal:
                want = d
        assert r.d == want or (r.factor == 0 and r.goal > 0 and r.d is None), (r, want)


def test_scenario_dates_have_no_window_over_scenario_days(spark):
    from tests.helpers import contract, contracts, daily_run, d
    from meterline.operators import contracts as c
    from meterline.operators import forecast as f

    terms = contracts(spark, contract())
    burn = c.contract_burndown(terms, daily_run(spark, "2024-01-01", 20, 10), d("2024-06-30"))
    scenarios = w.generate_scenarios(terms, default_tiers(spark))
    plan = w.scenario_forecast(scenarios, f.linear_contract_forecast(burn, terms), terms)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not any("Window" in line and "scenario_id" in line for line in plan.splitlines())
