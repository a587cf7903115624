from __future__ import annotations

from datetime import timedelta

import pytest

from meterline.operators import commitment as k
from meterline.plans.commitment import stages
from meterline.sources.tiers import default_tiers
from tests.helpers import by, contract, contracts, d, one, tiers

AS_OF = d("2024-06-30")


def _daily(spark, days=30, amount=100.0, account="A"):
    return spark.createDataFrame([(account, AS_OF - timedelta(days=days - i), amount) for i in range(days)], "account_id string, usage_date date, daily_cost double")


def _candidates(spark, *amounts):
    return spark.createDataFrame([("A", 1, 100000.0, i, "t", float(a)) for i, a in enumerate(amounts)],
                                 "account_id string, duration_years int, projected_total double, candidate_order int, candidate_type string, commitment double")


def test_best_tier_edges(spark):
    picked = by(k.best_tier(_candidates(spark, 10, 60000, 99999.5, 9e6), default_tiers(spark).filter("duration_years = 1")), "commitment")
    assert (picked[10.0].discount_rate, picked[10.0].tier_id, picked[10.0].tier_name) == (0.0, None, "Below minimum")
    assert picked[60000.0].tier_id == "TIER_50K_1Y" and picked[99999.5].tier_id == "TIER_5M_1Y" and picked[9e6].discount_rate == 0.3


def test_equal_rates_take_the_lower_band_and_above_all_takes_the_best(spark):
    table = tiers(spark, [("LOW", 10, 100, 1, 0.1), ("HIGH", 50, 200, 1, 0.1), ("TOP", 20, 60, 1, 0.3)])
    picked = by(k.best_tier(_candidates(spark, 80, 500), table), "commitment")
    assert picked[80.0].tier_id == "LOW" and picked[500.0].tier_id == "TOP"


def test_economics_of_waste_and_overage(spark):
    rows = by(k.commitment_economics(k.best_tier(_candidates(spark, 80000, 125000), tiers(spark, [("T", 1, None, 1, 0.2)]))), "commitment")
    over, waste = rows[80000.0], rows[125000.0]
    assert over.effective_cost == pytest.approx(80000 * 0.8 + 20000) and over.waste_amount == 0
    assert waste.effective_cost == pytest.approx(80000) and waste.waste_cost == pytest.approx(20000) and waste.net_benefit == pytest.approx(0)
    assert waste.utilization == pytest.approx(0.8)


def test_tied_benefit_goes_to_the_first_candidate(spark):
    scored = k.commitment_economics(k.best_tier(_candidates(spark, 100000, 100000, 100001), tiers(spark, [("T", 1, None, 1, 0.2)])))
    assert one(k.optimal_commitment(scored)).candidate_order == 0


def test_poor_use_falls_back_to_return(spark):
    scored = k.commitment_economics(k.best_tier(_candidates(spark, 200000, 150000), tiers(spark, [("T", 1, None, 1, 0.5)])))
    assert one(k.optimal_commitment(scored)).commitment == 150000


def test_chain_gives_one_row_per_account_and_duration(spark):
    daily = _daily(spark).unionByName(_daily(spark, account="B", amount=5000.0))
    out = stages(daily, default_tiers(spark), AS_OF, start=AS_OF, years=(1, 3))
    rows = out.recommendations.collect()
    assert sorted((r.account_id, r.duration_years) for r in rows) == [("A", 1), ("A", 3), ("B", 1), ("B", 3)]
    for r in rows:
        assert r.projected_total == pytest.approx((100 if r.account_id == "A" else 5000) * 365 * r.duration_years, rel=1e-6)
    flags = k.commitment_scenarios(out.scored, out.optimal, out.alternatives)
    assert flags.filter("is_optimal").select("account_id", "duration_years").distinct().count() == 4


def test_begun_term_splits_at_as_of(spark):
    start = AS_OF - timedelta(days=50)
    out = stages(_daily(spark), default_tiers(spark), AS_OF, start=start, years=(1,))
    row = one(out.horizon)
    assert (row.historical_days, row.forecast_days) == (50, 315)
    p = one(out.projections)
    assert p.historical_total == pytest.approx(30 * 100 + 20 * 100) and p.forecasted_total == pytest.approx(315 * 100)


@pytest.mark.parametrize("amount,value", [(1.0, 1000.0), (0.95 * 2500 / 365, 2000.0), (0.95 * 3500 / 365, 4000.0)])
def test_auto_value_rounds_half_to_even_with_a_minimum(spark, amount, value):
    terms = contracts(spark, contract(start="2024-06-30", end="2025-06-30"))
    assert one(k.auto_total_value(terms, _daily(spark, 5, amount), AS_OF)).auto_total_value == value


def test_auto_value_without_history(spark):
    assert one(k.auto_total_value(contracts(spark, contract(account="none")), _daily(spark), AS_OF)).auto_total_value == 10000.0


def test_search_prefers_used_sizes_else_the_smallest(spark):
    annual = spark.createDataFrame([("A", 100000.0), ("B", 10.0)], "account_id string, annual double")
    got = by(k.commitment_search(annual, [(50000, 1, 0.1), (80000, 1, 0.1), (200000, 3, 0.5)]), "account_id")
    assert got["A"].commitment == 50000 and got["B"].commitment == 50000
