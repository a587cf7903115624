from __future__ import annotations

from datetime import timedelta

import pytest

from meterline.operators import anomalies, reports
from tests.helpers import by, contract, contracts, costs, d, daily_run, one

AS_OF = d("2024-03-31")


def test_spikes_compare_with_the_previous_row_not_the_day_before(spark):
    rows = costs(spark, [("2024-03-10", 100), ("2024-03-14", 200), ("2024-03-15", 0), ("2024-03-16", 50)])
    spikes = {r.usage_date: r for r in anomalies.daily_spikes(rows, AS_OF).collect()}
    assert set(spikes) == {d("2024-03-14"), d("2024-03-15")}  # a zero or missing previous value never counts
    assert float(spikes[d("2024-03-14")].pct_change) == 100.0


def test_spike_threshold_is_strict(spark):
    rows = costs(spark, [("2024-03-10", 100), ("2024-03-11", 150)])
    assert anomalies.daily_spikes(rows, AS_OF).count() == 0


def test_weekend_rows_are_judged_one_by_one(spark):
    small = costs(spark, [("2024-03-30", 60), ("2024-03-30", 60)])
    assert anomalies.weekend_usage(small, AS_OF).count() == 0
    big = costs(spark, [("2024-03-30", 101), ("2024-03-30", 150), ("2024-03-29", 500)])
    assert float(one(anomalies.weekend_usage(big, AS_OF)).cost) == 251.0


def test_new_workspace_counts_its_own_days(spark):
    rows = costs(spark, [("2024-01-01", 5, "old"), ("2024-03-20", 5, "old"), ("2024-03-20", 7, "new"), ("2024-03-20", 1, "new"), ("2024-03-22", 2, "new")])
    row = one(anomalies.new_workspaces(rows, AS_OF))
    assert (row.workspace_id, row.usage_days, row.days_active, float(row.total_cost)) == ("new", 2, 11, 10.0)


def test_high_spend_alert(spark):
    rows = daily_run(spark, "2024-03-01", 30, lambda i: 100 if i < 29 else 151)
    assert one(anomalies.high_spend_alert(rows, AS_OF)).alert_message == "HIGH SPEND ALERT"
    rows = daily_run(spark, "2024-03-01", 30, lambda i: 100 if i < 29 else 150)
    assert one(anomalies.high_spend_alert(rows, AS_OF)).alert_message == "No alert"


def test_monthly_mean_weighs_days_by_rows(spark):
    rows = costs(spark, [("2024-03-01", 10)] * 3 + [("2024-03-02", 90)])
    stats = one(reports.monthly_stats(rows, d("2024-04-20")))
    assert stats.avg_daily_cost == (3 * 30 + 1 * 90) / 4
    assert (stats.days_with_data, float(stats.max_daily_cost), float(stats.min_daily_cost)) == (2, 90.0, 30.0)


def test_month_bounds():
    assert reports.month_bounds(d("2024-03-31")) == (d("2024-03-01"), d("2024-03-31"))
    assert reports.month_bounds(d("2024-03-30")) == (d("2024-02-01"), d("2024-02-29"))
    assert reports.month_bounds(d("2024-01-15")) == (d("2023-12-01"), d("2023-12-31"))


def test_period_summary_has_both_periods(spark):
    rows = daily_run(spark, "2024-03-01", 45, 2)
    out = by(reports.period_summary(rows, d("2024-04-10")), "period")
    assert out["Last Week"].days_with_data == 7 and out["Last Month"].days_with_data == 31


def test_grain_is_checked(spark):
    with pytest.raises(ValueError):
        reports.time_series(costs(spark, [("2024-03-01", 1)]), AS_OF, "HOUR")


def test_staleness_and_overrun(spark):
    rows = daily_run(spark, "2024-01-01", 80, 900)
    assert one(anomalies.staleness_alert(rows, "usage_date", d("2024-03-20") + timedelta(days=4))).alert_status.startswith("ALERT")
    terms = contracts(spark, contract("C1", 100000), contract("C2", 300000), contract("C3", 10, account="none"))
    assert [r.contract_id for r in anomalies.contract_overrun_alert(terms, rows, AS_OF).collect()] == ["C1"]
