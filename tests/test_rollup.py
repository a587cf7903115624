"""Reports and checks merged from stored day states equal those made from all rows."""

from __future__ import annotations

from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from meterline.operators import reports, rollup
from meterline.plans.daily_checks import DayChecks, checks, day_state
from meterline.session import stored
from tests.helpers import by, d, price, prices, usage

AS_OF = d("2024-06-30")


def pick(name, n, salt, null_every=0):
    value = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    text = F.concat(F.lit(name), value.cast("string"))
    return F.when(value != null_every - 1, text) if null_every else text


@pytest.fixture(scope="module")
def dashboard(spark, tmp_path_factory):
    """Rows of 100 days with null workspaces, jobs, users and costs, equal totals, and a hot workspace."""
    rows = spark.range(6000).select(
        F.date_sub(F.lit(AS_OF), F.pmod(F.xxhash64("id"), F.lit(100)).cast("int")).alias("usage_date"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(pick("w", 40, 1, 5)).alias("workspace_id"), pick("s", 25, 2).alias("sku_name"), pick("cloud", 3, 3).alias("cloud_provider"),
        pick("cat", 3, 4, 2).alias("product_category"), pick("j", 30, 5, 7).alias("job_id"), pick("job ", 3, 6, 2).alias("job_name"), pick("u", 20, 7, 3).alias("run_as"),
        F.pmod(F.xxhash64("id", F.lit(8)), F.lit(5)).cast("decimal(18,6)").alias("usage_quantity"), F.lit(2).cast("decimal(20,10)").alias("price_per_unit"),
        F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id", F.lit(9)), F.lit(400)) / 100).cast("decimal(18,6)").alias("actual_cost"),
    )
    return stored(rows, str(tmp_path_factory.mktemp("rollup") / "dashboard"))


def built(dashboard, folder, known=None):
    cells = stored(rollup.cells(dashboard), f"{folder}/cells")
    ids = {m: stored(rollup.extended(known[m], cells, m) if known else rollup.dictionary(cells, m), f"{folder}/{m}") for m in rollup.MEMBERS}
    return rollup.Rollup(stored(rollup.measures(cells), f"{folder}/measures"), stored(rollup.members(cells, ids), f"{folder}/members")), ids


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("days", [0, 1, 30, 90, 365])
def test_top_lists_of_any_window_come_from_one_rollup(dashboard, scratch, days):
    merged, _ = built(dashboard, scratch)
    want = reports.top_consumers_report(*[f(dashboard, AS_OF, days) for f in (reports.top_workspaces, reports.top_skus, reports.top_jobs, reports.top_users)])
    assert rows(rollup.top_consumers(merged, AS_OF, days)) == rows(want) and (not days or want.count() == 40)


def test_a_merge_reads_each_stored_table_once_and_expands_nothing(dashboard, scratch):
    merged, _ = built(dashboard, scratch)
    plan = rollup.top_consumers(merged, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Expand" not in plan and "usage_date" in plan.split("PushedFilters")[1] and "WindowGroupLimit" in plan
    build = rollup.cells(dashboard)._jdf.queryExecution().executedPlan().toString()
    assert build.count("FileScan") == 1 and "Expand" not in build


def test_monthly_stats_equal_those_of_all_rows(dashboard, scratch):
    merged, _ = built(dashboard, scratch)
    assert rows(rollup.monthly_stats(merged, AS_OF)) == rows(reports.monthly_stats(dashboard, AS_OF))
    assert rows(rollup.monthly_report(merged, AS_OF)) == rows(reports.monthly_report(dashboard, AS_OF))


def test_a_key_that_meets_one_value_takes_one_word_of_64_bits(spark, scratch):
    """Bitmaps of a fixed 4 KB for each day and workspace filled the memory of a task."""
    row = spark.range(200).select(
        F.lit(AS_OF).alias("usage_date"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("workspace_id"), F.lit("s").alias("sku_name"), F.lit("AWS").alias("cloud_provider"),
        *[F.lit(None).cast("string").alias(c) for c in ("product_category", "job_id", "job_name", "run_as")],
        *[F.lit(1).cast("decimal(18,6)").alias(c) for c in ("usage_quantity", "actual_cost")],
    )
    merged, _ = built(row, scratch)
    assert dict(merged.members.dtypes)["bits"] == "bigint" and merged.members.filter("section = 'workspace'").count() == 200
    plan = rollup.members(rollup.cells(row), {m: rollup.dictionary(rollup.cells(row), m) for m in rollup.MEMBERS})._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert rollup.totals(merged).filter("section = 'cloud'").first().distinct_workspace_id == 200


def test_days_added_later_merge_with_those_before(dashboard, scratch):
    late = F.col("usage_date") > F.lit(AS_OF - timedelta(days=20))
    renamed = dashboard.withColumn("workspace_id", F.when(late & (F.col("workspace_id") == "w7"), "new").otherwise(F.col("workspace_id")))
    old, ids = built(renamed.filter(~late), f"{scratch}/old")
    new, more = built(renamed.filter(late), f"{scratch}/new", ids)
    both = rollup.Rollup(old.measures.unionByName(new.measures), old.members.unionByName(new.members))
    whole, _ = built(renamed, f"{scratch}/whole")
    assert rows(rollup.totals(both)) == rows(rollup.totals(whole))
    assert more["workspace_id"].count() == more["workspace_id"].select("id").distinct().count() == ids["workspace_id"].count() + 1
    assert not rows(ids["workspace_id"].join(more["workspace_id"], ["workspace_id", "id"], "left_anti"))


def test_an_empty_dashboard_has_empty_reports(dashboard, scratch):
    merged, _ = built(dashboard.limit(0), scratch)
    assert rollup.top_consumers(merged, AS_OF).count() == 0 and rollup.monthly_stats(merged, AS_OF).count() == 0


FEED = [
    ("2024-06-28 01:00", "5"), ("2024-06-28 02:00", "0"), ("2024-06-29 01:00", "3", "X", "RETRACTION"), ("2024-06-29 03:00", "2", "Y"),
    ("2024-06-10 05:00", "7"), ("2024-02-01 05:00", "1"), ("2020-01-01 05:00", "9"),
]


def test_checks_of_day_states_equal_a_full_scan(spark, scratch):
    feed, table = usage(spark, *FEED), prices(spark, price("X", "2024-01-01"))
    store = DayChecks(spark, scratch)
    store.refresh(usage(spark, *FEED[:-1], ("2024-06-29 09:00", "100")), table, d("2024-01-01"), AS_OF)
    before = store.table.current().partitions
    store.refresh(feed, table, d("2024-06-29"), AS_OF)  # a record was taken back: its day is read again, and only that
    after = store.table.current().partitions
    assert {k for k in after if after[k] != before.get(k)} == {"2024-06-29"} and before.keys() == after.keys()
    assert rows(checks(store.read(), AS_OF)) == rows(checks(day_state(feed, table), AS_OF))
    found = by(checks(store.read(), AS_OF), "window_days")
    week, year = found[7], found[365]
    assert (week.total_records, week.days_with_data, week.missing_days, week.status, week.non_positive, week.price_coverage_pct) == (4, 2, 6, "OK", 1, 66.67)
    assert week.total_dbu == 7 and week.total_cost == Decimal("9.00") and year.total_records == 6 and year.first_date == d("2024-02-01")


def test_a_day_that_lost_all_its_records_is_gone(spark, scratch):
    table, store = prices(spark, price("X", "2024-01-01")), DayChecks(spark, scratch)
    store.refresh(usage(spark, *FEED), table, d("2024-01-01"), AS_OF)
    store.refresh(usage(spark, *FEED).filter("usage_date <> '2024-06-10'"), table, d("2024-06-10"), d("2024-06-10"))
    assert "2024-06-10" not in store.table.current().partitions and checks(store.read(), AS_OF).filter("window_days = 30").first().days_with_data == 2
