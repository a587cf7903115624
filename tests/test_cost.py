from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from meterline.functions.columns import product_category
from meterline.operators import cost, quality
from tests.helpers import d, price, prices, usage


def test_interval_is_closed_at_start_and_open_at_end(spark):
    rows = cost.price_interval_join(
        usage(spark, ("2024-01-01T00:00", 1), ("2024-06-30T23:59:59", 1), ("2024-07-01T00:00", 1)),
        prices(spark, price(end="2024-07-01", effective="1"), price(start="2024-07-01", effective="2")),
    )
    assert [float(r.effective_price) for r in rows.orderBy("usage_end_time").collect()] == [1.0, 1.0, 2.0]


def test_unmatched_and_malformed_prices(spark):
    use = usage(spark, ("2024-02-01T00:00", 3, "X"), ("2024-02-01T00:00", 3, "NOPE"))
    table = prices(spark, price(default="2.5", effective="n/a"))
    costed = {r.sku_name: r for r in cost.cost_columns(cost.price_interval_join(use, table)).collect()}
    assert costed["X"].actual_cost is None and float(costed["X"].list_cost) == 7.5
    assert costed["NOPE"].list_cost is None
    total = cost.cost_with_fallback_price(use, table, d("2024-02-02")).collect()
    assert [r.daily_cost for r in total] == [3 * 2.5 + 3 * 0.5]
    zero = cost.zero_default_daily(use, table, d("2024-02-02"), 5, ["sku_name"])
    assert {r.sku_name: float(r.cost) for r in zero.collect()} == {"X": 7.5, "NOPE": 0.0}


def test_fallback_price_can_be_bound_to_the_account(spark):
    use = usage(spark, ("2024-02-01T00:00", 2))
    table = prices(spark, price(effective="3", account="A"), price(effective="9", account="B"))
    assert cost.cost_with_fallback_price(use, table, d("2024-02-02"), match_account=True).first().daily_cost == 6.0


def test_fallback_excludes_as_of_day(spark):
    use = usage(spark, ("2024-02-01T00:00", 2), ("2024-02-02T00:00", 2))
    days = cost.cost_with_fallback_price(use, prices(spark, price()), d("2024-02-02"))
    assert [r.usage_date for r in days.collect()] == [d("2024-02-01")]


def test_first_category_wins(spark):
    names = ["JOBS_SERVERLESS_SQL", "A_DELTA_LIVE_TABLES", "MODEL_SERVING", "ALL_PURPOSE_JOBS", "OTHER", "SERVERLESS_X"]
    frame = spark.createDataFrame([(n,) for n in names], "sku string").select("sku", product_category(F.col("sku")).alias("c"))
    assert [r.c for r in frame.collect()] == [
        "Jobs Compute", "Delta Live Tables", "Model Serving", "All Purpose Compute", "Other", "Serverless"
    ]


def test_net_corrections_drop_cancelled_usage(spark):
    use = usage(spark, ("2024-02-01T00:00", 5), ("2024-02-01T00:00", -5, "X", "RETRACTION"), ("2024-02-01T00:00", 5, "Y"), ("2024-02-01T00:00", -2, "Y", "RETRACTION"))
    net = cost.net_corrections(use, ["sku_name"]).collect()
    assert [(r.sku_name, r.net_quantity) for r in net] == [("Y", Decimal(3))]


def test_overlapping_price_intervals_are_found(spark):
    clean = prices(spark, price(end="2024-07-01"), price(start="2024-07-01"))
    assert quality.price_overlap_check(clean).count() == 0
    assert quality.price_overlap_check(prices(spark, price(end="2024-08-01"), price(start="2024-07-01"))).count() == 1
    assert quality.price_overlap_check(prices(spark, price(), price(start="2024-07-01"))).count() == 1


def test_unpriced_skus(spark):
    use = usage(spark, ("2024-02-01T00:00", 1, "X"), ("2024-02-01T00:00", 1, "NOPE"))
    assert [r.sku_name for r in quality.unpriced_skus(use, prices(spark, price()), d("2024-02-02")).collect()] == ["NOPE"]


def test_scan_reads_only_needed_columns_and_gets_the_filters(spark, scratch):
    usage(spark, ("2024-02-01T00:00", 1)).write.parquet(f"{scratch}/usage")
    accounts = spark.createDataFrame([], "account_id string, " + ", ".join(f"{c} string" for c in cost.ACCOUNT_COLUMNS))
    feed = spark.read.parquet(f"{scratch}/usage").withColumns({
        "usage_metadata": F.struct(*[F.lit("x").alias(c) for c in ("job_id", "job_name", "warehouse_id", "cluster_id")]),
        "identity_metadata": F.struct(F.lit("u").alias("run_as")), "custom_tags": F.create_map(F.lit("a"), F.lit("b")),
    })
    rows = cost.dashboard_data(feed, prices(spark, price()), accounts, d("2024-02-02"))
    query = rows.select("usage_date", "usage_quantity")._jdf.queryExecution()
    scans = [line for line in query.executedPlan().toString().split("\n") if "FileScan" in line]
    assert len(scans) == 1
    pushed, schema = scans[0].split("PushedFilters: ")[1].split("ReadSchema: ")
    for wanted in ("IsNotNull(usage_date)", "IsNotNull(record_type)", "EqualTo(record_type,", "GreaterThanOrEqual(usage_date,"):
        assert wanted in pushed, pushed
    assert "workspace_id" not in schema and "usage_quantity" in schema
