"""Plan shapes that matter when one key holds a large part of the rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meterline.operators import contracts as c
from meterline.operators import cost, reports
from meterline.sources import writers
from tests.helpers import contract, contracts, d, price, prices

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def small_limits(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def _hot_usage(spark, rows=60000):
    """Half of all records belong to one SKU, one account and one day."""
    hot = F.col("id") % 2 == 0
    return spark.range(rows, numPartitions=8).select(
        F.when(hot, "A").otherwise(F.concat(F.lit("A"), (F.col("id") % 50).cast("string"))).alias("account_id"),
        F.col("id").cast("string").alias("workspace_id"),
        F.when(hot, "HOT").otherwise(F.concat(F.lit("S"), (F.col("id") % 50).cast("string"))).alias("sku_name"),
        F.lit("AWS").alias("cloud"), F.lit("2024-02-01").cast("timestamp").alias("usage_end_time"), F.lit("DBU").alias("usage_unit"),
        F.when(hot, F.lit(d("2024-02-01"))).otherwise(F.date_add(F.lit(d("2024-02-01")), (F.col("id") % 20).cast("int"))).alias("usage_date"),
        F.lit(1).cast("decimal(18,6)").alias("usage_quantity"), F.lit("ORIGINAL").alias("record_type"),
    )


def _final_plan(df) -> str:
    """The adaptive plan after it has run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_sku_is_split_when_prices_cannot_be_broadcast(small_limits):
    spark = small_limits
    table = prices(spark, price("HOT"), *[price(f"S{i}") for i in range(50)])
    joined = cost.cost_columns(cost.price_interval_join(_hot_usage(spark), table))
    plan = _final_plan(joined.select("workspace_id", "actual_cost"))
    assert "SortMergeJoin(skew=true)" in plan
    assert joined.count() == 60000 and joined.filter("actual_cost IS NULL").count() == 0


def test_contracts_meet_day_totals_not_rows(spark):
    dash = _hot_usage(spark).select("account_id", F.col("cloud").alias("cloud_provider"), "usage_date", F.lit(1).cast("decimal(18,6)").alias("actual_cost"))
    rows = c.contract_burndown(contracts(spark, contract()), dash, d("2024-06-30"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # the aggregate is below the join
    assert rows.agg(F.max("cumulative_cost")).first()[0] == 30000


def test_day_prices_are_joined_after_collapsing(spark):
    usage = _hot_usage(spark)
    daily = cost.cost_with_fallback_price(usage, prices(spark, price("HOT")), d("2024-06-30"))
    plan = daily._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.index("Join")
    assert daily.agg(F.sum("daily_cost")).first()[0] == pytest.approx(30000 * 1.8 + 30000 * 0.5)


def test_top_k_does_not_sort_everything(spark):
    dash = _hot_usage(spark).select(F.col("cloud").alias("cloud_provider"), "workspace_id", "sku_name", "usage_date", "usage_quantity", F.lit(1).cast("decimal(18,6)").alias("actual_cost"))
    plan = reports.top_workspaces(dash, d("2024-02-20"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_partitioned_write_splits_a_hot_day(small_limits, scratch):
    spark = small_limits
    writers.write_partitioned(_hot_usage(spark), f"{scratch}/t")
    back = spark.read.parquet(f"{scratch}/t").filter(F.col("usage_date") == F.lit(d("2024-02-01")))
    assert back.select(F.input_file_name()).distinct().count() > 1
    assert spark.read.parquet(f"{scratch}/t").count() == 60000
