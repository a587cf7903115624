"""Loading and normalising the two feeds and the small dimensions."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions.columns import day, since

USAGE_COLUMNS = [
    "record_id", "account_id", "workspace_id", "sku_name", "cloud", "usage_start_time",
    "usage_end_time", "usage_date", "custom_tags", "usage_unit", "usage_quantity",
    "usage_metadata", "identity_metadata", "record_type",
]


def _read(spark: SparkSession, path: str) -> DataFrame:
    """A parquet path, or a catalog table when the name holds no slash."""
    return spark.read.parquet(path) if "/" in path else spark.table(path)


def load_usage(spark: SparkSession, path: str) -> DataFrame:
    return usage_feed(_read(spark, path))


def usage_feed(raw: DataFrame) -> DataFrame:
    have = set(raw.columns)
    return raw.select(*[c for c in USAGE_COLUMNS if c in have]).withColumn(
        "usage_quantity", F.col("usage_quantity").cast("decimal(18,6)")
    )


def load_list_prices(spark: SparkSession, path: str) -> DataFrame:
    return list_prices(_read(spark, path))


def list_prices(raw: DataFrame) -> DataFrame:
    """Price intervals with the text prices parsed; unreadable text becomes null."""

    def price(field: str):
        return F.col(field).try_cast("decimal(20,10)")

    return raw.select(
        "price_start_time", "price_end_time", "account_id", "sku_name", "cloud", "currency_code", "usage_unit",
        price("pricing.default").alias("default_price"),
        price("pricing.promotional.default").alias("promotional_price"),
        price("pricing.effective_list.default").alias("effective_price"),
    )


def load_dimensions(config_sets: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Combine (account metadata, contracts) sets; the first set's metadata wins."""
    contracts = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [contracts for _, contracts in config_sets]
    )
    return config_sets[0][0], contracts


def resolve_auto_values(contracts: DataFrame, usage: DataFrame, as_of: date, lookback_days: int = 365) -> DataFrame:
    """Replace the text ``auto`` in account, cloud and dates by values from usage.

    The account and cloud with most usage in the lookback are taken, so the
    result does not depend on row order. The top-1 is one row whatever the size
    of the feed, so it is safe to broadcast.
    """
    top = (
        usage.filter(since(as_of, lookback_days))
        .groupBy("account_id", "cloud")
        .agg(F.sum("usage_quantity").alias("quantity"))
        .orderBy(F.desc("quantity"), "account_id", "cloud")
        .limit(1)
        .select(F.col("account_id").alias("auto_account"), F.col("cloud").alias("auto_cloud"), F.lit(1).alias("one"))
    )

    def auto(column: str):
        return F.col(column) == "auto"

    return (
        contracts.withColumn("one", F.lit(1))
        .join(F.broadcast(top), "one", "left")
        .withColumn("account_id", F.when(auto("account_id"), F.col("auto_account")).otherwise(F.col("account_id")))
        .withColumn(
            "cloud_provider",
            F.when(auto("cloud_provider"), F.coalesce("auto_cloud", F.lit("AWS"))).otherwise(F.col("cloud_provider")),
        )
        .withColumn(
            "start_date",
            F.when(auto("start_date"), day(as_of - timedelta(days=365))).otherwise(
                F.col("start_date").try_cast("date")
            ),
        )
        .withColumn(
            "end_date",
            F.when(auto("end_date"), day(as_of + timedelta(days=365))).otherwise(F.col("end_date").try_cast("date")),
        )
        .drop("one", "auto_account", "auto_cloud")
    )
