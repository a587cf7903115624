"""Adapter: derives billing-shaped tables from an order/lineitem star schema.

Only this module knows the star schema. ``Star`` hands out lazy frames for the
raw feed and keeps the small dimensions and the results of finished stages as
stored tables, the way a scheduled refresh would leave them.
"""

from __future__ import annotations

import hashlib
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from meterline.operators import contracts as contract_ops
from meterline.operators import cost, forecast, rollup, whatif
from meterline.plans import commitment as commitment_plan
from meterline.session import shared_folder, stored
from meterline.sources.readers import list_prices, usage_feed
from meterline.sources.tiers import default_tiers

AS_OF = date(2001, 6, 30)
TIERS_FROM = date(2000, 1, 1)

# Fixed values of the fixture rules.
SKU_SUFFIXES = ["ALL_PURPOSE", "JOBS", "DLT", "SQL", "INFERENCE", "VECTOR_SEARCH", "SERVERLESS", "STORAGE"]
CLOUDS = ["AWS", "AZURE", "GCP"]
VALUE_FACTORS = [0.7, 0.87, 1.0, 1.35, 1.8]
PRICE_YEARS = list(range(1995, 2002))

_written: dict[tuple[str, str], T.StructType] = {}


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def star_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage records: the fact table is joined once to each dimension.

    Orders meet customers before the fact table does, so the widest shuffle
    carries two short columns per order.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = (
        read("orders")
        .join(read("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey", F.col("c_mktsegment").alias("account_id"), "o_orderpriority",
            F.concat(F.lit("user_"), F.pmod("o_custkey", F.lit(40)).cast("string")).alias("run_as"),
        )
    )
    parts = read("part").select("p_partkey", "p_type", F.pmod(F.col("p_size"), F.lit(8)).alias("k"))
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
    k = F.col("k")
    retracted = F.col("l_returnflag") == "R"
    quantity = F.col("l_quantity").cast("decimal(18,6)")
    job = F.pmod("l_partkey", F.lit(50)).cast("string")
    ended = F.col("l_shipdate").cast("timestamp")
    return usage_feed(
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "account_id",
            # Some suppliers move to a workspace of their own near the end of the data.
            F.concat(
                F.when((F.pmod("l_suppkey", F.lit(5)) == 1) & (F.col("l_shipdate") >= "2001-06-25"), "week_")
                .when((F.pmod("l_suppkey", F.lit(5)) == 2) & (F.col("l_shipdate") >= "2001-06-05"), "month_").otherwise(""),
                F.col("l_suppkey").cast("string"),
            ).alias("workspace_id"),
            F.concat("p_type", F.lit("_"), _pick(SKU_SUFFIXES, k)).alias("sku_name"),
            _pick(CLOUDS, F.pmod("l_suppkey", F.lit(3))).alias("cloud"),
            (ended - F.expr("INTERVAL 1 HOUR")).alias("usage_start_time"),
            ended.alias("usage_end_time"),
            F.to_date("l_shipdate").alias("usage_date"),
            F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("custom_tags"),
            F.when(k == 7, "GB").otherwise("DBU").alias("usage_unit"),
            F.when(retracted, -quantity).otherwise(quantity).alias("usage_quantity"),
            F.struct(
                F.when(k < 2, F.concat(F.lit("cluster_"), F.pmod("l_partkey", F.lit(30)).cast("string"))).alias("cluster_id"),
                F.when(k == 1, F.concat(F.lit("job_"), job)).alias("job_id"),
                F.when(k == 3, F.concat(F.lit("wh_"), F.pmod("l_partkey", F.lit(20)).cast("string"))).alias("warehouse_id"),
                F.when(k == 1, F.col("l_orderkey").cast("string")).alias("job_run_id"),
                F.when((k == 1) & (F.pmod("l_partkey", F.lit(50)) >= 5), F.concat(F.lit("nightly_"), job)).alias("job_name"),
            ).alias("usage_metadata"),
            F.struct(F.col("run_as")).alias("identity_metadata"),
            F.when(retracted, "RETRACTION").otherwise("ORIGINAL").alias("record_type"),
        )
    )


def star_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw price intervals: one per SKU, cloud and price year."""
    skus = (
        spark.read.parquet(f"{sf_dir}/part.parquet")
        .select("p_type", F.pmod(F.col("p_size"), F.lit(8)).alias("k"))
        .distinct()
    )
    k, year = F.col("k"), F.col("year")
    price = (F.lit(2) + F.lit(1.5).cast("decimal(4,2)") * k + F.lit(0.25).cast("decimal(4,2)") * (year - 1995)).cast("decimal(20,10)")
    july = lambda y: F.make_date(y, F.lit(7), F.lit(1)).cast("timestamp")
    text = lambda c: c.cast("decimal(20,10)").cast("string")
    effective = price * F.lit(0.9).cast("decimal(3,2)")
    return (
        skus.withColumn("cloud", F.explode(F.array(*[F.lit(c) for c in CLOUDS])))
        .withColumn("year", F.explode(F.sequence(F.lit(PRICE_YEARS[0]), F.lit(PRICE_YEARS[-1]))))
        .select(
            july(year).alias("price_start_time"),
            F.when(year < PRICE_YEARS[-1], july(year + 1)).alias("price_end_time"),
            F.lit(None).cast("string").alias("account_id"),
            F.concat("p_type", F.lit("_"), _pick(SKU_SUFFIXES, k)).alias("sku_name"),
            "cloud",
            F.lit("USD").alias("currency_code"),
            F.when(k == 7, "GB").otherwise("DBU").alias("usage_unit"),
            F.struct(
                text(price).alias("default"),
                F.struct(text(price).alias("default")).alias("promotional"),
                F.struct(text(effective).alias("default")).alias("effective_list"),
            ).alias("pricing"),
        )
    )


def star_accounts(spark: SparkSession, sf_dir: str, as_of: date = AS_OF) -> DataFrame:
    """One metadata row per segment and one account that has no contracts."""
    size = F.length("account_id")
    present = F.col("account_id") != "PROSPECT"
    day0 = F.lit(as_of).cast("timestamp")
    return (
        spark.read.parquet(f"{sf_dir}/customer.parquet")
        .select(F.col("c_mktsegment").alias("account_id"))
        .distinct()
        .unionByName(spark.createDataFrame([("PROSPECT",)], "account_id string"))
        .select(
            "account_id",
            F.concat("account_id", F.lit(" Corp")).alias("customer_name"),
            _pick(["AMER", "EMEA", "APAC"], F.pmod(size, F.lit(3))).alias("business_unit_l0"),
            F.concat(F.lit("area_"), size.cast("string")).alias("business_unit_l1"),
            F.when(F.pmod(size, F.lit(2)) == 1, F.lit("central")).alias("business_unit_l2"),
            F.substring("account_id", 1, 3).alias("business_unit_l3"),
            F.when(present, F.concat(F.lit("ae_"), F.substring("account_id", 1, 1))).alias("account_executive"),
            F.when(size != 10, F.concat(F.lit("sa_"), F.substring("account_id", 2, 1))).alias("solutions_architect"),
            F.lit(None).cast("string").alias("delivery_solutions_architect"),
            F.concat(F.lit("region_"), F.pmod(size, F.lit(2)).cast("string")).alias("region"),
            F.col("account_id").alias("industry"),
            (day0 - F.expr("INTERVAL 400 DAYS")).alias("created_at"),
            F.date_sub(F.lit(as_of), (size - 7) * 40).cast("timestamp").alias("updated_at"),
        )
    )


def star_contracts(spark: SparkSession, priced: DataFrame, as_of: date = AS_OF) -> DataFrame:
    """Numbered contracts sized against their own consumption, plus edge rows.

    The numbering window runs over one row per account and cloud.
    """
    start = date(2000, 1, 1)
    spent = (
        priced.filter(F.col("usage_date").between(F.lit(start), F.lit(as_of)))
        .groupBy("account_id", "cloud_provider")
        .agg(F.sum("actual_cost").cast("double").alias("spent"))
        .withColumn("i", F.row_number().over(W.orderBy("account_id", "cloud_provider")))
    )
    end = F.when(F.pmod("i", F.lit(3)) < 2, F.lit(date(2001, 12, 31))).otherwise(F.lit(date(2002, 12, 31)))
    share = F.datediff(F.lit(as_of), F.lit(start)) / F.datediff(end, F.lit(start)).cast("double")
    factor = F.element_at(F.array(*[F.lit(v) for v in VALUE_FACTORS]), F.pmod("i", F.lit(5)) + 1)
    numbered = spent.select(
        F.concat(F.lit("C"), F.lpad(F.col("i").cast("string"), 3, "0")).alias("contract_id"),
        "account_id", "cloud_provider",
        F.lit(start).alias("start_date"), end.alias("end_date"),
        (F.round(F.col("spent") / share * factor / 100) * 100).cast("decimal(18,2)").alias("total_value"),
        F.lit("USD").alias("currency"), F.lit("SPEND").alias("commitment_type"),
        F.lit("ACTIVE").alias("status"), F.concat(F.lit("sized x"), factor.cast("string")).alias("notes"),
    )
    edge = spark.createDataFrame(
        [
            ("C901", "BUILDING", "AWS", date(1999, 1, 1), date(1999, 12, 31), 50000, "EXPIRED"),
            ("C902", "MACHINERY", "GCP", date(2001, 9, 1), date(2003, 8, 31), 250000, "PENDING"),
            ("C903", "DORMANT", "AWS", date(2001, 1, 1), date(2001, 12, 31), 60000, "ACTIVE"),
            ("C904", "BUILDING", "AWS", date(2000, 7, 1), date(2001, 5, 31), 100000, "ACTIVE"),
        ],
        "contract_id string, account_id string, cloud_provider string, start_date date, end_date date, v int, status string",
    ).select(
        "contract_id", "account_id", "cloud_provider", "start_date", "end_date",
        F.col("v").cast("decimal(18,2)").alias("total_value"), F.lit("USD").alias("currency"),
        F.lit("SPEND").alias("commitment_type"), "status", F.lit("edge row").alias("notes"),
    )
    stamp = F.lit(as_of).cast("timestamp")
    return numbered.unionByName(edge).withColumn("created_at", stamp).withColumn("updated_at", stamp)


class Star:
    """Billing tables over one star-schema folder."""

    _open: dict[tuple[str, str], Star] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Star:
        """The frames of a session and folder, planned once and shared by its queries.

        The frames are lazy; only their plans are kept, no rows.
        """
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
        if key not in cls._open:
            cls._open[key] = cls(spark, sf_dir)
        return cls._open[key]

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: date = AS_OF):
        self.spark, self.sf_dir, self.as_of = spark, sf_dir.rstrip("/"), as_of

    def folder(self, name: str) -> str:
        tag = hashlib.sha256(self.sf_dir.encode()).hexdigest()[:12]
        return f"{shared_folder(self.spark)}/{self.spark.sparkContext.applicationId}/{tag}/{name}"

    def keep(self, name: str, build) -> DataFrame:
        """Write a stage result the first time, read the stored table afterwards."""
        path = self.folder(name)
        key = (self.spark.sparkContext.applicationId, path)
        if key not in _written:
            _written[key] = stored(build(), path).schema
        return self.spark.read.schema(_written[key]).parquet(path)

    # raw feed and dimensions
    @cached_property
    def usage(self) -> DataFrame:
        return star_usage(self.spark, self.sf_dir)

    @cached_property
    def prices(self) -> DataFrame:
        return list_prices(self.keep("list_prices", lambda: star_prices(self.spark, self.sf_dir)))

    @cached_property
    def accounts(self) -> DataFrame:
        return self.keep("account_metadata", lambda: star_accounts(self.spark, self.sf_dir, self.as_of))

    @cached_property
    def contracts(self) -> DataFrame:
        return self.keep("contracts", lambda: star_contracts(self.spark, self.long_history, self.as_of))

    @cached_property
    def tiers(self) -> DataFrame:
        return default_tiers(self.spark, effective=TIERS_FROM)

    # enriched rows
    @cached_property
    def dashboard(self) -> DataFrame:
        return cost.dashboard_data(self.usage, self.prices, self.accounts, self.as_of)

    @cached_property
    def long_history(self) -> DataFrame:
        return cost.dashboard_data(self.usage, self.prices, self.accounts, self.as_of, None)

    # stored stage results
    @cached_property
    def rollup(self) -> rollup.Rollup:
        """Day measures and bitmaps of the dashboard, from one pass over it."""
        cells = self.keep("rollup_cells", lambda: rollup.cells(self.dashboard))
        ids = {m: self.keep(f"rollup_{m}", lambda m=m: rollup.dictionary(cells, m)) for m in rollup.MEMBERS}
        return rollup.Rollup(self.keep("rollup_measures", lambda: rollup.measures(cells)), self.keep("rollup_members", lambda: rollup.members(cells, ids)))

    @cached_property
    def burndown(self) -> DataFrame:
        return self.keep("contract_burndown", lambda: contract_ops.contract_burndown(self.contracts, self.long_history, self.as_of))

    @cached_property
    def summary(self) -> DataFrame:
        return contract_ops.burndown_summary(self.burndown, self.as_of)

    @cached_property
    def features(self) -> DataFrame:
        def build():
            daily = forecast.contract_daily_costs(self.contracts, self.long_history, self.as_of)
            return forecast.forecast_features(daily)

        return self.keep("forecast_features", build)

    @cached_property
    def forecast(self) -> DataFrame:
        return self.keep("contract_forecast", lambda: forecast.forecast_output(self.burndown, self.contracts, self.features))

    @cached_property
    def scenarios(self) -> DataFrame:
        return self.keep("discount_scenarios", lambda: whatif.generate_scenarios(self.contracts, self.tiers))

    @cached_property
    def scenario_burndown(self) -> DataFrame:
        return self.keep("scenario_burndown", lambda: whatif.full_scenario_burndown(self.scenarios, self.burndown))

    @cached_property
    def scenario_forecast(self) -> DataFrame:
        return self.keep("scenario_forecast", lambda: whatif.scenario_forecast(self.scenarios, self.forecast, self.contracts))

    @cached_property
    def scenario_summary(self) -> DataFrame:
        return self.keep(
            "scenario_summary",
            lambda: whatif.scenario_summary(self.scenarios, self.contracts, self.scenario_burndown, self.scenario_forecast),
        )

    @cached_property
    def account_daily(self) -> DataFrame:
        """Daily cost per account with fallback prices, as the optimiser reads it."""
        return self.keep("account_daily", lambda: cost.cost_with_fallback_price(self.usage, self.prices, self.as_of))

    @cached_property
    def commitment(self) -> commitment_plan.CommitmentStages:
        return commitment_plan.stages(self.account_daily, self.tiers, self.as_of, start=self.as_of, years=(1, 2, 3),
                                      store=lambda name, df: self.keep(name, lambda: df))
