"""Cost enrichment: price usage by validity interval, classify, attach accounts."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.functions.columns import before, compute_category, day, dbl, product_category, ratio, rounded, since
from meterline.params import DEFAULT_UNIT_RATE, FALLBACK_UNIT_PRICE, LOOKBACK_DAYS

ACCOUNT_COLUMNS = [
    "customer_name", "business_unit_l0", "business_unit_l1", "business_unit_l2", "business_unit_l3",
    "account_executive", "solutions_architect",
]


def price_interval_join(
    usage: DataFrame,
    prices: DataFrame,
    on: tuple[str, ...] = ("sku_name", "cloud", "usage_unit"),
    time: str = "usage_end_time",
    date_grain: bool = False,
    index_months: int | None = None,
) -> DataFrame:
    """Left join usage to the price interval ``[start, end)`` that holds ``time``.

    With ``index_months`` prices are indexed by spans of so many months (see
    ``price_index``), which pays where a SKU has a long history of prices.

    No broadcast is forced: Catalyst broadcasts the price table while its known
    size is under ``autoBroadcastJoinThreshold``. Beyond that the equality keys
    make it a sort-merge join, in which AQE splits a SKU that holds a large part
    of the usage (the usage side of a left join may be split freely).
    """
    if index_months:
        return _indexed_join(usage, prices, on, time, date_grain, index_months)
    start, end = F.col("_p_start"), F.col("_p_end")
    side = prices.select(
        *[F.col(c).alias(f"_p_{c}") for c in on],
        (F.to_date("price_start_time") if date_grain else F.col("price_start_time")).alias("_p_start"),
        (F.to_date("price_end_time") if date_grain else F.col("price_end_time")).alias("_p_end"),
        "default_price", "effective_price",
    )
    keys = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p_{c}") for c in on])
    moment = F.col(time)
    return usage.join(side, keys & (moment >= start) & (end.isNull() | (moment < end)), "left").drop(
        "_p_start", "_p_end", *[f"_p_{c}" for c in on]
    )


def _span(moment: Column, months: int) -> Column:
    return F.floor((F.year(moment) * 12 + F.month(moment) - 1) / months)


def price_index(prices: DataFrame, on: tuple[str, ...], date_grain: bool = False, months: int = 12) -> tuple[DataFrame, int | None]:
    """One row for each key and span of months with its intervals in order, and the last span, which never ends.

    An interval is in every span it touches. ``disjoint`` tells whether the intervals of a
    row leave at most one for any moment. A row is bounded by the price changes within its span.
    """
    grain = F.to_date if date_grain else (lambda c: F.col(c))
    start, end = F.col("_p_start"), F.col("_p_end")
    side = prices.select(*[F.col(c).alias(f"_p_{c}") for c in on], grain("price_start_time").alias("_p_start"), grain("price_end_time").alias("_p_end"), "default_price", "effective_price")
    side = side.filter(start.isNotNull() & (end.isNull() | (end > start)))
    last = side.agg(F.max(_span(start, months))).first()[0]
    spans = F.sequence(_span(start, months), F.least(F.coalesce(_span(end, months), F.lit(last)), F.lit(last)))
    interval = F.struct(start.alias("start"), end.alias("end"), "default_price", "effective_price")
    rows = side.withColumn("_p_span", F.explode(spans)).groupBy(*[f"_p_{c}" for c in on], "_p_span").agg(F.array_sort(F.collect_list(interval)).alias("_p_intervals"))
    n = F.size("_p_intervals")
    follow = F.zip_with(F.slice("_p_intervals", 1, n - 1), F.slice("_p_intervals", 2, n), lambda a, b: F.coalesce(a.end <= b.start, b.start.isNull() & a.start.isNotNull()))
    return rows.withColumn("_p_disjoint", F.when(n < 2, True).otherwise(F.forall(F.slice(follow, 1, n - 1), lambda x: x))), last


def _indexed_join(usage: DataFrame, prices: DataFrame, on: tuple[str, ...], time: str, date_grain: bool, months: int) -> DataFrame:
    """The interval join by equality of key and span, then bisection in the row: no usage row is compared with all prices of its SKU."""
    index, last = price_index(prices, on, date_grain, months)
    moment, intervals = F.col(time), F.col("_p_intervals")
    keys = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p_{c}") for c in on])
    met = usage.join(index, keys & (F.least(_span(moment, months), F.lit(last)) == F.col("_p_span")), "left")
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    begun = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= F.size(intervals)) & (F.element_at(intervals, low + step).start <= moment), low + step).otherwise(low))
    holds = lambda p: (p.start <= moment) & (p.end.isNull() | (moment < p.end))
    hit = F.when(F.col("_p_disjoint"), F.filter(F.slice(intervals, F.greatest(begun, F.lit(1)), 1), holds)).otherwise(F.filter(intervals, holds))
    found = met.select(*usage.columns, F.explode_outer(hit).alias("_p"))
    return found.select(*usage.columns, "_p.default_price", "_p.effective_price")


def cost_columns(priced: DataFrame) -> DataFrame:
    """Unit price, list cost and actual cost; all null where no interval matched."""
    quantity = F.col("usage_quantity")
    return (
        priced.withColumn("price_per_unit", F.col("effective_price"))
        .withColumn("list_cost", quantity * F.col("default_price"))
        .withColumn("actual_cost", quantity * F.col("effective_price"))
        .drop("default_price", "effective_price")
    )


def with_product_category(df: DataFrame) -> DataFrame:
    return df.withColumn("product_category", product_category(F.col("sku_name")))


def flatten_metadata(df: DataFrame) -> DataFrame:
    meta = ["job_id", "job_name", "warehouse_id", "cluster_id"]
    return df.withColumns(
        {**{c: F.col(f"usage_metadata.{c}") for c in meta}, "run_as": F.col("identity_metadata.run_as")}
    ).drop("usage_metadata", "identity_metadata")


def attach_account(df: DataFrame, accounts: DataFrame) -> DataFrame:
    return df.join(accounts.select("account_id", *ACCOUNT_COLUMNS), "account_id", "left")


def dashboard_data(
    usage: DataFrame, prices: DataFrame, accounts: DataFrame, as_of: date, lookback_days: int | None = LOOKBACK_DAYS
) -> DataFrame:
    """Enriched original usage rows of the lookback window, or of all history where it is None.

    The filters come first, so they reach the scan and both joins see only the
    rows that stay.
    """
    window = F.col("usage_date") <= day(as_of) if lookback_days is None else since(as_of, lookback_days)
    recent = usage.filter(window).filter(F.col("record_type") == "ORIGINAL")
    rows = attach_account(
        flatten_metadata(with_product_category(cost_columns(price_interval_join(recent, prices)))), accounts
    )
    return rows.select(
        "usage_date", "account_id", *ACCOUNT_COLUMNS, "workspace_id", F.col("cloud").alias("cloud_provider"),
        "sku_name", "usage_unit", F.col("usage_quantity").cast("decimal(18,6)").alias("usage_quantity"),
        F.col("price_per_unit").cast("decimal(20,10)").alias("price_per_unit"), "list_cost", "actual_cost",
        "product_category", "job_id", "job_name", "warehouse_id", "cluster_id", "run_as", "custom_tags",
    )


def priced_originals(usage: DataFrame, prices: DataFrame, as_of: date, days: int) -> DataFrame:
    """Costed original rows that still carry the usage structs."""
    recent = usage.filter(since(as_of, days)).filter(F.col("record_type") == "ORIGINAL")
    return cost_columns(price_interval_join(recent, prices))


def _daily_quantities(usage: DataFrame, extra: list[str]) -> DataFrame:
    """Collapse usage to one row per day and price key before any price lookup.

    Day-grain validity is the same for every record of a day, and quantity sums
    are additive, so the cost totals are unchanged while the join sees far fewer
    rows.
    """
    keys = list(dict.fromkeys([*extra, "sku_name", "cloud", "usage_date"]))
    return usage.groupBy(*keys).agg(F.sum("usage_quantity").cast("decimal(28,6)").alias("usage_quantity"))


def cost_with_fallback_price(
    usage: DataFrame,
    prices: DataFrame,
    as_of: date,
    lookback_days: int = LOOKBACK_DAYS,
    match_account: bool = False,
    by: tuple[str, ...] = ("account_id",),
) -> DataFrame:
    """Daily cost with effective, then default, then a flat price; ``as_of`` excluded."""
    window = F.col("usage_date").between(before(as_of, lookback_days), before(as_of, 1))
    on = ("account_id", "sku_name", "cloud") if match_account else ("sku_name", "cloud")
    need = [*by, "account_id"] if match_account else list(by)
    daily = _daily_quantities(usage.filter(window), need)
    priced = price_interval_join(daily, prices, on=on, time="usage_date", date_grain=True)
    unit = F.coalesce("effective_price", "default_price", F.lit(FALLBACK_UNIT_PRICE).cast("decimal(20,10)"))
    return priced.groupBy(*by, "usage_date").agg(dbl(F.sum(F.col("usage_quantity") * unit)).alias("daily_cost"))


def net_corrections(usage: DataFrame, dims: list[str]) -> DataFrame:
    """Net quantity per dimension over originals and corrections; only positive nets stay."""
    return (
        usage.groupBy(*dims)
        .agg(F.sum("usage_quantity").alias("net_quantity"), F.count("*").alias("record_count"))
        .filter(F.col("net_quantity") > 0)
    )


def zero_default_cost(usage: DataFrame, prices: DataFrame, accounts: DataFrame, as_of: date, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Export variant: default price or zero, matched on the usage day, all record types."""
    rows = price_interval_join(
        usage.filter(since(as_of, days)), prices, on=("sku_name", "cloud"), time="usage_date", date_grain=True
    )
    amount = F.col("usage_quantity") * F.coalesce("default_price", F.lit(0).cast("decimal(20,10)"))
    return with_product_category(attach_account(rows, accounts)).select(
        "usage_date", "account_id", *ACCOUNT_COLUMNS, "workspace_id", F.col("cloud").alias("cloud_provider"), "sku_name",
        "usage_unit", "usage_quantity", amount.alias("actual_cost"), F.col("default_price").alias("list_price_per_unit"),
        F.col("default_price").alias("discounted_price_per_unit"), amount.alias("list_cost"),
        amount.alias("discounted_cost"), "product_category",
    )


def zero_default_daily(usage: DataFrame, prices: DataFrame, as_of: date, days: int, by: list[str]) -> DataFrame:
    """Day totals of :func:`zero_default_cost`, collapsed before the price lookup."""
    rows = price_interval_join(
        _daily_quantities(usage.filter(since(as_of, days)), by), prices, on=("sku_name", "cloud"), time="usage_date",
        date_grain=True,
    )
    amount = F.col("usage_quantity") * F.coalesce("default_price", F.lit(0).cast("decimal(20,10)"))
    return rows.groupBy(*dict.fromkeys([*by, "usage_date"])).agg(
        F.sum("usage_quantity").alias("quantity"), F.sum(amount).alias("cost")
    )


def estimated_list_cost(df: DataFrame) -> DataFrame:
    rate = F.coalesce("price_per_unit", F.lit(DEFAULT_UNIT_RATE).cast("decimal(20,10)"))
    return df.withColumn("estimated_list_cost", F.coalesce("list_cost", F.col("usage_quantity") * rate))


def effective_discount(df: DataFrame) -> DataFrame:
    return df.withColumn("effective_discount", 1 - ratio(F.col("actual_cost"), F.col("list_cost")))


def compute_vs_other(dashboard: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Four-way category split; the share window runs over at most four rows."""
    totals = (
        dashboard.filter(since(as_of, days))
        .groupBy(compute_category(F.col("sku_name")).alias("category"))
        .agg(F.sum("actual_cost").alias("total"))
    )
    return totals.select(
        "category", F.round("total", 2).alias("cost"),
        rounded(ratio(F.col("total") * 100, F.sum("total").over(W.partitionBy())), 1).alias("pct"),
    )


def detailed_usage(usage: DataFrame, prices: DataFrame, as_of: date, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Rollup per day, account, workspace, cloud, SKU and unit.

    Records are counted by id where the feed has ids, else by row.
    """
    keys = ["usage_date", "account_id", "workspace_id", "cloud", "sku_name", "usage_unit"]
    records = F.countDistinct("record_id") if "record_id" in usage.columns else F.count("*")
    return (
        priced_originals(usage, prices, as_of, days)
        .groupBy(*keys)
        .agg(
            F.sum("usage_quantity").alias("total_usage"), F.sum("list_cost").alias("list_cost"),
            F.sum("actual_cost").alias("actual_cost"), records.alias("record_count"),
        )
    )
