"""Small frames shared by the tests."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from meterline.sources.readers import list_prices

CONTRACT = (
    "contract_id string, account_id string, cloud_provider string, start_date date, end_date date, "
    "total_value decimal(18,2), currency string, commitment_type string, status string, notes string"
)
PRICE = (
    "price_start_time timestamp, price_end_time timestamp, account_id string, sku_name string, cloud string, currency_code string, "
    "usage_unit string, pricing struct<default:string,promotional:struct<default:string>,effective_list:struct<default:string>>"
)
COSTS = "account_id string, cloud_provider string, workspace_id string, sku_name string, usage_date date, usage_quantity decimal(18,6), actual_cost decimal(18,6)"
USAGE = (
    "account_id string, workspace_id string, sku_name string, cloud string, usage_end_time timestamp, usage_date date, "
    "usage_unit string, usage_quantity decimal(18,6), record_type string"
)


def d(text: str) -> date:
    return date.fromisoformat(text)


def contract(cid="C1", value=100000, start="2024-01-01", end="2024-12-31", status="ACTIVE", account="A", cloud="AWS"):
    return (cid, account, cloud, d(start), d(end), Decimal(value), "USD", "SPEND", status, "")


def contracts(spark, *rows):
    return spark.createDataFrame(list(rows), CONTRACT)


def costs(spark, rows):
    """(date, cost) or (date, cost, workspace) or a full row for account A on AWS."""
    full = []
    for row in rows:
        day, amount, *rest = row
        full.append(("A", "AWS", rest[0] if rest else "w1", "X_SQL", d(day), Decimal(1), None if amount is None else Decimal(str(amount))))
    return spark.createDataFrame(full, COSTS)


def daily_run(spark, start: str, days: int, amount):
    first = d(start)
    value = amount if callable(amount) else (lambda i: amount)
    return costs(spark, [((first + timedelta(days=i)).isoformat(), value(i)) for i in range(days)])


def price(sku="X", start="2024-01-01", end=None, default="2.0", effective="1.8", account=None, unit="DBU"):
    at = lambda t: None if t is None else datetime.fromisoformat(t)
    return (at(start), at(end), account, sku, "AWS", "USD", unit, (default, (default,), (effective,)))


def prices(spark, *rows):
    return list_prices(spark.createDataFrame(list(rows), PRICE))


def usage(spark, *rows):
    """(end time, quantity, sku, record type) with defaults after the first two."""
    full = []
    for when, quantity, *rest in rows:
        at = datetime.fromisoformat(when)
        full.append(("A", "w1", rest[0] if rest else "X", "AWS", at, at.date(), "DBU", Decimal(quantity), rest[1] if len(rest) > 1 else "ORIGINAL"))
    return spark.createDataFrame(full, USAGE)


def by(df, key):
    return {row[key]: row for row in df.collect()}


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def tiers(spark, rows):
    from meterline.sources.tiers import TIER_SCHEMA

    return spark.createDataFrame(
        [(t, t, Decimal(lo), None if hi is None else Decimal(hi), y, Decimal(str(rate)), None, None, None, "") for t, lo, hi, y, rate in rows], TIER_SCHEMA
    )


def scenarios_of(df, cid="C1"):
    return sorted((r.kind, float(r.discount_pct), r.potential_duration_years) for r in df.filter(F.col("contract_id") == cid).collect())
