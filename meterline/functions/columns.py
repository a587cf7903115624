"""Column expressions used across operators. All stay inside the JVM."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.params import MAX_PROJECTED_END, PACE, PaceThresholds

# SKU name fragments and the category each one stands for, first match wins.
PRODUCT_CATEGORIES = [
    (("ALL_PURPOSE",), "All Purpose Compute"),
    (("JOBS",), "Jobs Compute"),
    (("DLT", "DELTA_LIVE_TABLES"), "Delta Live Tables"),
    (("SQL",), "SQL Warehouse"),
    (("INFERENCE", "MODEL_SERVING"), "Model Serving"),
    (("VECTOR_SEARCH",), "Vector Search"),
    (("SERVERLESS",), "Serverless"),
]
COMPUTE_CATEGORIES = [
    (("ALL_PURPOSE", "JOBS"), "Compute"),
    (("SQL",), "SQL"),
    (("DLT",), "DLT"),
]


def day(value: date) -> Column:
    return F.lit(value)


def before(as_of: date, days: int) -> Column:
    """The literal date ``days`` before ``as_of``; folds into a pushed filter."""
    return F.lit(as_of - timedelta(days=days))


def since(as_of: date, days: int, column: str = "usage_date") -> Column:
    """Lookback window that ends on ``as_of``."""
    return F.col(column).between(before(as_of, days), day(as_of))


def dbl(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("double")


def money(column: Column | str) -> Column:
    """An amount as a decimal, to be added up and multiplied exactly; doubles are taken by their decimal value."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("decimal(24,10)")


def ratio(num: Column, den: Column) -> Column:
    """Null instead of an error when the divisor is zero."""
    return dbl(num) / F.nullif(dbl(den), F.lit(0.0))


def rounded(column: Column | str, digits: int) -> Column:
    """Half-up rounding of a double by its decimal value.

    A mean of 9.575 is stored slightly below that; rounded as a decimal it
    gives 9.58, as the same arithmetic on decimals would.
    """
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("decimal(30,10)"), digits).cast("double")


def month_of(column: Column | str) -> Column:
    return F.trunc(column, "month")


def _match(sku: Column, rules, default: str) -> Column:
    first, *rest = [
        (reduce(lambda a, b: a | b, [sku.contains(part) for part in parts]), label)
        for parts, label in rules
    ]
    out = F.when(*first)
    for condition, label in rest:
        out = out.when(condition, label)
    return out.otherwise(default)


def product_category(sku: Column) -> Column:
    return _match(sku, PRODUCT_CATEGORIES, "Other")


def compute_category(sku: Column) -> Column:
    return _match(sku, COMPUTE_CATEGORIES, "Other")


def pace_status(consumed: Column, elapsed: Column, t: PaceThresholds = PACE) -> Column:
    """Pace class of a consumed share against an elapsed share (strict limits).

    A null share on either side leaves the contract ON PACE.
    """
    return (
        F.when(consumed > elapsed * t.over, "OVER PACE")
        .when(consumed > elapsed * t.above, "ABOVE PACE")
        .when(consumed < elapsed * t.under, "UNDER PACE")
        .otherwise("ON PACE")
    )


def whole_days(number: Column, limit: int = 200000) -> Column:
    """Truncate towards zero; null beyond the limit, where no calendar date can be meant."""
    return F.when(F.abs(number) <= limit, number).cast("int")


def projected_end_date(start, commitment, days, consumed, end, cap: date = MAX_PROJECTED_END) -> Column:
    """Date on which the commitment is used up at the average pace so far."""
    active = (consumed > 0) & (days > 0)
    reach = F.date_add(start, whole_days(dbl(commitment) * days / F.nullif(dbl(consumed), F.lit(0.0))))
    return F.least(F.when(active, reach).otherwise(end), F.lit(cap))


def urgency(days_left: Column) -> Column:
    return (
        F.when(days_left <= 30, "URGENT")
        .when(days_left <= 60, "SOON")
        .when(days_left <= 90, "UPCOMING")
        .otherwise("OK")
    )


def mape_grade(mape: Column) -> Column:
    return (
        F.when(mape < 10, "excellent")
        .when(mape < 20, "good")
        .when(mape < 30, "acceptable")
        .when(mape.isNotNull(), "investigate")
    )


def risk_level(utilization: Column) -> Column:
    """Risk class; a share that equals a limit up to the last bits counts as equal."""
    utilization = F.round(utilization, 9)
    return F.when(utilization >= 0.95, "LOW").when(utilization >= 0.85, "MEDIUM").otherwise("HIGH")


def freshness_status(days_behind: Column, ok: int = 2, warning: int = 5) -> Column:
    return F.when(days_behind <= ok, "OK").when(days_behind <= warning, "WARNING").otherwise("CRITICAL")


def business_unit_path(*levels: str) -> Column:
    return F.concat_ws(" > ", *[F.col(level) for level in levels])


def grouped_number(column: Column, digits: int = 0, prefix: str = "USD ") -> Column:
    return F.concat(F.lit(prefix), F.format_number(column, digits))


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and short integers as longs, for display and comparison."""
    wide = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        column = F.col(f"`{field.name}`")
        if kind == "decimal":
            column = column.cast("double")
        elif kind in ("integer", "short", "byte"):
            column = column.cast("long")
        wide.append(column.alias(field.name))
    return df.select(*wide)
