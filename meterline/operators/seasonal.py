"""Least-squares seasons: a line and harmonics of the week, the month and the year per contract.

One shuffle brings the days of a contract together (one row a day, so a contract's group is
bounded by the calendar). Everything else happens in that row, in array functions: the
Gram matrix and moments of the design columns, a Cholesky factor, two substitutions, the
deviation of the residuals, and the values of all days. No Python and no second shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.columns import dbl

EPOCH = date(1970, 1, 1)


@dataclass(frozen=True)
class Season:
    period: float
    order: int
    #: Harmonics are learned only from contracts that span so many days.
    span: int = 0


#: The published seasons: week, month of 30.5 days with five harmonics, year; a year is learned from two of them.
SEASONS = (Season(7, 3), Season(30.5, 5), Season(365.25, 10, 730))
#: Shrinks harmonics as this share of the days, at mean level, would; it keeps the matrix regular.
RIDGE = 0.01


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _first(rows: Column, n: Column) -> Column:
    return F.slice(rows, F.lit(1), n)


def _level(x: Column) -> Column:
    return F.greatest(F.col("mean") + F.col("slope") * (x - F.col("center")), F.col("mean") * 0.1)


def _design(x: Column, seasons: tuple[Season, ...]) -> Column:
    """Columns of one day: intercept, trend from 0 to 1, and the level times every harmonic."""
    level, span = _level(x), F.col("last_x") - F.col("first_x")
    columns = [F.lit(1.0), (x - F.col("first_x")) / F.greatest(span, F.lit(1.0))]
    for s in seasons:
        weight = level if not s.span else F.when(span >= s.span, level).otherwise(0.0)
        for k in range(1, s.order + 1):
            turn = x * (2 * math.pi * k / s.period)
            columns += [weight * F.sin(turn), weight * F.cos(turn)]
    return F.array(*columns)


def solve(gram: Column, moments: Column, size: int) -> Column:
    """The solution of a symmetric positive definite system, as an array; ``gram`` is an array of rows."""
    none = F.array().cast("array<double>")

    def factor_row(rows: Column, i: Column) -> Column:
        def entry(row: Column, j: Column) -> Column:
            rest = F.element_at(F.element_at(gram, i + 1), j + 1) - F.when(i == j, _dot(row, row)).otherwise(_dot(row, _first(F.get(rows, j), j)))
            return F.when(i == j, F.sqrt(F.greatest(rest, F.lit(1e-12)))).otherwise(rest / F.element_at(F.get(rows, j), j + 1))

        return F.aggregate(F.sequence(F.lit(0), i), none, lambda row, j: F.concat(row, F.array(entry(row, j))))

    steps = F.sequence(F.lit(0), F.lit(size - 1))
    lower = F.aggregate(steps, F.array().cast("array<array<double>>"), lambda rows, i: F.concat(rows, F.array(factor_row(rows, i))))

    def substitutions(low: Column) -> Column:
        diagonal = lambda i: F.element_at(F.element_at(low, i + 1), i + 1)
        forward = F.aggregate(steps, none, lambda z, i: F.concat(z, F.array((F.element_at(moments, i + 1) - _dot(z, _first(F.element_at(low, i + 1), i))) / diagonal(i))))

        def backward(z: Column) -> Column:
            def step(found: Column, i: Column) -> Column:  # the last unknown comes first
                below = F.transform(F.when(i < size - 1, F.sequence(F.lit(size - 1), i + 1, F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda k: F.element_at(F.element_at(low, k + 1), i + 1))
                return F.concat(found, F.array((F.element_at(z, i + 1) - _dot(found, below)) / diagonal(i)))

            return F.reverse(F.aggregate(F.sequence(F.lit(size - 1), F.lit(0), F.lit(-1)), none, step))

        return F.element_at(F.transform(F.array(forward), backward), 1)

    return F.element_at(F.transform(F.array(lower), substitutions), 1)


def coefficients(series: DataFrame, seasons: tuple[Season, ...] = SEASONS, ridge: float = RIDGE) -> DataFrame:
    """One row a contract: its days, the line behind its level, and ``beta``, the weights of the design columns.

    ``series`` is ``(contract_id, ds, y, contract_end)``; days after the end of the contract are not learned from.
    """
    x = dbl(F.datediff("ds", F.lit(EPOCH)))
    past = series.filter("ds <= contract_end").select("contract_id", "contract_end", x.alias("x"), dbl("y").alias("y"))
    found = past.groupBy("contract_id").agg(
        F.avg("y").alias("mean"), F.avg("x").alias("center"), F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"), F.min("x").alias("first_x"), F.max("x").alias("last_x"),
        F.max("contract_end").alias("contract_end"), F.sort_array(F.collect_list(F.struct("x", "y"))).alias("days"),
    )
    size = 2 + 2 * sum(s.order for s in seasons)
    rows = F.transform("days", lambda d: F.concat(_design(d.x, seasons), F.array(d.y)))
    start = F.array_repeat(F.array_repeat(F.lit(0.0), size + 1), size)
    # Row i of the sum: products of column i with all columns, then with y.
    outer = F.aggregate(rows, start, lambda g, v: F.zip_with(g, _first(v, F.lit(size)), lambda row, a: F.zip_with(row, v, lambda s, b: s + a * b)))
    n = F.size("days")
    penalty = lambda i: F.when(i < 2, n * 1e-9).otherwise(n * F.col("mean") * F.col("mean") * ridge + 1e-6)
    held = F.transform("sums", lambda row, i: F.transform(_first(row, F.lit(size)), lambda g, j: F.when(i == j, g + penalty(i)).otherwise(g)))
    return (
        found.withColumn("sums", outer)
        .withColumn("gram", held)
        .withColumn("moments", F.transform("sums", lambda row: F.element_at(row, size + 1)))
        .withColumn("beta", solve(F.col("gram"), F.col("moments"), size))
        .drop("sums", "gram", "moments")
    )


def predicted(x: Column, seasons: tuple[Season, ...] = SEASONS) -> Column:
    return _dot(_design(x, seasons), F.col("beta"))


def seasonal_values(series: DataFrame, steps: Column, z: float, seasons: tuple[Season, ...] = SEASONS, ridge: float = RIDGE) -> DataFrame:
    """contract_id, ds, yhat, yhat_lower, yhat_upper, fitted: all days learned from and ``steps`` days after them.

    ``steps`` may use ``contract_end`` and ``last``, the last day. The band is the deviation of the residuals.
    """
    fit = coefficients(series, seasons, ridge).withColumn("last", F.date_add(F.lit(EPOCH), F.col("last_x").cast("int")))
    past = F.transform("days", lambda d: F.struct(d.x.alias("x"), d.y.alias("y"), predicted(d.x, seasons).alias("yhat"), F.lit(True).alias("fitted")))
    offsets = F.when(steps > 0, F.sequence(F.lit(1), steps.cast("int"))).otherwise(F.array().cast("array<int>"))
    ahead = F.transform(F.transform(offsets, lambda i: F.col("last_x") + i), lambda x: F.struct(x.alias("x"), F.lit(None).cast("double").alias("y"), predicted(x, seasons).alias("yhat"), F.lit(False).alias("fitted")))
    valued = fit.withColumn("past", past).withColumn("ahead", ahead)
    square = F.aggregate("past", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda t, d: F.struct((t.s + d.y - d.yhat).alias("s"), (t.q + (d.y - d.yhat) * (d.y - d.yhat)).alias("q")))
    n = F.size("past")
    sigma = F.sqrt(F.greatest(F.col("square.q") / n - (F.col("square.s") / n) * (F.col("square.s") / n), F.lit(0.0)))
    rows = valued.withColumn("square", square).withColumn("sigma", sigma).select("contract_id", "sigma", F.explode(F.concat("past", "ahead")).alias("d"))
    return rows.select(
        "contract_id", F.date_add(F.lit(EPOCH), F.col("d.x").cast("int")).alias("ds"), F.col("d.yhat").alias("yhat"),
        (F.col("d.yhat") - z * F.col("sigma")).alias("yhat_lower"), (F.col("d.yhat") + z * F.col("sigma")).alias("yhat_upper"), F.col("d.fitted").alias("fitted"),
    )
