"""Commitment sizing for every account and duration at once."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.functions.columns import day, dbl, ratio, risk_level
from meterline.operators.forecast import trend_stats
from meterline.params import DEFAULT_TOTAL_VALUE, MIN_UTILIZATION, TARGET_UTILIZATION

KEY = ["account_id", "duration_years"]
METRICS = ["utilization", "effective_cost", "savings_vs_list", "waste_amount", "waste_cost", "net_benefit", "roi_score"]
RUNNING = (W.unboundedPreceding, W.currentRow)


def usable_tiers(tiers: DataFrame, as_of: date) -> DataFrame:
    """Tiers in force; unlike the scenario lookup, the expiry day no longer counts."""
    begun = F.col("effective_date").isNull() | (F.col("effective_date") <= day(as_of))
    return tiers.filter(begun & (F.col("expiration_date").isNull() | (F.col("expiration_date") > day(as_of))))


def consumption_stats(daily: DataFrame) -> DataFrame:
    return trend_stats(daily, "account_id")


def contract_horizon(accounts: DataFrame, start: date, years: tuple[int, ...], as_of: date) -> DataFrame:
    """Term split at ``as_of``; a year counts 365 days."""
    length = F.col("duration_years") * 365
    begun = start < as_of
    past = (as_of - start).days if begun else 0
    end = F.date_add(day(start), length)
    return accounts.select("account_id").distinct().withColumn("duration_years", F.explode(F.array(*[F.lit(y) for y in years]))).select(
        *KEY, day(start).alias("proposed_start"), end.alias("proposed_end"), F.lit(past).alias("historical_days"),
        (F.datediff(end, day(as_of)) if begun else length).alias("forecast_days"),
    )


def projected_consumption(daily: DataFrame, stats: DataFrame, horizon: DataFrame, forecast: DataFrame, as_of: date) -> DataFrame:
    """History inside the term, an estimate for days before the history, and the forecast.

    The forecast holds ``forecast_days`` days from ``as_of`` on; without any row
    the mean stands in, with a 20 % band.
    """
    past = horizon.join(daily, "account_id").filter(
        (F.col("usage_date") >= F.col("proposed_start")) & (F.col("usage_date") <= F.least(day(as_of), F.col("proposed_end")))
    ).groupBy(*KEY).agg(F.sum("daily_cost").alias("in_term"))
    ahead = horizon.join(forecast, "account_id").filter(F.col("ds") <= F.date_add(day(as_of), F.col("forecast_days"))).groupBy(*KEY).agg(
        F.sum("yhat").alias("f_total"), F.avg("yhat").alias("f_avg"), F.sum("yhat_lower").alias("f_lower"), F.sum("yhat_upper").alias("f_upper")
    )
    average = F.col("daily_avg")
    missing = F.greatest(F.datediff("first_day", "proposed_start"), F.lit(0))
    flat = F.greatest(F.datediff("proposed_end", day(as_of)), F.lit(0)) * average
    return (
        horizon.join(stats, "account_id").join(past, KEY, "left").join(ahead, KEY, "left")
        .withColumn("historical_total", F.coalesce("in_term", F.lit(0.0)) + missing * average)
        .withColumn("forecasted_total", F.coalesce("f_total", flat))
        .withColumn("forecasted_daily_avg", F.coalesce("f_avg", average))
        .withColumn("forecast_lower", F.coalesce("f_lower", flat * 0.8))
        .withColumn("forecast_upper", F.coalesce("f_upper", flat * 1.2))
        .select(
            *KEY, "proposed_start", "proposed_end", "daily_avg", "historical_total", "forecasted_total", "forecasted_daily_avg",
            "forecast_lower", "forecast_upper", (F.col("historical_total") + F.col("forecasted_total")).alias("projected_total"),
            (F.col("historical_total") + F.col("forecast_lower")).alias("projected_lower"),
            (F.col("historical_total") + F.col("forecast_upper")).alias("projected_upper"),
        )
    )


def commitment_candidates(projections: DataFrame, tiers: DataFrame, target: float = TARGET_UTILIZATION) -> DataFrame:
    """Sizes worth trying: by target utilisation, exact, by the upper path, and tier edges.

    A tier edge is tried as it is and one per cent above. ``candidate_order``
    keeps the listed order for later ties. Durations without tiers have none.
    """
    total, upper = F.col("projected_total"), F.col("projected_upper")
    entry = lambda order, kind, amount: F.struct(F.lit(order).alias("o"), F.lit(kind).alias("t"), amount.alias("c"))
    has_tier = tiers.select("duration_years").distinct()
    own = projections.join(has_tier, "duration_years", "left_semi").select(
        *KEY, total.alias("projected_total"),
        F.explode(F.array(entry(0, "target", total / target), entry(1, "conservative", total), entry(2, "aggressive", upper / 0.90))).alias("e"),
    )
    low = dbl("min_commitment")
    edges = tiers.filter(F.col("min_commitment") > 0).select(
        "duration_years", F.row_number().over(W.partitionBy("duration_years").orderBy("min_commitment", "tier_id")).alias("n"), low.alias("low")
    )
    steps = projections.select(*KEY, "projected_total").join(edges, "duration_years").select(
        *KEY, "projected_total",
        F.explode(F.array(
            F.struct((F.col("n") * 2 + 1).alias("o"), F.lit("tier_boundary").alias("t"), F.col("low").alias("c")),
            F.struct((F.col("n") * 2 + 2).alias("o"), F.lit("tier_boundary").alias("t"), (F.col("low") * 1.01).alias("c")),
        )).alias("e"),
    )
    return own.unionByName(steps).select(
        *KEY, "projected_total", F.col("e.o").alias("candidate_order"), F.col("e.t").alias("candidate_type"), F.col("e.c").alias("commitment")
    ).filter(F.col("commitment") > 0)


def best_tier(candidates: DataFrame, tiers: DataFrame) -> DataFrame:
    """Highest-rate tier that holds each commitment.

    Below every band: no discount. Above every band or in a gap between bands:
    the best rate of the duration. Equal rates resolve to the lower band.
    """
    rank = F.struct(
        dbl("discount_rate").alias("rate"), (-dbl("min_commitment")).alias("low"), F.col("tier_id").alias("tier_id"), F.col("tier_name").alias("tier_name")
    )
    # The tier table is configuration: its bands ride along as an array per duration, so candidates are not multiplied.
    bands = tiers.groupBy("duration_years").agg(F.collect_list(F.struct(dbl("min_commitment").alias("min_c"), dbl("max_commitment").alias("max_c"), rank.alias("tier"))).alias("bands"))
    commitment = F.col("commitment")
    holds = lambda b: (b["min_c"] <= commitment) & (b["max_c"].isNull() | (commitment <= b["max_c"]))
    picked = candidates.join(bands, "duration_years").select(
        *candidates.columns, F.exists("bands", lambda b: b["min_c"] <= commitment).alias("any_reached"),
        F.array_max(F.transform(F.filter("bands", holds), lambda b: b["tier"])).alias("held"), F.array_max(F.transform("bands", lambda b: b["tier"])).alias("top"),
    )
    tier = F.coalesce("held", "top")
    return picked.select(
        *candidates.columns, F.when(F.col("any_reached"), tier["tier_id"]).alias("tier_id"),
        F.when(F.col("any_reached"), tier["tier_name"]).otherwise("Below minimum").alias("tier_name"),
        F.when(F.col("any_reached"), tier["rate"]).otherwise(0.0).alias("discount_rate"),
    )


def commitment_economics(scored: DataFrame) -> DataFrame:
    """Cost, waste and benefit of each size; usage above the commitment costs list price."""
    commitment, used, keep = F.col("commitment"), F.col("projected_total"), 1 - F.col("discount_rate")
    return (
        scored.withColumn("utilization", F.coalesce(ratio(used, commitment), F.lit(0.0)))
        .withColumn("effective_cost", F.least(commitment, used) * keep + F.greatest(used - commitment, F.lit(0.0)))
        .withColumn("savings_vs_list", used - F.col("effective_cost"))
        .withColumn("waste_amount", F.greatest(commitment - used, F.lit(0.0)))
        .withColumn("waste_cost", F.col("waste_amount") * keep)
        .withColumn("net_benefit", F.col("savings_vs_list") - F.col("waste_cost"))
        .withColumn("roi_score", F.coalesce(ratio(F.col("net_benefit"), commitment) * 100, F.lit(0.0)))
    )


def optimal_commitment(scored: DataFrame, target: float = TARGET_UTILIZATION) -> DataFrame:
    """Best net benefit among well-used sizes, else the best return.

    Amounts are compared to a ten-thousandth, so equal candidates tie and the
    earlier one wins.
    """
    used_well = F.col("utilization") >= target * 0.9
    order = W.partitionBy(*KEY).orderBy(
        F.desc("ok"), F.desc(F.when(F.col("ok"), F.round("net_benefit", 4)).otherwise(F.round("roi_score", 4))), "candidate_order"
    )
    return scored.withColumn("ok", used_well).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") == 1).drop("rn", "ok")


def alternatives(scored: DataFrame, optimal: DataFrame) -> DataFrame:
    """A smaller, better-used size and a larger one with at least the same rate.

    Both need a net benefit; less than a ten-thousandth counts as none.
    """
    best = optimal.select(*KEY, F.col("commitment").alias("o_c"), F.col("utilization").alias("o_u"), F.col("discount_rate").alias("o_r"))
    rows = scored.join(best, KEY).filter(F.round("net_benefit", 4) > 0)
    c = F.col("commitment")
    kind = (
        F.when((c < F.col("o_c") * 0.95) & (F.col("utilization") > F.col("o_u")), "conservative")
        .when((c > F.col("o_c") * 1.05) & (F.col("discount_rate") >= F.col("o_r")), "aggressive")
    )
    order = W.partitionBy(*KEY, "alternative").orderBy(
        F.desc(F.when(F.col("alternative") == "aggressive", F.col("discount_rate")).otherwise(F.lit(0.0))),
        F.desc(F.round("net_benefit", 4)), "candidate_order",
    )
    return (
        rows.withColumn("alternative", kind).filter(F.col("alternative").isNotNull())
        .withColumn("rn", F.row_number().over(order)).filter(F.col("rn") == 1).drop("rn", "o_c", "o_u", "o_r")
    )


def _alternative_columns(alts: DataFrame) -> DataFrame:
    pick = lambda kind, c: F.max(F.when(F.col("alternative") == kind, F.col(c)))
    return alts.groupBy(*KEY).agg(
        pick("conservative", "commitment").alias("conservative_commitment"), pick("conservative", "discount_rate").alias("conservative_discount_rate"),
        pick("aggressive", "commitment").alias("aggressive_commitment"), pick("aggressive", "discount_rate").alias("aggressive_discount_rate"),
    )


def commitment_recommendations(
    projections: DataFrame, stats: DataFrame, optimal: DataFrame, alts: DataFrame, as_of: date,
    lookback_days: int = 365, model: str = "linear_fallback", confidence: float = 0.5,
) -> DataFrame:
    best = optimal.select(
        *KEY, F.col("commitment").alias("optimal_commitment"), F.col("discount_rate").alias("optimal_discount_rate"),
        F.col("tier_name").alias("optimal_tier_name"), (F.col("utilization") * 100).alias("optimal_utilization_pct"),
        F.col("effective_cost").alias("committed_price_total"), F.col("savings_vs_list").alias("total_savings"),
    )
    return (
        projections.drop("daily_avg").join(stats.select("account_id", F.col("daily_avg").alias("historical_daily_avg")), "account_id")
        .join(best, KEY).join(_alternative_columns(alts), KEY, "left")
        .select(
            F.sha2(F.concat_ws("|", "account_id", F.col("duration_years").cast("string"), F.lit(str(as_of))), 256).alias("recommendation_id"),
            "account_id", day(as_of).alias("analysis_date"), F.date_sub(day(as_of), lookback_days).alias("historical_start"),
            day(as_of).alias("historical_end"), "proposed_start", "proposed_end", "duration_years", "historical_daily_avg", "historical_total",
            "forecasted_daily_avg", "forecasted_total", "projected_total", "optimal_commitment", "optimal_discount_rate", "optimal_tier_name",
            "optimal_utilization_pct", F.col("projected_total").alias("list_price_total"), "committed_price_total", "total_savings",
            F.coalesce(ratio(F.col("total_savings"), F.col("projected_total")) * 100, F.lit(0.0)).alias("savings_pct"),
            "conservative_commitment", "conservative_discount_rate", "aggressive_commitment", "aggressive_discount_rate",
            F.lit(model).alias("model_used"), F.lit(confidence).alias("confidence_level"), F.lit("ACTIVE").alias("status"),
        )
    )


def commitment_scenarios(scored: DataFrame, optimal: DataFrame, alts: DataFrame) -> DataFrame:
    """Every size with its flags. Flags go by equal amount, so twins are both flagged."""
    best = optimal.select(*KEY, F.col("commitment").alias("optimal_c"))
    same = lambda c: F.coalesce(F.col("commitment") == F.col(c), F.lit(False))
    return scored.join(best, KEY, "left").join(_alternative_columns(alts), KEY, "left").select(
        *KEY, "candidate_order", F.col("commitment").alias("commitment_amount"), F.col("tier_id").alias("discount_tier_id"),
        F.col("tier_name").alias("discount_tier_name"), "discount_rate", F.col("projected_total").alias("projected_consumption"),
        "effective_cost", (F.col("utilization") * 100).alias("utilization_pct"), "savings_vs_list",
        F.col("savings_vs_list").alias("savings_vs_baseline"), "waste_amount", "net_benefit", "roi_score",
        same("optimal_c").alias("is_optimal"), same("conservative_commitment").alias("is_conservative"),
        same("aggressive_commitment").alias("is_aggressive"), risk_level(F.col("utilization")).alias("risk_level"),
    )


def latest_recommendation(recommendations: DataFrame) -> DataFrame:
    newest = recommendations.groupBy("account_id").agg(F.max("analysis_date").alias("analysis_date"))
    return recommendations.join(newest, ["account_id", "analysis_date"])


def recommendation_summary(recommendations: DataFrame, accounts: DataFrame) -> DataFrame:
    return latest_recommendation(recommendations).join(accounts.select("account_id", "customer_name"), "account_id", "left").select(
        "recommendation_id", "account_id", "customer_name", "analysis_date", "duration_years", "proposed_start", "proposed_end",
        "historical_daily_avg", "forecasted_daily_avg", "projected_total", "optimal_commitment", "optimal_discount_rate",
        F.concat((F.round(F.col("optimal_discount_rate") * 100, 6)).cast("int").cast("string"), F.lit("%")).alias("discount_display"),
        "optimal_tier_name", "optimal_utilization_pct", "total_savings", "savings_pct", "conservative_commitment",
        "aggressive_commitment", "model_used", "confidence_level", "status",
    )


def auto_total_value(contracts: DataFrame, daily: DataFrame, as_of: date, target: float = TARGET_UTILIZATION) -> DataFrame:
    """Contract value that meets the target, from the account's mean and trend.

    The day sum is an array fold inside each contract row, so no day rows are
    shuffled. Rounded to thousands with ties to even.
    """
    stats = trend_stats(daily, "account_id").select("account_id", "daily_avg", "trend")
    length = F.datediff("end_date", "start_date")
    past = F.greatest(F.least(F.datediff(day(as_of), "start_date"), length), F.lit(0))
    ahead = F.when(F.col("n_ahead") > 0, F.sequence(F.lit(0), F.col("n_ahead") - 1)).otherwise(F.array().cast("array<int>"))
    future = F.aggregate(
        ahead, F.lit(0.0), lambda acc, i: acc + F.greatest(F.col("daily_avg") + F.col("trend") * (F.col("n_past") + i), F.lit(0.0))
    )
    sized = contracts.join(stats, "account_id", "left").withColumn("n_past", past).withColumn("n_ahead", length - past)
    total = F.col("n_past") * F.col("daily_avg") + future
    rounded = F.greatest(F.bround(total / target / 1000) * 1000, F.lit(1000.0))
    return sized.select(
        "contract_id", "account_id", "start_date", "end_date",
        F.when(F.col("daily_avg").isNull(), F.lit(DEFAULT_TOTAL_VALUE)).otherwise(rounded).alias("auto_total_value"),
    )


def commitment_forecast_detail(daily: DataFrame, forecast: DataFrame, horizon: DataFrame, as_of: date) -> DataFrame:
    """Day rows of every proposed term, actual then forecast, with a running total."""
    actual = horizon.join(daily, "account_id").filter(
        (F.col("usage_date") >= F.col("proposed_start")) & (F.col("usage_date") <= F.least(day(as_of), F.col("proposed_end")))
    ).select(*KEY, F.col("usage_date").alias("forecast_date"), "daily_cost", F.col("daily_cost").alias("lower_bound"),
             F.col("daily_cost").alias("upper_bound"), F.lit(True).alias("is_historical"))
    future = horizon.join(forecast, "account_id").filter(
        (F.col("ds") > day(as_of)) & (F.col("ds") <= F.date_add(day(as_of), F.col("forecast_days")))
    ).select(*KEY, F.col("ds").alias("forecast_date"), F.col("yhat").alias("daily_cost"), F.col("yhat_lower").alias("lower_bound"),
             F.col("yhat_upper").alias("upper_bound"), F.lit(False).alias("is_historical"))
    window = W.partitionBy(*KEY).orderBy("forecast_date").rowsBetween(*RUNNING)
    return actual.unionByName(future).withColumn("cumulative_cost", F.sum("daily_cost").over(window))


def commitment_search(consumption: DataFrame, grid: list[tuple[float, int, float]], min_utilization: float = MIN_UTILIZATION) -> DataFrame:
    """Best of a grid of ``(commitment, duration, rate)`` per ``(account_id, annual)``.

    The grid is configuration and rides along as an array. Poorly used sizes
    lose; if all are, the smallest commitment is recommended.
    """
    cells = F.array(*[
        F.struct(F.lit(n).alias("n"), F.lit(float(c)).alias("commitment"), F.lit(int(d)).alias("duration"), F.lit(float(r)).alias("discount_rate"))
        for n, (c, d, r) in enumerate(grid)
    ])
    rows = consumption.withColumn("cell", F.explode(cells)).select("account_id", "annual", "cell.*")
    discounted = F.col("annual") * (1 - F.col("discount_rate"))
    rows = (
        rows.withColumn("total_savings", (F.col("annual") - F.greatest(discounted, F.col("commitment"))) * F.col("duration"))
        .withColumn("utilization", discounted / F.col("commitment"))
        .withColumn("savings_per_dollar_committed", F.col("total_savings") / (F.col("commitment") * F.col("duration")))
        .withColumn("ok", F.col("utilization") >= min_utilization)
    )
    order = W.partitionBy("account_id").orderBy(
        F.desc("ok"), F.desc(F.when(F.col("ok"), F.round("total_savings", 4)).otherwise(-F.col("commitment"))), "n"
    )
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") == 1).drop("rn", "n", "ok")
