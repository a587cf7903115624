"""The commitment recommendation as one chain of frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.operators import commitment as k
from meterline.operators.forecast import trend_forecast


@dataclass
class CommitmentStages:
    """Every stage of the recommendation."""

    daily: DataFrame
    tiers: DataFrame
    stats: DataFrame
    horizon: DataFrame
    forecast: DataFrame
    projections: DataFrame
    candidates: DataFrame
    scored: DataFrame
    optimal: DataFrame
    alternatives: DataFrame
    recommendations: DataFrame


def stages(
    daily: DataFrame, tiers: DataFrame, as_of: date, start: date, years: tuple[int, ...] = (1, 2, 3), target: float = 0.95,
    store: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
) -> CommitmentStages:
    """Build all stages. ``store`` may write the two frames that several later
    stages read, so that they are not computed again for each of them."""
    usable = k.usable_tiers(tiers, as_of)
    stats = k.consumption_stats(daily)
    horizon = k.contract_horizon(stats, start, years, as_of)
    forecast = trend_forecast(stats, "account_id", as_of, F.lit(_longest(start, years, as_of)))
    projections = store("commitment_projections", k.projected_consumption(daily, stats, horizon, forecast, as_of))
    candidates = k.commitment_candidates(projections, usable, target)
    scored = store("commitment_scored", k.commitment_economics(k.best_tier(candidates, usable)))
    optimal = k.optimal_commitment(scored, target)
    alts = k.alternatives(scored, optimal)
    return CommitmentStages(
        daily, usable, stats, horizon, forecast, projections, candidates, scored, optimal, alts,
        k.commitment_recommendations(projections, stats, optimal, alts, as_of),
    )


def _longest(start: date, years: tuple[int, ...], as_of: date) -> int:
    past = (as_of - start).days if start < as_of else 0
    return max(max(years) * 365 - past, 0)
