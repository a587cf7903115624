"""Stage orders of the three scheduled jobs, as plain function composition."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame

from meterline.functions.columns import since
from meterline.operators import contracts as c
from meterline.operators import cost, forecast, reports, whatif
from meterline.params import LOOKBACK_DAYS
from meterline.session import stored


@dataclass
class DailyRefresh:
    dashboard: DataFrame
    daily_summary: DataFrame
    burndown: DataFrame
    summary: DataFrame


def daily_refresh(usage: DataFrame, prices: DataFrame, accounts: DataFrame, contracts: DataFrame, as_of: date, lookback_days: int = LOOKBACK_DAYS) -> DailyRefresh:
    """Enrich, roll up, burn down: one lazy plan, written only by the caller.

    Only the reports look back ``lookback_days``; contracts burn down over all history.
    """
    history = cost.dashboard_data(usage, prices, accounts, as_of, None)
    dashboard = history.filter(since(as_of, lookback_days))
    burndown = c.contract_burndown(contracts, history, as_of)
    return DailyRefresh(dashboard, reports.daily_summary(dashboard), burndown, c.burndown_summary(burndown, as_of))


@dataclass
class WhatIfRefresh:
    scenarios: DataFrame
    burndown: DataFrame
    forecast: DataFrame
    summary: DataFrame


def whatif_refresh(contracts: DataFrame, burndown: DataFrame, contract_forecast: DataFrame, tiers: DataFrame, as_of: date, folder: str) -> WhatIfRefresh:
    """Scenarios to recommendation.

    The scenario tables are read several times downstream, so each is stored
    once in ``folder`` and continued from there.
    """
    scenarios = stored(whatif.generate_scenarios(contracts, whatif.active_tiers(tiers, as_of)), f"{folder}/scenarios")
    rows = stored(whatif.full_scenario_burndown(scenarios, burndown), f"{folder}/burndown")
    ahead = stored(whatif.scenario_forecast(scenarios, contract_forecast, contracts), f"{folder}/forecast")
    summary = whatif.scenario_summary(scenarios, contracts, rows, ahead)
    chosen = whatif.sweet_spot_strategy(whatif.drop_redundant_extensions(summary))
    return WhatIfRefresh(scenarios, rows, ahead, chosen)


def forecast_refresh(contracts: DataFrame, history: DataFrame, as_of: date, folder: str) -> DataFrame:
    """Series, models and exhaustion dates for every active contract, from enriched rows of all history."""
    burndown = stored(c.contract_burndown(contracts, history, as_of), f"{folder}/burndown")
    features = stored(forecast.forecast_features(forecast.contract_daily_costs(contracts, history, as_of)), f"{folder}/features")
    return forecast.forecast_output(burndown, contracts, features)
