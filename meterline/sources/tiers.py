"""Discount tier tables, built from a band list and a rate grid."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

TIER_SCHEMA = (
    "tier_id string, tier_name string, min_commitment decimal(18,2), max_commitment decimal(18,2), "
    "duration_years int, discount_rate decimal(5,4), cloud_provider string, effective_date date, "
    "expiration_date date, notes string"
)

# Band code, lower limit, upper limit (None = open).
CLOSED_BANDS = [
    ("50K", 50000, 99999), ("100K", 100000, 249999), ("250K", 250000, 499999),
    ("500K", 500000, 999999), ("1M", 1000000, 4999999), ("5M", 5000000, None),
]
TOUCHING_BANDS = [
    ("50K", 50000, 100000), ("100K", 100000, 250000), ("250K", 250000, 500000),
    ("500K", 500000, 1000000), ("1M", 1000000, 5000000), ("5M", 5000000, None),
]


@dataclass(frozen=True)
class TierSet:
    prefix: str
    bands: list
    names: list
    rates: list  # percent, one row per band, one column per year


# Names and percentages per band and duration.
TIER_SETS = {
    "default": TierSet(
        "TIER", CLOSED_BANDS,
        ["Entry", "Standard", "Growth", "Scale", "Enterprise", "Strategic"],
        [[5, 8, 10, 10, 10], [10, 15, 18, 18, 18], [15, 20, 25, 25, 25],
         [20, 25, 30, 30, 30], [25, 30, 35, 35, 35], [30, 35, 40, 40, 40]],
    ),
    "market_aligned": TierSet(
        "TIER", TOUCHING_BANDS,
        ["Small Business", "Mid-Market", "Growth Enterprise", "Enterprise", "Large Enterprise", "Strategic Account"],
        [[10, 15, 20], [15, 20, 25], [20, 27, 33], [25, 32, 37], [30, 37, 42], [35, 42, 50]],
    ),
    "aggressive": TierSet(
        "AGGR", TOUCHING_BANDS,
        ["Competitive Small", "Competitive Mid-Market", "Competitive Growth", "Competitive Enterprise",
         "Competitive Large Enterprise", "Strategic Competitive Account"],
        [[12, 18, 22], [18, 25, 30], [25, 32, 38], [30, 37, 43], [35, 42, 48], [40, 47, 55]],
    ),
    "stackable_base": TierSet(
        "BASE", TOUCHING_BANDS,
        ["Small Business Base", "Mid-Market Base", "Growth Enterprise Base", "Enterprise Base",
         "Large Enterprise Base", "Strategic Account Base"],
        [[8, 12, 15], [12, 18, 22], [18, 24, 30], [22, 30, 35], [28, 35, 40], [33, 40, 45]],
    ),
}


def tier_rows(name: str = "default", effective: date = date(2024, 1, 1)) -> list[tuple]:
    chosen = TIER_SETS[name]
    return [
        (f"{chosen.prefix}_{code}_{year}Y", f"{label} - {year} Year", Decimal(low), None if high is None else Decimal(high),
         year, Decimal(pct) / 100, None, effective, None, f"{label} commit, {year} year term")
        for (code, low, high), label, rates in zip(chosen.bands, chosen.names, chosen.rates)
        for year, pct in enumerate(rates, start=1)
    ]


def default_tiers(spark: SparkSession, name: str = "default", effective: date = date(2024, 1, 1)) -> DataFrame:
    return spark.createDataFrame(tier_rows(name, effective), TIER_SCHEMA)
