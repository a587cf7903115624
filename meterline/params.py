"""Parameters shared by the operators. Every date-dependent operator takes an
explicit ``as_of`` instead of reading the clock."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# The published defaults that results have to agree with.
LOOKBACK_DAYS = 365
ARCHIVE_AFTER_DAYS = 730
MAX_PROJECTED_END = date(2032, 12, 31)
FALLBACK_UNIT_PRICE = "0.5"
DEFAULT_UNIT_RATE = "0.22"
DEFAULT_DISCOUNT = "0.05"
DISCOUNT_STEP = 5
FORECAST_BUFFER_DAYS = 90
FORECAST_HORIZON_DAYS = 365
MIN_TRAINING_DAYS = 30
TARGET_UTILIZATION = 0.95
MIN_UTILIZATION = 0.85
DEFAULT_TOTAL_VALUE = 10000.0
MAX_TERM_YEARS = 5


@dataclass(frozen=True)
class PaceThresholds:
    """Multiples of the elapsed share at which a contract changes pace class."""

    over: float = 1.2
    above: float = 1.1
    under: float = 0.8


PACE = PaceThresholds()
