"""Every registered query, with its SQL cross-check where SQL can express it."""

from __future__ import annotations

from functools import cache

from meterline.registry import forecast  # isort: skip  (its tables come first)
from meterline.registry import commitment, contracts, cost, quality, reports, sources, stored, whatif
from meterline.registry.base import Query


@cache
def all_queries() -> tuple[Query, ...]:
    found: dict[str, Query] = {}
    for module in (sources, cost, reports, contracts, forecast, whatif, commitment, quality, stored):
        for query in module.QUERIES:
            if query.name in found:
                raise ValueError(f"query {query.name} registered twice")
            found[query.name] = query
    return tuple(found.values())
