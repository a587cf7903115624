"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the number of local threads.
Every query is planned anew and run to the end through a no-op sink. The stages that a
scheduled refresh would leave as tables are written beforehand; ``stages`` has the time of
each, ``prepare`` their sum, and ``cold_total`` that of stages and queries together.
"""

from __future__ import annotations

import json
import os
import time

from meterline.registry import all_queries
from meterline.session import local_session
from meterline.registry.star import Star

HEADLINE = [
    "dashboard_data", "daily_summary", "contract_burndown", "burndown_summary", "contract_analysis", "top_consumers_report", "monthly_report",
    "daily_spikes", "new_workspaces", "detailed_usage", "cost_with_fallback_price", "forecast_features", "linear_forecast", "exhaustion_dates",
    "seasonal_forecast", "generate_scenarios", "scenario_burndown", "scenario_forecast", "scenario_summary", "sweet_spot_strategy",
    "projected_consumption", "commitment_recommendations", "validation_suite", "net_corrections",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    queries = {q.name: q for q in all_queries()}

    star, stages = Star(spark, folder), {}
    for stage in ("prices", "accounts", "contracts", "burndown", "features", "forecast", "scenarios", "scenario_burndown", "scenario_forecast",
                  "scenario_summary", "account_daily", "commitment"):
        begin = time.perf_counter()
        getattr(star, stage)
        stages[stage] = round(time.perf_counter() - begin, 3)
    prepare = sum(stages.values())

    times = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "prepare": round(prepare, 3),
        "stages": stages, "cold_total": round(prepare + sum(times.values()), 3),
        "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
