from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows_of
from meterline.registry import all_queries

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["dashboard_data", "contract_burndown", "burndown_summary", "top_consumers_report", "forecast_details", "sweet_spot_strategy", "commitment_recommendations", "seasonal_forecast", "scenario_forecast", "extension_projection"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_every_check_belongs_to_a_query_and_parses(duck):
    assert set(oracle_sql()) <= set(queries())
    assert {q.name for q in all_queries()} <= set(oracle_sql())
    for text in oracle_sql().values():
        duck.execute("EXPLAIN " + text)


def test_flagship_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    cur = duck.execute(oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_flagship_plan_has_no_forced_single_task_over_rows(spark):
    from meterline.registry.star import Star

    star = Star(spark, FOLDER)
    plan = star.dashboard._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan
    assert "GreaterThanOrEqual(l_shipdate" in plan
