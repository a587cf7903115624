from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterline.operators import quality as q
from meterline.operators import upkeep as u
from meterline.sources import readers, writers
from tests.helpers import by, contract, contracts, costs, d, usage

AS_OF = d("2024-06-30")
TIER = "tier_id string, max_commitment double, rate double, created_at string"


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), TIER)


def test_upsert_keeps_creation_and_is_idempotent(spark):
    target = _rows(spark, ("a", 1.0, 0.1, "old"), ("b", 2.0, 0.2, "old"))
    source = _rows(spark, ("b", 9.0, 0.3, "new"), ("c", None, 0.4, "new"))
    once = u.upsert(target, source, ["tier_id"])
    got = by(once, "tier_id")
    assert (got["b"].rate, got["b"].created_at, got["c"].created_at) == (0.3, "old", "new")
    assert {k: r._action for k, r in got.items()} == {"a": "unchanged", "b": "update", "c": "insert"}
    twice = u.upsert(once.drop("_action"), source, ["tier_id"]).drop("_action")
    assert sorted(twice.collect(), key=str) == sorted(once.drop("_action").collect(), key=str)


def test_upsert_changed_treats_null_as_a_value(spark):
    target = _rows(spark, ("same", None, 0.1, "t"), ("to_null", 5.0, 0.1, "t"), ("from_null", None, 0.1, "t"), ("rate", 1.0, 0.1, "t"))
    source = _rows(spark, ("same", None, 0.1, "s"), ("to_null", None, 0.1, "s"), ("from_null", 5.0, 0.1, "s"), ("rate", 1.0, 0.2, "s"), ("new", 1.0, 0.1, "s"))
    merged = u.upsert_changed(target, source, ["tier_id"], ["max_commitment", "rate"])
    got = by(merged, "tier_id")
    assert {k: r._action for k, r in got.items()} == {"same": "unchanged", "to_null": "update", "from_null": "update", "rate": "update", "new": "insert"}
    assert got["to_null"].max_commitment is None and got["same"].created_at == "t"
    again = u.upsert_changed(merged.drop("_action"), source, ["tier_id"], ["max_commitment", "rate"])
    assert {r._action for r in again.collect()} == {"unchanged"}
    assert {r._action: r["rows"] for r in u.action_counts(merged).collect()} == {"unchanged": 1, "update": 3, "insert": 1}


def test_prefix_underscore_is_a_wildcard(spark):
    target = _rows(spark, ("TIER_1", 1.0, 0.1, ""), ("TIERX1", 1.0, 0.1, ""), ("MY_TIER_1", 1.0, 0.1, ""))
    left = u.replace_by_prefix(target, _rows(spark, ("TIER_9", 1.0, 0.1, "")))
    assert sorted(r.tier_id for r in left.collect()) == ["MY_TIER_1", "TIER_9"]


def test_archive_parts_cover_everything(spark):
    rows = costs(spark, [("2022-06-30", 1), ("2022-07-01", 2), ("2024-01-01", 3)])
    kept, old = u.archive_split(rows, AS_OF)
    assert (kept.count(), old.count()) == (2, 1)


def test_delete_keeps_rows_with_a_null_condition(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    kept, removed = u.delete_where(rows, F.col("n") == 1)
    assert [r.id for r in kept.collect()] == ["b"] and [r.id for r in removed.collect()] == ["a"]


def test_anti_joins_survive_null_keys(spark):
    accounts = spark.createDataFrame([(None, "n"), ("Z", "z")], "account_id string, customer_name string")
    added = u.insert_missing_accounts(accounts, usage(spark, ("2024-06-20T00:00", 1)), AS_OF, {"customer_name": "new"})
    assert {r.account_id for r in added.collect()} == {None, "Z", "A"}
    kept = u.drop_orphan_accounts(accounts, contracts(spark, contract(account="Z"), contract("C2", account=None)))
    assert [r.account_id for r in kept.collect()] == ["Z"]


def test_status_from_dates(spark):
    terms = contracts(spark, contract("past", end="2024-06-29"), contract("today", end="2024-06-30"), contract("next", start="2024-07-01", end="2025-01-01"))
    assert {r.contract_id: r.new_status for r in u.status_changes(terms, AS_OF).collect()} == {"past": "EXPIRED", "next": "PENDING"}


def test_missing_days_and_consistency(spark):
    rows = costs(spark, [("2024-06-01", 1), ("2024-06-03", 1)])
    assert [r.missing_date for r in q.missing_days(rows, "usage_date", d("2024-06-01"), d("2024-06-03")).collect()] == [d("2024-06-02")]
    burn = spark.createDataFrame([("C1", d("2024-01-01"), 1.0, 1.0), ("C1", d("2024-01-02"), 1.0, 2.005), ("C1", d("2024-01-03"), 1.0, 3.5)],
                                 "contract_id string, usage_date date, daily_cost double, cumulative_cost double")
    assert [r.usage_date for r in q.cumulative_consistency(burn).collect()] == [d("2024-01-03")]


@pytest.mark.parametrize("days,status", [(2, "OK"), (3, "WARNING"), (5, "WARNING"), (6, "CRITICAL")])
def test_freshness_limits(spark, days, status):
    last = datetime(2024, 6, 30) - timedelta(days=days)
    assert q.freshness(usage(spark, (last.isoformat(), 1)), AS_OF).first().status == status


def test_validation_finds_each_problem(spark):
    terms = contracts(spark, contract("C1"), contract("C1"), contract("C2", start="2024-05-01", end="2024-05-01", account="none"))
    accounts = spark.createDataFrame([("A", None, "ae", "sa")], "account_id string, customer_name string, account_executive string, solutions_architect string")
    found = {r.check_name: r.issues for r in q.validate_contracts(terms, accounts).collect()}
    assert found == {"contracts_without_metadata": 1, "invalid_date_range": 1, "duplicate_contract_id": 1, "missing_required_fields": 1}


def test_partitioned_write_and_restore(spark, scratch):
    rows = costs(spark, [("2024-06-01", 1), ("2024-06-01", 2), ("2024-06-02", 3)])
    writers.write_partitioned(rows, f"{scratch}/t")
    back = spark.read.parquet(f"{scratch}/t")
    assert back.count() == 3 and back.filter("usage_date = DATE '2024-06-01'").count() == 2
    copy = writers.snapshot(back, f"{scratch}/t", "20240630")
    writers.append_results(rows, f"{scratch}/u")
    assert writers.restore(spark, copy, f"{scratch}/u").count() == 3
    with pytest.raises(ValueError):
        writers.restore(spark, copy, copy)


def test_auto_values_use_the_busiest_account(spark):
    terms = spark.createDataFrame([("C1", "auto", "auto", "auto", "auto"), ("C2", "B", "GCP", "2024-01-01", "2024-12-31")],
                                  "contract_id string, account_id string, cloud_provider string, start_date string, end_date string")
    got = by(readers.resolve_auto_values(terms, usage(spark, ("2024-06-01T00:00", 5)), AS_OF), "contract_id")
    assert (got["C1"].account_id, got["C1"].cloud_provider, got["C1"].start_date, got["C1"].end_date) == ("A", "AWS", d("2023-07-01"), d("2025-06-30"))
    assert got["C2"].account_id == "B" and got["C2"].end_date == d("2024-12-31")


def test_first_configuration_set_gives_the_metadata(spark):
    one, two = contracts(spark, contract("C1")), contracts(spark, contract("C2")).drop("notes")
    meta = spark.createDataFrame([("A",)], "account_id string")
    accounts, merged = readers.load_dimensions([(meta, one), (meta.limit(0), two)])
    assert accounts.count() == 1 and merged.count() == 2
