"""Dimension upkeep: row-level changes expressed as whole-frame rewrites.

Each function returns the new content; the caller writes it to a new path and
switches over, because a table cannot be overwritten while it is read.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.functions.columns import before, day, since
from meterline.params import ARCHIVE_AFTER_DAYS
from meterline.sources.stored_table import StoredTable, Version

INSERT, UPDATE, KEEP = "insert", "update", "unchanged"
ROWS_A_TASK = 500_000
#: A key's rows of one batch are summed by up to so many tasks before they meet.
SPREAD = 8


def single_keys(source: DataFrame, keys: list[str]) -> DataFrame:
    """``source``, failing at run time where a key has several rows. The count is dealt by the keys, as the join after it."""
    copies = F.count("*").over(W.partitionBy(*keys))
    return source.withColumn("_copies", copies).filter(F.assert_true(F.col("_copies") == 1, "a source key has several rows").isNull()).drop("_copies")


def _merge(target: DataFrame, source: DataFrame, keys: list[str], changed: Column, keep: tuple[str, ...]) -> DataFrame:
    """Full join on the keys; ``changed`` decides about rows found on both sides."""
    source = single_keys(source, keys)
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    both = reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys])
    in_t, in_s = F.col("_t").isNotNull(), F.col("_s").isNotNull()
    action = F.when(~in_t, INSERT).when(in_s & changed, UPDATE).otherwise(KEEP)
    taken = ~in_t | (in_s & changed)

    def value(name: str) -> Column:
        if name in keys:
            return F.coalesce(F.col(f"t.{name}"), F.col(f"s.{name}"))
        if name not in source.columns:
            return F.col(f"t.{name}")
        if name in keep:
            return F.when(in_t, F.col(f"t.{name}")).otherwise(F.col(f"s.{name}"))
        return F.when(taken, F.col(f"s.{name}")).otherwise(F.col(f"t.{name}"))

    return t.join(s, both, "full").select(*[value(c).alias(c) for c in target.columns], action.alias("_action"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Update matching rows, insert the rest; creation stamps survive.

    A key with several source rows fails the job. Target keys are taken to be unique, as
    the tables declare; ``quality.validate_contracts`` reports where they are not.
    """
    return _merge(target, source, keys, F.lit(True), keep)


def upsert_changed(target: DataFrame, source: DataFrame, keys: list[str], compare: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Update only where a compared column differs, nulls counting as values."""
    differs = reduce(lambda a, b: a | b, [~F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in compare])
    return _merge(target, source, keys, differs, keep)


def action_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("_action").agg(F.count("*").alias("rows"))


def replace_by_prefix(target: DataFrame, source: DataFrame, key: str = "tier_id", patterns: tuple[str, ...] = ("TIER_%", "DEFAULT_%")) -> DataFrame:
    """Drop rows whose key matches a LIKE pattern, then add the new rows.

    ``_`` is a wildcard in the patterns, as in SQL.
    """
    hit = reduce(lambda a, b: a | b, [F.col(key).like(p) for p in patterns])
    return target.filter(~F.coalesce(hit, F.lit(False))).unionByName(source)


def merge_scenarios(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return upsert(target, source, keys)


def flag_best(rows: DataFrame, best: DataFrame, flag: str = "is_sweet_spot", key: str = "scenario_id") -> DataFrame:
    """Clear a flag everywhere and set it on the chosen keys."""
    chosen = best.select(key).distinct().withColumn("_best", F.lit(True))
    return rows.drop(flag).join(chosen, key, "left").withColumn(flag, F.coalesce("_best", F.lit(False))).drop("_best")


def archive_split(df: DataFrame, as_of: date, days: int = ARCHIVE_AFTER_DAYS, date_col: str = "usage_date") -> tuple[DataFrame, DataFrame]:
    """(kept, archived). Both are plain date filters, so partitions are pruned."""
    old = F.col(date_col) < before(as_of, days)
    return df.filter(~old), df.filter(old)


def archive_summary(archived: DataFrame) -> DataFrame:
    return archived.agg(
        F.count("*").alias("archived_records"), F.min("usage_date").alias("oldest_date"), F.max("usage_date").alias("newest_date"),
        F.round(F.sum("actual_cost"), 2).alias("total_archived_cost"),
    )


def _status(as_of: date) -> Column:
    return F.when(F.col("end_date") < day(as_of), "EXPIRED").when(F.col("start_date") > day(as_of), "PENDING").otherwise("ACTIVE")


def derive_status(contracts: DataFrame, as_of: date) -> DataFrame:
    return contracts.withColumn("old_status", F.col("status")).withColumn("status", _status(as_of))


def status_changes(contracts: DataFrame, as_of: date) -> DataFrame:
    """Contracts whose derived status differs. One pass; no self-join is needed."""
    return derive_status(contracts, as_of).filter(~F.col("old_status").eqNullSafe(F.col("status"))).select(
        "contract_id", "old_status", F.col("status").alias("new_status"), "end_date"
    )


def delete_where(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed). A null condition keeps the row, as DELETE does."""
    hit = F.coalesce(condition, F.lit(False))
    return df.filter(~hit), df.filter(hit)


def drop_orphan_accounts(accounts: DataFrame, contracts: DataFrame) -> DataFrame:
    return accounts.join(contracts.select("account_id"), "account_id", "left_semi")


def insert_missing_accounts(accounts: DataFrame, usage: DataFrame, as_of: date, defaults: dict[str, str], days: int = 30) -> DataFrame:
    """Accounts seen lately but absent from the metadata, filled with defaults.

    The anti join is unaffected by null ids in the metadata.
    """
    seen = usage.filter(since(as_of, days)).select("account_id").distinct()
    stamp = day(as_of).cast("timestamp")
    fresh = seen.join(accounts.select("account_id"), "account_id", "left_anti").withColumns(
        {**{k: F.lit(v) for k, v in defaults.items()}, "created_at": stamp, "updated_at": stamp}
    )
    return accounts.unionByName(fresh, allowMissingColumns=True)


def seed_contract(usage: DataFrame, as_of: date, days: int = 30, value: float = 5000.0) -> DataFrame:
    """A one-year contract for the account and cloud with most recent usage."""
    top = (
        usage.filter(since(as_of, days)).groupBy("account_id", "cloud").agg(F.sum("usage_quantity").alias("q"))
        .orderBy(F.desc("q"), "account_id", "cloud").limit(1)
    )
    return top.select(
        F.concat(F.lit("CONTRACT_"), F.unix_timestamp(day(as_of).cast("timestamp")).cast("string")).alias("contract_id"), "account_id",
        F.col("cloud").alias("cloud_provider"), day(as_of).alias("start_date"), day(as_of + timedelta(days=365)).alias("end_date"),
        F.lit(value).cast("decimal(18,2)").alias("total_value"), F.lit("USD").alias("currency"), F.lit("SPEND").alias("commitment_type"),
        F.lit("ACTIVE").alias("status"),
    )


def bulk_assign(accounts: DataFrame, teams: DataFrame, unit: str = "business_unit_l0") -> DataFrame:
    """Set team columns from a business-unit table; units not listed keep theirs."""
    columns = [c for c in teams.columns if c != unit]
    side = teams.select(unit, *[F.col(c).alias(f"_n_{c}") for c in columns])
    return accounts.join(side, unit, "left").select(
        *[F.coalesce(f"_n_{c}", c).alias(c) if c in columns else F.col(c) for c in accounts.columns]
    )


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


# --- stored tables -----------------------------------------------------------

def upsert_stored(table: StoredTable, source: DataFrame, keys: list[str], keep: tuple[str, ...] = ("created_at",), batch: str | None = None) -> Version:
    """Upsert into a stored table: only partitions that hold source keys are read and written anew.

    The partition column has to follow from the keys (one of them, or ``bucket`` of them)
    and be in ``source``. A failure before the version is in place leaves the table as it
    was. A ``batch`` that the table has already changes nothing.
    """
    old = table.current()
    if batch is not None and batch in old.batches:
        return old
    touched = [r[0] for r in source.select(table.by).distinct().collect()]  # partitions, at most
    if old.schema is None:
        return table.replace(single_keys(source, keys), touched, batch)
    merged = upsert(table.read(touched, old), source, keys, keep)
    return table.replace(merged.drop("_action"), touched, batch)


def add_up(table: StoredTable, delta: DataFrame, keys: list[str], sums: list[str], batch: str) -> Version:
    """Add a batch of sums per key to a stored table of such sums, once; only the partitions of its keys are read and written anew.

    Sums may be negative, and batches may come in any order. ``delta`` holds the keys, the
    sums and the partition column, and nothing else; its keys may repeat.
    """
    old = table.current()
    if batch in old.batches:
        return old
    counted = delta.groupBy(table.by).count().collect()  # partitions, at most
    touched, n = [r[0] for r in counted], sum(r[1] for r in counted)
    rows = delta
    if old.schema is not None:
        stored = table.read(touched, old)
        rows, n = stored.unionByName(delta), n + stored.count()
    kinds = {f.name: f.dataType for f in (delta.schema if old.schema is None else T.StructType.fromJson(old.schema)).fields}
    by = list(dict.fromkeys([*keys, table.by]))
    return table.replace(summed(rows, by, kinds, sums, n).select(*kinds), touched, batch)


def summed(rows: DataFrame, by: list[str], kinds: dict[str, T.DataType], sums: list[str], n: int) -> DataFrame:
    """Sums of ``n`` rows by key. Tasks get about ``ROWS_A_TASK`` rows each, so that their memory does not grow with the table.

    Rows meet in two steps: a key of very many rows is summed by several tasks first.
    """
    tasks = -(-n // ROWS_A_TASK) or 1
    total = [F.sum(c).cast(kinds[c]).alias(c) for c in sums]
    part = F.pmod(F.spark_partition_id(), F.lit(SPREAD)).alias("_part")
    first = rows.select(*by, *sums, part).repartition(tasks, *by, "_part").groupBy(*by, "_part").agg(*total)
    return first.repartition(tasks, *by).groupBy(*by).agg(*total)
