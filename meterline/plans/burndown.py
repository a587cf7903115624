"""The contract burndown, kept as a table and refreshed by what changed.

Three stored tables, each partitioned by month: the cost of each account, cloud and day;
the burndown itself; and what every contract had spent by the end of each month. A refresh
finds the first month that differs from the last one: a month whose day totals got rows,
late ones included, the start of a contract that is new, changed or gone, or the day of
the last refresh. Months before it keep their files and are not read; from it on days are
added up from the amount carried in.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.functions.columns import day, month_of
from meterline.operators.contracts import burndown_columns, daily_account_costs, join_term, running_cost
from meterline.operators.upkeep import add_up
from meterline.sources.stored_table import NULL_VALUE, StoredTable, Version

AMOUNT = "decimal(38,16)"


def _month(of: date) -> date:
    return of.replace(day=1)


class BurndownStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.days = StoredTable(spark, f"{self.folder}/day_totals", "month")
        self.burndown = StoredTable(spark, f"{self.folder}/burndown", "month")
        self.carried = StoredTable(spark, f"{self.folder}/carried", "month")

    def add_costs(self, rows: DataFrame, batch: str) -> Version:
        """Add enriched rows (originals, late ones, negative corrections) to the day totals, once for each batch. Rows without a day are left out."""
        totals = daily_account_costs(rows.filter(F.col("usage_date").isNotNull())).withColumn("month", month_of("usage_date"))
        totals = totals.withColumn("daily_cost", F.col("daily_cost").cast(AMOUNT)).select("account_id", "cloud_provider", "usage_date", "daily_cost", "record_count", "month")
        return add_up(self.days, totals, ["account_id", "cloud_provider", "usage_date"], ["daily_cost", "record_count"], batch)

    def _first_change(self, built: Version, days: Version, terms: DataFrame, as_of: date) -> date | None:
        """The first month to make anew; None if nothing changed."""
        if built.schema is None:
            return date.min
        then = self.days.version(built.facts["days"]).partitions
        found = [date.fromisoformat(m) for m in then.keys() | days.partitions.keys() if then.get(m) != days.partitions.get(m) and m != NULL_VALUE]
        before = date.fromisoformat(built.facts["as_of"])
        if before != as_of:
            found.append(_month(min(before, as_of) + timedelta(days=1)))
        known = self.spark.read.schema(terms.schema).parquet(built.facts["terms"])
        changed = terms.exceptAll(known).unionByName(known.exceptAll(terms)).agg(F.min("start_date")).first()[0]
        return min([*found, *([_month(changed)] if changed else [])], default=None)

    def refresh(self, contracts: DataFrame, as_of: date) -> date | None:
        """Bring the burndown of active contracts up to ``as_of``; the first month made anew, None if there was none.

        A refresh that died is simply run again: what it wrote is only read once the
        burndown's version, which comes last, names it as done.
        """
        built, days = self.burndown.current(), self.days.current()
        terms = contracts.filter(F.col("status") == "ACTIVE")
        first = self._first_change(built, days, terms, as_of)
        if first is None:
            return None
        months = sorted(m for m in map(date.fromisoformat, days.partitions) if m >= first)
        earlier = sorted(m for m in (date.fromisoformat(m) for m in self.carried.current().partitions) if m < first)
        rows = join_term(terms, self.days.read(months, days).drop("month"), F.col("c.end_date")).filter(F.col("usage_date") <= day(as_of))
        if earlier:
            carried = self.carried.read([earlier[-1]]).select("contract_id", "carried")
        else:
            carried = terms.select("contract_id", F.lit(0).cast(AMOUNT).alias("carried"))
        rows = rows.join(carried, "contract_id", "left").withColumn("cumulative_cost", (F.coalesce("carried", F.lit(0)) + running_cost()).cast(AMOUNT)).drop("carried")
        made = burndown_columns(rows).withColumn("month", month_of("usage_date"))

        # The files below are read again for the amounts carried out of each month.
        drafted = self.burndown.stage(made)
        fresh = self._staged(made, drafted)
        ends = fresh.groupBy("contract_id", "month").agg(F.max_by("cumulative_cost", "usage_date").alias("carried"))
        every = terms.select("contract_id").unionByName(carried.select("contract_id")).distinct().select("contract_id", F.explode(F.array(*map(F.lit, months))).alias("month")) if months else None
        if every is not None:
            filled = every.join(ends, ["contract_id", "month"], "left").join(carried.withColumnRenamed("carried", "before"), "contract_id", "left")
            last = F.last("carried", ignorenulls=True).over(W.partitionBy("contract_id").orderBy("month").rowsBetween(W.unboundedPreceding, W.currentRow))
            filled = filled.select("contract_id", F.coalesce(last, "before", F.lit(0)).cast(AMOUNT).alias("carried"), "month")
            self.carried.replace(filled, [m for m in map(date.fromisoformat, self.carried.current().partitions) if m >= first] + months)

        known = f"{self.folder}/terms/{days.number}-{built.number + 1}-{as_of.isoformat()}"
        terms.write.mode("overwrite").parquet(known)
        gone = [m for m in map(date.fromisoformat, built.partitions) if m >= first]
        self.burndown.adopt(made, drafted, gone, {"days": days.number, "as_of": as_of.isoformat(), "terms": known})
        return first

    def _staged(self, made: DataFrame, drafted: dict[str, str]) -> DataFrame:
        return self.burndown.read(version=Version(schema=made.schema.jsonValue(), partitions={k: [f] for k, f in drafted.items()}))

    def read(self) -> DataFrame:
        return self.burndown.read().drop("month")
