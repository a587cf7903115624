"""Stored tables: staged writes, ledger, snapshots, the refreshed burndown and the stream of corrections."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from meterline.operators import contracts as c
from meterline.operators import cost, upkeep
from meterline.plans.burndown import BurndownStore
from meterline.sources.stored_table import Conflict, StoredTable, bucket
from meterline.streaming.corrections import net_corrections_stream, net_of, net_table
from tests.helpers import USAGE, contract, contracts, costs, d


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def numbers(spark, n=20, value=10):
    return spark.range(n).select("id", (F.col("id") * value).alias("v")).withColumn("b", bucket(["id"], 4))


@pytest.fixture()
def table(spark, scratch):
    t = StoredTable(spark, f"{scratch}/t", "b")
    t.replace(numbers(spark))
    return t


def test_upsert_rewrites_only_touched_partitions(spark, table):
    before = table.current()
    source = numbers(spark, 2, -1).unionByName(numbers(spark, 30).filter("id = 29"))
    after = upkeep.upsert_stored(table, source, ["id"])
    touched = {str(r.b) for r in source.select("b").distinct().collect()}
    assert {k for k in after.partitions if after.partitions[k] != before.partitions.get(k)} == touched and len(touched) < 4
    want = upkeep.upsert(numbers(spark), source, ["id"]).drop("_action")
    assert rows(table.read()) == rows(want.select("id", "v", "b")) and table.read(version=before).count() == 20


def test_a_write_killed_before_the_swap_leaves_the_old_table(spark, table, monkeypatch):
    before = rows(table.read())
    monkeypatch.setattr(StoredTable, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        upkeep.upsert_stored(table, numbers(spark, 20, -1), ["id"], batch="x")
    monkeypatch.undo()
    again = StoredTable(spark, table.path, "b")
    assert rows(again.read()) == before and again.current().number == 1
    assert upkeep.upsert_stored(again, numbers(spark, 20, -1), ["id"], batch="x").number == 2
    assert again.read().agg(F.sum("v")).first()[0] == -190
    assert upkeep.upsert_stored(again, numbers(spark, 20, 7), ["id"], batch="x").number == 2  # the batch is in already


def test_two_writers_do_not_overwrite_each_other(spark, table):
    old = table.current()
    staged = table.stage(numbers(spark, 5, 1))
    table.replace(numbers(spark, 3))
    with pytest.raises(Conflict):
        table._swap(old, numbers(spark, 5, 1), staged, set(old.partitions), None, None)
    assert table.read().count() == 3


def test_a_batch_is_added_once(spark, table, monkeypatch):
    batch = numbers(spark, 3)
    monkeypatch.setattr(StoredTable, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        table.append(batch, "day-1")  # rows are written, the version is not
    monkeypatch.undo()
    assert table.read().count() == 20
    assert table.append(batch, "day-1") and not table.append(batch, "day-1")
    assert table.read().count() == 23 and table.append(batch, "day-2") and table.read().count() == 26


def test_a_snapshot_copies_no_rows_and_restores_what_changed(spark, table):
    want, folders = rows(table.read()), set(table._names("parts"))
    table.snapshot("monday")
    assert set(table._names("parts")) == folders
    source = numbers(spark, 1, 5)
    upkeep.upsert_stored(table, source, ["id"])
    held = set(table._names("parts"))
    assert table.restore("monday") == [str(source.first().b)]
    assert rows(table.read()) == want and set(table._names("parts")) == held and table.current().number == 3
    with pytest.raises(Conflict):
        table.snapshot("monday")


@pytest.mark.parametrize("how", ["changed", "missing"])
def test_a_damaged_snapshot_is_refused(spark, table, how, tmp_path):
    version = table.snapshot("s")
    folder = tmp_path / "t" / "parts" / version.partitions["0"][0]
    file = next(folder.glob("*.parquet"))
    (file.parent / f".{file.name}.crc").unlink()  # a local file system's own guard
    file.write_bytes(b"x" * 9) if how == "changed" else file.unlink()
    with pytest.raises(ValueError, match="damaged"):
        table.restore("s")
    assert table.current().number == 1


def test_odd_tables(spark, scratch):
    t = StoredTable(spark, f"{scratch}/n", "b")
    with pytest.raises(ValueError, match="no version"):
        t.read()
    df = spark.createDataFrame([(1, None), (2, 3)], "v long, b int")
    t.replace(df)
    assert rows(t.read()) == rows(df) and t.read([None]).count() == 1 and t.read([99]).count() == 0
    t.replace(df.limit(0))
    assert t.read().count() == 0 and t.read().columns == ["v", "b"]
    with pytest.raises(ValueError, match="outside"):
        t.replace(df, [3])
    with pytest.raises(TypeError):
        StoredTable(spark, f"{scratch}/m", "b").replace(df.select("v", F.lit("x").alias("b")))


# Burndown

AS_OF = d("2024-06-30")


def spending(seed, days=170, start="2024-01-05"):
    rng = random.Random(seed)
    return [((d(start) + timedelta(days=i)).isoformat(), rng.randrange(1, 900) / 100) for i in range(days) for _ in range(rng.randrange(3))]


def full(terms, dash, as_of=AS_OF):
    out = c.contract_burndown(terms, dash, as_of)
    return rows(out.select(*[F.col(f.name).cast("double") if f.dataType.typeName() == "decimal" else F.col(f.name) for f in out.schema.fields]))


def kept(store, like):
    return rows(store.read().select(*[F.col(f.name).cast("double") if f.dataType.typeName() == "decimal" else F.col(f.name) for f in like.schema.fields]))


def test_refresh_after_late_rows_equals_a_full_run(spark, scratch):
    terms = contracts(spark, contract("C1"), contract("C2", start="2024-03-10", end="2024-05-20"), contract("C3", account="B"), contract("C4", status="EXPIRED"))
    first, late = costs(spark, spending(1)), costs(spark, [("2024-04-03", 7.5), ("2024-04-03", -2.25), ("2024-05-21", 1), ("2024-06-02", None)])
    like = c.contract_burndown(terms, first, AS_OF)
    store = BurndownStore(spark, scratch)
    store.add_costs(first, "a")
    assert store.refresh(terms, AS_OF) == d("0001-01-01") and kept(store, like) == full(terms, first)
    before = store.burndown.current()
    store.add_costs(late, "b")
    store.add_costs(late, "b")  # tried again
    assert store.refresh(terms, AS_OF) == d("2024-04-01") and store.refresh(terms, AS_OF) is None
    assert kept(store, like) == full(terms, first.unionByName(late))
    after = store.burndown.current()
    assert all(after.partitions[m] == before.partitions[m] for m in ("2024-01-01", "2024-02-01", "2024-03-01"))
    assert after.partitions["2024-04-01"] != before.partitions["2024-04-01"]


def test_refresh_reads_only_touched_months(spark, scratch, monkeypatch):
    terms, store = contracts(spark, contract()), BurndownStore(spark, scratch)
    store.add_costs(costs(spark, spending(2)), "a")
    store.refresh(terms, AS_OF)
    store.add_costs(costs(spark, [("2024-06-03", 1)]), "b")
    asked = []
    plain = StoredTable.read
    monkeypatch.setattr(StoredTable, "read", lambda self, values=None, version=None: (asked.append((self.path.split("/")[-1], values)), plain(self, values, version))[1])
    assert store.refresh(terms, AS_OF) == d("2024-06-01")
    assert ("day_totals", [d("2024-06-01")]) in asked and ("carried", [d("2024-05-01")]) in asked
    assert [x for x in asked if x[0] == "day_totals"] == [("day_totals", [d("2024-06-01")])]


def test_refresh_follows_contracts_and_days(spark, scratch):
    dash, store = costs(spark, spending(3, 175)), BurndownStore(spark, scratch)
    store.add_costs(dash, "a")
    like = c.contract_burndown(contracts(spark, contract()), dash, AS_OF)
    steps = [
        ((contract(),), d("2024-03-31")), ((contract(),), d("2024-04-02")), ((contract(), contract("N", start="2024-02-15")), d("2024-04-02")),
        ((contract(value=5), contract("N", start="2024-02-15")), d("2024-05-05")), ((contract("N", start="2024-02-20"),), d("2024-05-05")),
        ((contract("N", start="2024-02-20"),), d("2024-03-05")), ((), d("2024-03-05")), ((contract(),), AS_OF),
    ]
    for terms, as_of in steps:
        terms = contracts(spark, *terms) if terms else contracts(spark, contract()).limit(0)
        store.refresh(terms, as_of)
        assert kept(store, like) == full(terms, dash, as_of)


def test_a_refresh_that_died_is_run_again(spark, scratch, monkeypatch):
    terms, dash, late = contracts(spark, contract()), costs(spark, spending(5)), costs(spark, [("2024-02-02", 3)])
    store = BurndownStore(spark, scratch)
    store.add_costs(dash, "a")
    store.refresh(terms, AS_OF)
    store.add_costs(late, "b")
    monkeypatch.setattr(StoredTable, "adopt", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.refresh(terms, AS_OF)
    monkeypatch.undo()
    like = c.contract_burndown(terms, dash, AS_OF)
    assert kept(store, like) == full(terms, dash)
    again = BurndownStore(spark, scratch)
    assert again.refresh(terms, AS_OF) == d("2024-02-01") and kept(again, like) == full(terms, dash.unionByName(late))


# Stream of corrections

DIMS = ["account_id", "sku_name", "usage_date"]


def records(seed, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = datetime(2024, 1, 1) + timedelta(days=rng.randrange(40))
        amount = Decimal(rng.randrange(-400, 600)) / 100
        out.append((rng.choice("AB"), "w1", rng.choice(["X", "Y", None]), "AWS", at, at.date(), "DBU", amount, "ORIGINAL" if amount > 0 else "RETRACTION"))
    return out


@pytest.mark.parametrize("order", [1, -1])
def test_stream_equals_batch_in_any_order_and_over_a_restart(spark, scratch, order):
    data = [spark.createDataFrame(records(i), USAGE) for i in range(4)][::order]
    whole = data[0].unionByName(data[1]).unionByName(data[2]).unionByName(data[3])
    table, source = net_table(spark, f"{scratch}/net"), f"{scratch}/in"

    def drain():
        stream = spark.readStream.schema(USAGE).option("maxFilesPerTrigger", 1).parquet(source)
        net_corrections_stream(stream, table, DIMS, f"{scratch}/check", buckets=4).awaitTermination()

    data[0].coalesce(1).write.parquet(f"{source}/0")
    data[1].coalesce(1).write.parquet(f"{source}/1")
    source = f"{scratch}/in/*"
    drain()
    for i in (2, 3):
        data[i].coalesce(1).write.parquet(f"{scratch}/in/{i}")
    drain()  # goes on from the checkpoint
    drain()  # nothing new
    want = cost.net_corrections(whole, DIMS)
    assert rows(net_of(table).select(*want.columns)) == rows(want.withColumn("net_quantity", F.col("net_quantity").cast("decimal(38,6)")))
    assert len(table.current().batches) == 4


def test_a_micro_batch_that_is_run_again_adds_nothing(spark, scratch, monkeypatch):
    """The table has the batch, the checkpoint has not: the stream died between the two."""
    spark.createDataFrame(records(8), USAGE).coalesce(1).write.parquet(f"{scratch}/in")
    table = net_table(spark, f"{scratch}/net")
    from meterline.streaming import corrections

    def dies(*a):
        upkeep.add_up(*a)
        raise RuntimeError("killed")

    start = lambda: net_corrections_stream(spark.readStream.schema(USAGE).parquet(f"{scratch}/in"), table, DIMS, f"{scratch}/check", buckets=2)
    monkeypatch.setattr(corrections, "add_up", dies)
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    monkeypatch.undo()
    start().awaitTermination()
    want = cost.net_corrections(spark.createDataFrame(records(8), USAGE), DIMS)
    assert table.current().number == 1 and rows(net_of(table).select("record_count", *DIMS)) == rows(want.select("record_count", *DIMS))


def test_records_delivered_twice_count_once(spark, scratch):
    once = spark.createDataFrame(records(9, 50), USAGE).withColumn("record", F.monotonically_increasing_id())
    for i in range(2):
        once.coalesce(1).write.parquet(f"{scratch}/in/{i}")
    table = net_table(spark, f"{scratch}/net")
    stream = spark.readStream.schema(once.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in/*")
    net_corrections_stream(stream, table, DIMS, f"{scratch}/check", buckets=2, record_id="record").awaitTermination()
    want = cost.net_corrections(once, DIMS)
    assert rows(net_of(table).select("record_count", *DIMS)) == rows(want.select("record_count", *DIMS))


def test_sums_are_made_by_tasks_of_bounded_rows(spark, scratch, monkeypatch):
    """More rows make more tasks, not larger ones; a batch need not be summed before."""
    monkeypatch.setattr(upkeep, "ROWS_A_TASK", 100)
    rows = spark.range(1000).select((F.col("id") % 300).alias("k"), F.lit(0).alias("bucket"), F.lit(Decimal(1)).cast("decimal(38,6)").alias("net_quantity"), F.lit(1).cast("long").alias("record_count"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    made = upkeep.summed(rows, ["k", "bucket"], kinds, ["net_quantity", "record_count"], 1000)
    assert made._jdf.queryExecution().executedPlan().toString().count(", 10)") == 2
    table = net_table(spark, f"{scratch}/sums")
    for batch in ("a", "b", "b"):
        upkeep.add_up(table, rows, ["k"], ["net_quantity", "record_count"], batch)
    assert sorted((r.k, int(r.net_quantity), r.record_count) for r in table.read().collect()) == [(k, 2 * n, 2 * n) for k in range(300) for n in [4 if k < 100 else 3]]
