"""Tables that change by whole partitions: staged writes under one pointer.

A table is a folder of Parquet partitions that are never changed once written, and of
numbered version files. A version names the folders of every partition, the batches that
went into the table and a few facts of its owner. A change writes new folders first, then
puts the next version in place with one rename that fails if another writer was there
before. What was written without a version, by a task or a job that died, is never read.

Rows are written and read by Spark; only names of partitions pass through the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WRITE = "_write"
NULL_VALUE = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Another writer put the next version in place first."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    schema: dict | None = None
    #: Partition value as text -> folders below ``parts``.
    partitions: dict[str, list[str]] = field(default_factory=dict)
    batches: tuple[str, ...] = ()
    facts: dict = field(default_factory=dict)


class StoredTable:
    """A table partitioned by one column of dates or whole numbers."""

    def __init__(self, spark: SparkSession, path: str, by: str):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    # versions

    def _at(self, *names: str):
        return self._hadoop.Path("/".join([self.path, *names]))

    def _names(self, *folder: str) -> list[str]:
        at = self._at(*folder)
        fs = at.getFileSystem(self._conf)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _load(self, *names: str) -> Version:
        at = self._at(*names)
        found = json.loads("".join(r.value for r in self.spark.read.text(at.toString(), wholetext=True).collect()))
        return Version(**(found | {"batches": tuple(found["batches"])}))

    def _put(self, version: Version, *names: str) -> None:
        """Write a version file beside its place, then rename it there unless one is there already."""
        draft, place = self._at(f".draft-{uuid4().hex}"), self._at(*names)
        fs = draft.getFileSystem(self._conf)
        fs.mkdirs(place.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(version.__dict__ | {"batches": list(version.batches)}).encode()))
        out.close()
        files = self._hadoop.FileContext.getFileContext(fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            files.rename(draft, place, none)
        except Exception as error:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {version.number} of {self.path} exists") from error
            raise

    def version(self, number: int) -> Version:
        return self._load("versions", f"{number:012d}.json") if number else Version()

    def current(self) -> Version:
        """The newest version; an empty one before the first write."""
        numbers = [int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json")]
        return self.version(max(numbers, default=0))

    # rows

    def _key(self, value) -> str:
        return NULL_VALUE if value is None else str(value)

    def read(self, values: list | None = None, version: Version | None = None) -> DataFrame:
        """The rows, or those of some partitions; other folders are not even listed."""
        v = version or self.current()
        if v.schema is None:
            raise ValueError(f"{self.path} holds no version")
        schema = T.StructType.fromJson(v.schema)
        keys = v.partitions if values is None else [k for k in map(self._key, values) if k in v.partitions]
        folders = [f"{self.path}/parts/{f}" for k in keys for f in v.partitions[k]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        stored = T.StructType([*[f for f in schema.fields if f.name != self.by], T.StructField(WRITE, T.StringType()), schema[self.by]])
        rows = self.spark.read.schema(stored).option("basePath", f"{self.path}/parts").parquet(*folders)
        return rows.select(*schema.names)

    def stage(self, df: DataFrame) -> dict[str, str]:
        """Write rows into folders of their own; partition value -> folder. Nothing reads them yet."""
        if df.schema[self.by].dataType.typeName() not in ("date", "integer", "long", "short"):
            raise TypeError("a table is partitioned by dates or whole numbers")
        write = f"{WRITE}={uuid4().hex}"
        df.hint("rebalance", self.by).write.partitionBy(self.by).parquet(f"{self.path}/parts/{write}")
        return {n.removeprefix(f"{self.by}="): f"{write}/{n}" for n in self._names("parts", write) if n.startswith(f"{self.by}=")}

    def _commit(self, old: Version, df: DataFrame, partitions: dict, batch: str | None, facts: dict | None) -> Version:
        schema = json.loads(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]).json())
        new = replace(old, number=old.number + 1, schema=schema, partitions=partitions, batches=old.batches + ((batch,) if batch else ()), facts=old.facts | (facts or {}))
        self._put(new, "versions", f"{new.number:012d}.json")
        return new

    def replace(self, df: DataFrame, values: list | None = None, batch: str | None = None, facts: dict | None = None) -> Version:
        """Put ``df`` in the place of some partitions (of all, without ``values``); the others keep their files."""
        old = self.current()
        gone = set(old.partitions) if values is None else {self._key(v) for v in values}
        fresh = self.stage(df)
        if values is not None and not set(fresh) <= gone:
            raise ValueError(f"rows outside the replaced partitions: {sorted(set(fresh) - gone)[:5]}")
        return self._swap(old, df, fresh, gone, batch, facts)

    def adopt(self, df: DataFrame, staged: dict[str, str], values: list, facts: dict | None = None) -> Version:
        """Put what ``stage`` wrote of ``df`` in the place of some partitions."""
        return self._swap(self.current(), df, staged, {self._key(v) for v in values}, None, facts)

    def _swap(self, old: Version, df: DataFrame, fresh: dict[str, str], gone: set[str], batch: str | None, facts: dict | None) -> Version:
        kept = {k: f for k, f in old.partitions.items() if k not in gone}
        return self._commit(old, df, kept | {k: [f] for k, f in fresh.items()}, batch, facts)

    def append(self, df: DataFrame, batch: str) -> bool:
        """Add a batch once. A batch the table has already is left out, also after a try that died half-way. True if rows were added."""
        old = self.current()
        if batch in old.batches:
            return False
        fresh = self.stage(df)
        self._commit(old, df, old.partitions | {k: [*old.partitions.get(k, []), f] for k, f in fresh.items()}, batch, None)
        return True

    # snapshots

    def _files(self, version: Version) -> DataFrame:
        """file, length and digest of every file of a version, read by the executors."""
        folders = [f"{self.path}/parts/{f}" for own in version.partitions.values() for f in own]
        if not folders:
            return self.spark.createDataFrame([], "file string, length long, digest string")
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folders)
        return found.select(F.regexp_extract("path", f"{WRITE}=.*$", 0).alias("file"), "length", F.sha2("content", 256).alias("digest"))

    def snapshot(self, label: str) -> Version:
        """Keep the present version under a name: its folders, and size and digest of their files. No row is copied."""
        now = self.current()
        self._files(now).write.mode("overwrite").parquet(f"{self.path}/snapshots/{label}-files")
        self._put(now, "snapshots", f"{label}.json")
        return now

    def restore(self, label: str) -> list[str]:
        """Go back to a snapshot, after its files were found unchanged; the partitions that differed from it. No row is rewritten."""
        then, now = self._load("snapshots", f"{label}.json"), self.current()
        wanted = self.spark.read.schema("file string, length long, digest string").parquet(f"{self.path}/snapshots/{label}-files")
        present = self._present(then)
        damaged = wanted.join(present, ["file", "length", "digest"], "left_anti").limit(5).collect()
        if damaged:
            raise ValueError(f"snapshot {label} is damaged: {[r.file for r in damaged]}")
        self._put(replace(then, number=now.number + 1), "versions", f"{now.number + 1:012d}.json")
        return sorted(k for k in then.partitions.keys() | now.partitions.keys() if then.partitions.get(k) != now.partitions.get(k))

    def _present(self, version: Version) -> DataFrame:
        fs = self._at("parts").getFileSystem(self._conf)
        there = {k: [f for f in own if fs.exists(self._at("parts", f))] for k, own in version.partitions.items()}
        return self._files(replace(version, partitions=there))


def bucket(keys: list[str], buckets: int):
    """A partition number by the hash of a row's keys, so that a row is always found in the same partition."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
