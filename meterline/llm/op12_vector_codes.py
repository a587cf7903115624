"""Vector codes: one byte for each of four parts of a vector, the nearest entry of that part's codebook.

Vectors become integers, so distances, ties and means are exact and the same on every
machine. Each round assigns all parts and moves each entry to the mean of its parts; only
the sums of each entry leave a task, and the codebooks alone pass through the driver.

The nearest entry is found by Orchard's search. Every entry has a list of all entries by
distance from it. A search walks the list of the best entry it knows, skips entries it has
marked as seen, jumps to the list of any entry that is nearer, and stops where the list
passes twice the present distance: by the triangle inequality nothing beyond is as near.
Many parts walk their lists side by side, a few places of the list at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.tables import Run, small, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Places of a list looked at in one step, and parts that search side by side.
STRIDE, ABREAST = 16, 2048


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = a - b
    return np.einsum("...i,...i->...", apart, apart)


@dataclass
class Codebook:
    """The entries (rows of int64) of one part, and for each entry all entries by distance, then index."""

    entries: np.ndarray
    lists: np.ndarray = field(init=False)
    apart: np.ndarray = field(init=False)  # squared distances, in the order of the list

    def __post_init__(self) -> None:
        k = len(self.entries)
        apart = np.stack([squares(self.entries, e) for e in self.entries]) if k else np.empty((0, 0), np.int64)
        self.lists = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.lists, axis=1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point the index of its nearest entry, the lowest of equally near ones, and the squared distance."""
        entries = self.entries
        most = max((int(np.abs(x).max()) for x in (points, entries) if x.size), default=0)
        if entries.shape[1] * (2 * most) ** 2 < 2**31:  # the same numbers in half the memory
            points, entries = points.astype(np.int32), entries.astype(np.int32)
        done = [self._search(points[i : i + ABREAST], entries) for i in range(0, len(points), ABREAST)]
        return tuple(np.concatenate(x) if done else np.empty(0, np.int64) for x in (zip(*done) if done else ((), ())))

    def _search(self, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(points), len(entries)
        at, best = np.zeros(n, np.int64), squares(points, entries[0]).astype(np.int64)
        seen = np.zeros(n * k, bool)
        seen[::k] = True
        place, live = np.zeros(n, np.int64), np.arange(n)
        lists, apart, step = self.lists.reshape(-1), self.apart.reshape(-1), np.arange(STRIDE)[:, None]
        while len(live):
            # A row for each place of the list, a column for each point.
            columns = place[live] + step
            inside = columns < k
            here = at[live] * k + np.minimum(columns, k - 1)
            entry = lists[here]
            near = inside & (apart[here] <= 4 * best[live])
            marks = live * k + entry
            new = np.flatnonzero(near & ~seen[marks])
            seen[marks.reshape(-1)[new]] = True
            far = np.full(entry.shape, np.iinfo(np.int64).max)
            far.reshape(-1)[new] = squares(points[live[new % len(live)]], entries[entry.reshape(-1)[new]])
            least = far.min(axis=0)
            name = np.where(far == least, entry, k).min(axis=0)
            jump = (least < best[live]) | ((least == best[live]) & (name < at[live]))
            moved = live[jump]
            at[moved], best[moved], place[moved] = name[jump], least[jump], 0
            place[live[~jump]] += STRIDE
            live = live[jump | near.all(axis=0)]
        return at, best


def _points(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def whole_numbers(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label and v (integers, zeros added up to a multiple of the parts) of the vectors that take part, and v's length."""
    x = F.col("embedding").cast("array<double>")
    fit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("v")).where("v IS NOT NULL")
    fit = fit.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    common = fit.where(F.size("v") > 0).groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    length = common["n"] if common else 0
    width = math.ceil(length / PARTS) * PARTS
    most = float(math.isqrt(2**61 // max(width, 1)) // 2)  # so far apart, four times a whole squared distance still fits a long
    held = F.transform("v", lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-most)), F.lit(most))).cast("int"))
    return fit.where((F.size("v") == length) & (F.size("v") > 0)).select("vec_id", "label", F.concat(held, F.array_repeat(F.lit(0), width - length)).alias("v")), width


def vector_codes(vectors: DataFrame, *, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 for each row of ``vectors`` (vec_id, embedding, label, any others).

    Rows whose vector is null or holds null or non-finite components are left out, as are
    vectors of another length than most. Components of more than about 92,000 (at length 64; of a size
    that no distance passes a long) count as that. Rows that repeat an id are rows of their
    own; a null id never starts a codebook before others do. Null labels are one label.
    With fewer vectors than entries the codebooks are that much smaller; an empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    run = Run(spark, "codes")
    kept, width = whole_numbers(vectors)
    kept, part = run.keep(kept), max(width // PARTS, 1)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), PARTS, -1) if first else np.empty((0, PARTS, part), np.int64)
    books = [Codebook(start[:, p]) for p in range(PARTS)]

    def assigned(shared):
        def cut(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            points = _points(batch["v"])
            for p, book in enumerate(shared.value):
                own = points[:, p * part : (p + 1) * part]
                yield own, *book.nearest(own)

        return cut

    def moved(shared):
        cut = assigned(shared)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((PARTS, len(shared.value[0].entries), part), np.int64)
            count = np.zeros(total.shape[:2], np.int64)
            for batch in batches:
                if batch.num_rows:
                    for p, (own, code, _) in enumerate(cut(batch)):
                        order = np.argsort(code, kind="stable")
                        used, at = np.unique(code[order], return_index=True)
                        total[p, used] += np.add.reduceat(own[order], at, axis=0)
                        count[p] += np.bincount(code, minlength=count.shape[1])
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        return add_up

    for _ in range(rounds if first else 0):
        shared = spark.sparkContext.broadcast(books)  # bounded by the number of entries
        sums = kept.select("v").mapInArrow(moved(shared), "part long, entry long, n long, sums array<long>")
        means = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(part)]).alias("sums"))
        tables = [b.entries.copy() for b in books]
        for r in means.collect():  # one row an entry at most
            tables[r["part"]][r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
        books = [Codebook(t) for t in tables]

    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.entries.reshape(-1)).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = assigned(shared)
        for batch in batches:
            if batch.num_rows:
                found = [(code, error) for _, code, error in cut(batch)]
                names = np.stack([code for code, _ in found], axis=1).astype(np.uint8 if entries <= 256 else ">u2")
                text = pa.array([x.tobytes().hex() for x in names])
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], text, pa.array(sum(error for _, error in found))], ["vec_id", "label", "code", "error"])

    kind = kept.schema["label"].dataType.simpleString()
    codes = run.keep(kept.mapInArrow(encode, f"vec_id long, label {kind}, code string, error long"))
    sums = run.keep(codes.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")))
    out = codes.join(small(sums, 64), F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes(table(spark, folder, "embeddings")).drop("label")


def _sql() -> str:
    """The same by comparing every part with every entry."""
    steps = [
        f"""kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v, len(embedding) // {PARTS} AS w
    FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * w + 1 : p * w + w] AS x FROM kept, range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT p, r AS e, x AS entry FROM parts WHERE r < {ENTRIES})"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
    SELECT r, p, min(list_sum(list_transform(list_zip(x, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {ENTRIES} + e)::BIGINT AS best
    FROM parts JOIN book{i} USING (p) GROUP BY r, p)""")
        if i < ROUNDS:
            steps.append(f"""mean{i} AS MATERIALIZED (
    SELECT p, e, list(m ORDER BY i) AS entry FROM (
        SELECT p, best % {ENTRIES} AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS m
        FROM near{i} JOIN parts USING (r, p), LATERAL (SELECT unnest(range(1, len(x) + 1))) t(i) GROUP BY ALL) GROUP BY p, e),
book{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.entry, b.entry) AS entry FROM book{i} b LEFT JOIN mean{i} m USING (p, e))""")
    return (
        "WITH "
        + ",\n".join(steps)
        + f""",
coded AS (
    SELECT r, string_agg(lpad(to_hex(best % {ENTRIES}), 2, '0'), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM near{ROUNDS} GROUP BY r)
SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""
    )


SQL = _sql()
