"""Near-duplicate documents by MinHash.

1. Every text becomes its set of word shingles, one key for each band of many universal
   hash minima over it, and a parity signature: the shingles counted modulo 2 in a bitmap
   that grows with the set. Equal sets are one class from here on.
2. A class meets the smallest class of the bands it shares (one pair a class). Signatures,
   then full sets confirm the pair. Alternating large-star and small-star joins the links.
3. Where a band still holds several components, a few members of each are tried against
   members of its largest one, so that the exact finish has few links left to find.
4. What is left is finished exactly: classes of bands that still hold several components
   meet by their rarest shingles, so many of each that two similar sets must share one, and
   only where enough of both sets is left behind it. Sets outside a shingle's largest
   component are first tried against one set of it, a pair a set, which finds most links;
   then those of components that are still apart meet. A similar pair sharing a band is
   thus either in one component already or has been compared. Copies are never expanded
   into all pairs, nor pages that share a large common part.

Two parity signatures differ in no more bits than the sets differ in shingles, so the
signature check never drops a similar pair. With 32 bands of 4 rows a pair at similarity
0.8 shares no band with probability 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.tables import Run, small, small_batches, table
from meterline.llm.text_arrays import Words, mix, pieces, vacate, windows, words

BANDS, ROWS, SHINGLE, PERCENT = 32, 4, 4, 80
#: So many members of each component of a band are tried against its largest one before the exact finish.
TRIES = 4
_U = np.uint64


def shingle_sets(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their bounds. A text of fewer than n words has one, of all its words."""
    hashes, first, counts, text_of = found.hashes(lower=True), found.first, found.counts, found.text_of
    runs = windows(hashes, n)
    whole = np.flatnonzero(np.arange(len(runs)) + n <= first[text_of[: len(runs)] + 1])
    values, owner = [runs[whole]], [text_of[whole]]
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            values.append(windows(hashes, k)[first[short]])
            owner.append(short)
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def digests(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, zero for empty ones."""
    some, out = np.diff(bounds) > 0, np.zeros((2, len(bounds) - 1), _U)
    if some.any():
        at = bounds[:-1][some]
        out[0, some], out[1, some] = np.add.reduceat(mix(values), at), np.add.reduceat(mix(values ^ _U(0xA5A5A5A5A5A5A5A5)), at)
    return out[0], out[1]


def parity(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """For each set a bitmap of 4 to 8 bits a shingle, at least 64: which places an odd number of shingles falls on."""
    size = np.diff(bounds)
    bits = np.where(size > 0, 1 << np.maximum(6, np.ceil(np.log2(np.maximum(4 * size, 1))).astype(int)), 0)
    ends = np.cumsum(bits)
    place = np.repeat(ends - bits, size) + (values & np.repeat(bits - 1, size).astype(_U)).astype(np.int64)
    place.sort()
    runs = np.flatnonzero(np.diff(place, prepend=-1))
    odd = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    odd[place[runs[np.diff(runs, append=len(place)) % 2 == 1]]] = True
    flat = np.packbits(odd, bitorder="little").view("<i8")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends // 64]).astype(np.int32)), pa.array(flat))


def sketch(docs: DataFrame, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (low, high), bands, parity; null digest and no bands for an empty set."""
    rng = np.random.default_rng(8)
    times = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    plus = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in pieces(batches, "text", 1 << 19):
            values, bounds = shingle_sets(words(batch["text"]), n)
            some = np.diff(bounds) > 0
            at = bounds[:-1][some]
            keys = np.empty((len(at), bands), _U)
            low, high = digests(values, bounds)
            if len(at):
                x = (values >> _U(32)).astype(np.uint32)
                for b in range(bands):
                    key = np.full(len(at), b + 1, _U)
                    for k in range(b * rows, b * rows + rows):
                        key = mix(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(x * times[k] + plus[k], at))
                    keys[:, b] = key
            full = np.cumsum(np.concatenate([[0], some])) * bands
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], pa.array(np.diff(bounds).astype(np.int64)), *(pa.array(d.view(np.int64), mask=~some) for d in (low, high)),
                    pa.ListArray.from_arrays(pa.array(full.astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64))), parity(values, bounds),
                ],
                ["doc_id", "n_shingles", "low", "high", "bands", "parity"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, low long, high long, bands array<long>, parity array<long>")


def full_sets(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """All columns of ``docs`` but the text, the whole set of shingle hashes as ``shingles``, and its digest (own_low, own_high)."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in pieces(batches, "text", 1 << 19):
            values, bounds = shingle_sets(words(batch["text"]), n)
            digest = (pa.array(d.view(np.int64)) for d in digests(values, bounds))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), _lists(values.view(np.int64), bounds), *digest], [*rest, "shingles", "own_low", "own_high"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.select(*rest, "text").mapInArrow(run, f"{kinds}, shingles array<long>, own_low long, own_high long")


def similar(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """100 * intersection >= percent * union, on whole sets."""
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def may_be_similar(a: str, b: str, percent: int = PERCENT) -> Column:
    """False only for pairs that are not similar, by the sizes and parity signatures of ``a`` and ``b``."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")

    def folded(mine: str, other: str) -> Column:
        own, half = F.col(f"{mine}.parity"), F.size(F.col(f"{other}.parity"))
        fold = F.zip_with(F.slice(own, 1, half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(own) > half, fold).otherwise(own)

    apart = F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def components(run: Run, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) of all nodes in ``edges`` (a, b), by alternating large-star and small-star."""

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()

    def little(e: DataFrame) -> DataFrame:
        low = least(e)
        return e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()

    edges = run.keep(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        edges = run.keep(little(large(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _sets(run: Run, docs: DataFrame, classes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``wanted`` (cid, any other columns) with the whole set of each class as ``shingles``, made from the texts of its first document."""
    named = small(run.keep(wanted.join(classes, "cid").withColumnRenamed("rep", "doc_id")), 48)
    rest = wanted.columns
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(named, "doc_id").select("text", "low", "high", *rest)
    own = (F.col("low") == F.col("own_low")) & (F.col("high") == F.col("own_high"))  # a document id may stand for several texts
    return full_sets(rows, n).where(own).select(*rest, "shingles")


def _confirmed(run: Run, docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b), a > b, of a stored table whose whole sets are similar. Only the texts of classes in a pair become sets."""
    ids = run.keep(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct())
    sets = _sets(run, docs, classes, ids, n).dropDuplicates(["cid"])
    left, right = (sets.select(F.col("cid").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").where(similar(F.col("set_a"), F.col("set_b"), percent)).select("a", "b")


def _rarest(run: Run, sets: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of each of ``sets`` (cid, part, n, shingles) and their places from 0, so many that two similar sets share one of them; those that no other set has are left out.

    Sets of which at least ``percent`` of the larger is common miss no more shingles than the
    rest: in one order of all shingles, the first n - ceil(percent n / 100) + 1 of either have one in common.
    """
    each = run.keep(sets.select("cid", "part", "n", F.explode("shingles").alias("s")))
    held = each.groupBy("s").agg(F.count("*").alias("sets"))
    first = F.col("n") - F.floor((F.col("n") * percent + 99) / 100).cast("int") + 1
    ranked = each.join(held, "s").groupBy("cid", "part", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "s"))).alias("order"))  # as long as the set
    kept = ranked.select("cid", "part", "n", F.posexplode(F.slice("order", F.lit(1), first)).alias("place", "o"))
    return kept.where("o.sets > 1").select("cid", "part", "n", "place", F.col("o.s").alias("s"))


def _enough(a: str, b: str, percent: int) -> Column:
    """False only for rows (n, place) of a shingle that are not the first common one of two similar sets: so much must be left of either set from there on."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.place"), F.col(f"{b}.n") - F.col(f"{b}.place"))
    return left * (100 + percent) >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _reach(rare: DataFrame, percent: int) -> DataFrame:
    """Rows of ``rare`` (cid, n, place, s) without those for which no other set of the shingle is small enough.

    Similar sets of n and m shingles have percent (n + m) / (100 + percent) in common, all of
    them from their first common one on. In the smaller set that one's place is thus below
    n (100 - percent) / (100 + percent) + 1, and the larger set must reach the smallest such.
    """
    left, n = (F.col("n") - F.col("place")) * (100 + percent), F.col("n") * percent
    least = rare.groupBy("s").agg(F.min(F.when(left >= 2 * n, n)).alias("least"))
    return rare.join(least, "s").where(left >= n + F.col("least")).select("cid", "n", "place", "s")


def _parted(run: Run, reach: DataFrame, labels: DataFrame) -> DataFrame:
    """``reach`` by shingles that still have several components: cid, part, n, place, s, the largest part (main) and the set of it that has the shingle earliest (hub)."""
    rows = reach.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "n", "place", "s", F.coalesce("component", "cid").alias("part"))
    each = rows.groupBy("s", "part").agg(F.count("*").alias("rows"), F.min(F.struct((F.col("place") / F.col("n")).alias("at"), "cid", "n", "place")).alias("hub"))
    main = each.groupBy("s").agg(F.max(F.struct("rows", "part", "hub")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    return run.keep(rows.join(main, "s").select("cid", "part", "n", "place", "s", F.col("main.part").alias("main"), F.col("main.hub").alias("hub")))


def _stars(parted: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a > b: each set outside the main part of a shingle and the hub of that part."""
    rest = parted.where("part != main").select(F.struct("cid", "n", "place").alias("x"), "hub").where(_enough("x", "hub", percent))
    return rest.select(F.greatest("x.cid", "hub.cid").alias("a"), F.least("x.cid", "hub.cid").alias("b")).distinct()


def _meetings(parted: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a > b, of sets of two parts: all similar ones among them. One of the two is always outside the main part."""
    x, y = parted.where("part != main").alias("x"), parted.alias("y")
    once = (F.col("y.part") == F.col("y.main")) | (F.col("x.cid") > F.col("y.cid"))
    met = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.part") != F.col("y.part")) & once & _enough("x", "y", percent))
    return met.select(F.greatest("x.cid", "y.cid").alias("a"), F.least("x.cid", "y.cid").alias("b")).distinct()


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text, any other columns).

    Null and blank texts have an empty set and are linked with nothing. Rows that repeat a
    doc_id are judged by their own texts; a null doc_id is kept, with no component. An
    empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, n, percent)


def _near_duplicates(docs: DataFrame, n: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    run = Run(spark, "minhash")
    sketches = run.keep(sketch(docs, n))
    whole = sketches.where("low IS NOT NULL AND doc_id IS NOT NULL")
    # A class is a set; it has a number of its own, as one document id may stand for several sets.
    classes = run.keep(
        whole.groupBy("low", "high").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("parity").alias("parity"), F.any_value("bands").alias("bands"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    named = classes.select("cid", "rep", "low", "high")
    signed = classes.select("cid", "n", "parity")
    banded = classes.select("cid", F.explode("bands").alias("band"))
    shared = run.keep(banded.groupBy("band").agg(F.min("cid").alias("center"), F.count("*").alias("n")).where("n > 1").drop("n"))
    met = run.keep(banded.join(shared, "band"))

    def promising(pairs: DataFrame) -> DataFrame:
        x, y = signed.alias("x"), signed.alias("y")
        both = pairs.join(x, F.col("a") == F.col("x.cid")).join(y, F.col("b") == F.col("y.cid"))
        return run.keep(both.where(may_be_similar("x", "y", percent)).select("a", "b"))

    # The pairs of the first round form stars: whole sets travel to the center of the star, once each.
    first = promising(met.groupBy(F.col("cid").alias("a")).agg(F.min("center").alias("b")).where("a != b"))
    routes = run.keep(first.select(F.col("a").alias("cid"), "b").unionByName(first.select(F.col("b").alias("cid"), "b").distinct()))
    sets = _sets(run, docs, named, routes, n)
    spokes = sets.where("cid != b").select(F.col("cid").alias("a"), "b", "shingles")
    hubs = sets.where("cid = b").select("b", F.col("shingles").alias("hub")).dropDuplicates(["b"])
    labels = components(run, run.keep(spokes.join(hubs, "b").where(similar(F.col("shingles"), F.col("hub"), percent)).select("a", "b")))

    def joined_up(more: DataFrame) -> DataFrame:
        return components(run, labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    def placed() -> DataFrame:
        return met.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("band", "cid", F.coalesce("component", "cid").alias("part"))

    seeds = range(TRIES)
    parts = placed().groupBy("band", "part").agg(F.count("*").alias("n"), F.array(*[F.min_by("cid", F.xxhash64("cid", F.lit(i))) for i in seeds]).alias("who"))
    main = parts.groupBy("band").agg(F.max(F.struct("n", "part", "who")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    tries = parts.join(main, "band").where("part != main.part").select(F.explode(F.arrays_zip("who", F.col("main.who").alias("other"))).alias("t"))
    tries = tries.select(F.greatest("t.who", "t.other").alias("a"), F.least("t.who", "t.other").alias("b")).distinct()
    labels = joined_up(run.keep(_confirmed(run, docs, named, promising(tries), n, percent)))

    # What the tries did not settle: classes of bands that still hold several components meet by their rarest shingles.
    members = run.keep(placed())
    split = members.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("band")
    unsettled = run.keep(members.join(split, "band").select("cid", "part").distinct().join(signed.select("cid", "n"), "cid"))
    rare = run.keep(_rarest(run, _sets(run, docs, named, unsettled, n).dropDuplicates(["cid"]), percent))
    reach = run.keep(_reach(rare, percent))
    near = promising(_stars(_parted(run, reach, labels), percent))
    labels = joined_up(run.keep(_confirmed(run, docs, named, near, n, percent)))
    pairs = promising(_meetings(_parted(run, reach, labels), percent))
    labels = joined_up(run.keep(_confirmed(run, docs, named, pairs, n, percent))).withColumnRenamed("node", "cid")

    joined = run.keep(named.join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    smallest = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = joined.join(smallest, "component").select("low", "high", "component_id")
    out = sketches.select("doc_id", "n_shingles", "low", "high").join(known, ["low", "high"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def deduplicated(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group; rows that repeat a kept doc_id with the same text stay as they are."""
    kept = Run(docs.sparkSession, "minhash-kept").keep(near_duplicates(docs, n, percent).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct())
    return docs.join(small(kept, 16), docs["doc_id"].cast("long") == F.col("gone"), "left_anti")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT x, y FROM common JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
    WHERE 100 * n_both >= 80 * (len(a.s) + len(b.s) - n_both)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, seen) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT sides.y, reach.seen FROM reach JOIN sides ON sides.x = reach.node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(seen) FROM reach WHERE node = doc_id) AS component_id,
    doc_id = (SELECT min(seen) FROM reach WHERE node = doc_id) AS kept
FROM sets
"""
