"""Benchmark passages in documents, also with numbers, names and units exchanged.

Texts become templates: numbers, units after numbers, and capitalised words within a
sentence turn into typed placeholders, everything else is lower-cased and loses its
punctuation. Windows of template tokens are joined by hash. A document holds an item where
enough of the item's windows appear on one diagonal. Then the slots are compared: each
value of the item must have become one and the same value of the document throughout, as
in a re-parameterised question. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.llm.tables import Run, small, table

WINDOW = 8
#: A document holds an item with this share of its windows, or with so many of them.
SHARE, RUN = 0.5, 6
UNITS = "%|km|m|cm|mm|kg|g|mg|t|l|ml|s|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|inch(?:es)?|pounds?|euros?|dollars?|cents?|degrees?|percent"


def plain(text: Column) -> Column:
    """The text with single spaces and without the placeholder sign, so that templates and plain tokens stay aligned; null is empty."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "§", " "), r"[\s\p{Z}]+", " ")


def template(text: Column) -> Column:
    """Tokens with numbers as §d, units as §u and capitalised words as §n; one for one with ``tokens``.

    What goes on with a number or a run of capitalised words is §e, and a unit without a
    space belongs to its number. The first word of a
    sentence may be a name and is a slot too; one that is none keeps its value.
    """
    # What each match starts with is asked for first: a lookbehind at every character is what takes the time.
    named = F.regexp_replace(text, r"(?=\p{Lu})(?<![\p{L}\p{M}\p{N}])\p{Lu}[\p{L}\p{M}]*", "§n")
    counted = F.regexp_replace(named, r"\p{N}+", "§d")
    typed = F.regexp_replace(counted, rf"(§d ?)(?:{UNITS})(?![\p{{L}}\p{{N}}])", "$1§u")
    folded = F.regexp_replace(typed, r"(?=§)(?:(?<=§n[ '’-])§n|(?<=§d[.,])§d)", "§e")
    return tokens(F.regexp_replace(folded, r"(?=§)(?<=§[de])§u", ""))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}§%]+"), lambda t: t != "")


def parsed(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, raw (plain tokens), places (kind: each template token, at: where it starts in raw)."""
    both = texts.select(*keys, tokens(F.col("text")).alias("raw"), template(F.col("text")).alias("kinds"))
    places = F.filter(F.transform("kinds", lambda t, i: F.struct(t.alias("kind"), i.alias("at"))), lambda s: ~s["kind"].startswith("§e"))
    return both.select(*keys, "raw", places.alias("places"))


def steps(parts: Column, n: int) -> Column:
    """The starts of all runs of n tokens, from 1; none where there are fewer."""
    return F.when(F.size(parts) >= n, F.sequence(F.lit(1), F.size(parts) - n + 1)).otherwise(F.array().cast("array<int>"))


def hashed(parts: Column) -> Column:
    """The hash of each token; a window's is ``run_hash`` of those of its tokens."""
    return F.transform(parts, lambda t: F.xxhash64(t))


def run_hash(own: list[Column]) -> Column:
    """The hash of a run of tokens from the hashes of its tokens; null where the last is missing."""
    return F.when(own[-1].isNotNull(), F.xxhash64(*own))


def windows_at(hashes: Column, start: Column, n: int) -> Column:
    """The hash of the n tokens from ``start``, counted from 0."""
    return run_hash([F.get(hashes, start + k) for k in range(n)])


def document_windows(texts: DataFrame, n: int, lengths: list[int]) -> DataFrame:
    """doc_id, copy, kind (0: n template tokens, otherwise so many plain ones), place, doc_part, h of all windows of the documents.

    Lists moved by 0 to n - 1 places, side by side, hold a window in each row; what is
    done with a row is then compiled, which a function over array elements is not.
    """
    marked = texts.select("doc_id", "copy", hashed(F.col("raw")).alias("raw"), F.col("places.at").alias("at"), hashed(F.col("places.kind")).alias("kinds"))

    def moved(name: str) -> list[Column]:
        return [F.slice(name, k + 1, F.size(name)).alias(f"{name}_{k}") if k else F.col(name).alias(f"{name}_0") for k in range(n)]

    side = marked.select("doc_id", "copy", "at", *moved("raw"), *moved("kinds"))
    names = [f"{name}_{k}" for name in ("raw", "kinds") for k in range(n)]
    rows = side.select("doc_id", "copy", F.posexplode(F.arrays_zip("at", *names)).alias("i", "w")).select("doc_id", "copy", "i", "w.*")

    def window(kind: int, place: str, part: Column, name: str, length: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(place).alias("place"), part.alias("doc_part"), run_hash([F.col(f"{name}_{k}") for k in range(length)]).alias("h"))

    each = [window(0, "at", F.col("i"), "kinds", n), *(window(m, "i", F.lit(-1), "raw", m) for m in lengths)]
    return rows.select("doc_id", "copy", F.inline(F.array(*each)))


def item_windows(items: DataFrame, n: int) -> DataFrame:
    """item_id, n_windows, kind (0: template, otherwise the plain length), at, part, h.

    Windows of mostly placeholders say too little and are left out. An item without any
    other has n_windows 0 and its first plain tokens, n at most: it must be met whole.
    """
    items = items.withColumn("own", hashed(F.col("raw"))).withColumn("typed", hashed(F.col("parts")))
    spread = items.select("item_id", "own", "typed", "parts", "starts", F.explode(steps(F.col("parts"), n)).alias("i"))
    solid = spread.where(F.size(F.filter(F.slice("parts", F.col("i"), n), lambda t: ~t.startswith("§"))) * 2 >= n).withColumn("at", F.get("starts", F.col("i") - 1))
    form = F.struct(F.lit(0).alias("kind"), F.col("at").alias("at"), (F.col("i") - 1).alias("part"), windows_at(F.col("typed"), F.col("i") - 1, n).alias("h"))
    same = F.struct(F.lit(n).alias("kind"), F.col("at").alias("at"), F.lit(-1).alias("part"), windows_at(F.col("own"), F.col("at"), n).alias("h"))
    count = solid.groupBy("item_id").agg(F.count("*").alias("n_windows"))
    some = solid.select("item_id", F.explode(F.array(form, same)).alias("w")).join(count, "item_id").select("item_id", "n_windows", "w.*")
    size = F.least(F.size("raw"), F.lit(n))
    start = F.coalesce(*(windows_at(F.col("own"), F.lit(0), m) for m in range(n, 0, -1)))
    whole = items.where(F.size("raw") > 0).join(count, "item_id", "left_anti").select("item_id", F.lit(0).cast("long").alias("n_windows"), size.alias("kind"), F.lit(0).alias("at"), F.lit(-1).alias("part"), start.alias("h"))
    return some.unionByName(whole)


def slot_pairs(n: int) -> Column:
    """kind, own, theirs: the values of the item and of the document in the windows of ``hs``; plain windows hold the item's own."""

    def value(raw: str, starts: str, j: Column) -> Column:
        stop = F.coalesce(F.get(starts, j + 1), F.size(raw))
        return F.regexp_replace(F.concat_ws(" ", F.slice(raw, F.get(starts, j) + 1, stop - F.get(starts, j))), r"(?<=\p{N}) (?=\p{N}{3}(?!\p{N}))", "")

    def pair(j: Column, theirs: Column) -> Column:
        return F.struct(F.get("parts", j).alias("kind"), value("raw", "starts", j).alias("own"), theirs.alias("theirs"))

    def slot(j: Column) -> Column:
        return F.get("parts", j).startswith("§")

    span = F.when(F.col("n_windows") > 0, n).otherwise(F.size("raw"))

    def pairs(h: Column) -> Column:
        inside = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda j: slot(j) & (F.get("starts", j) >= h["at"]) & (F.coalesce(F.get("starts", j + 1), F.size("raw")) <= h["at"] + span))
        held = F.filter(F.sequence(h["part"], h["part"] + n - 1), slot)
        changed = F.transform(held, lambda j: pair(j, value("doc_raw", "doc_starts", h["doc_part"] + j - h["part"])))
        return F.when(h["kind"] == 0, changed).otherwise(F.transform(inside, lambda j: pair(j, value("raw", "starts", j))))

    return F.array_distinct(F.flatten(F.transform("hs", pairs)))


def find_leaks(docs: DataFrame, items: DataFrame, *, n: int = WINDOW, share: float = SHARE, run_length: int = RUN) -> DataFrame:
    """A row for each document and item it holds: doc_id, item_id, n_hits, coverage, n_slots, n_changed.

    ``docs`` (doc_id, text), ``items`` (item_id, text), with any other columns. n_hits: the
    item's windows found on the best diagonals with steady slots, as templates or as plain
    tokens; coverage: their share; n_slots: values in the matched windows; n_changed: how many differ. Case and
    white space do not count. An item of fewer than n tokens, or of placeholders mostly, is
    held where all its plain tokens stand in a row, and has one window. Null or empty texts
    hold nothing and are held by none. Null ids take no part; repeated rows and items do
    not add up.
    """
    run = Run(docs.sparkSession, "leaks")
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), plain(F.col("text")).alias("text")).withColumn("copy", F.xxhash64("text"))
    items = items.where("item_id IS NOT NULL").select("item_id", plain(F.col("text")).alias("text")).dropDuplicates(["item_id"])
    items = run.keep(parsed(items, "item_id").select("item_id", "raw", "places", F.col("places.kind").alias("parts"), F.col("places.at").alias("starts")))
    wanted = run.keep(item_windows(items, n))
    short = sorted(r["kind"] for r in wanted.where(F.col("kind").between(1, n - 1)).select("kind").distinct().collect())  # n - 1 at most
    seen = document_windows(parsed(docs, "doc_id", "copy"), n, [*short, n])
    met = seen.join(small(wanted, 48), ["kind", "h"]).select("doc_id", "copy", "item_id", "n_windows", F.struct("kind", "at", "part", "place", "doc_part").alias("hit"))

    def enough(hits: DataFrame) -> DataFrame:
        counted = hits.withColumn("n_hits", F.size(F.array_distinct(F.col("hs.at"))))
        return counted.where((F.col("n_hits") >= share * F.col("n_windows")) | (F.col("n_hits") >= run_length))

    # Rows that share an id with different texts are told apart by their text.
    pair = ["doc_id", "copy", "item_id", "n_windows"]
    near = run.keep(enough(met.groupBy(*pair).agg(F.collect_set("hit").alias("hs"))).drop("n_hits"))
    hits = near.select(*pair, F.explode("hs").alias("hit"))
    lines = hits.groupBy(*pair, (F.col("hit.place") - F.col("hit.at")).alias("shift")).agg(F.collect_list("hit").alias("hs"))
    # Where values or insertions move the rest of a copy, diagonals next to each other are one; a copy that is steady only in part is not.
    before = F.lag("shift").over(Window.partitionBy(*pair).orderBy("shift"))
    runs = lines.withColumn("gap", (F.col("shift") - before > n // 2).cast("int")).withColumn("run", F.sum(F.coalesce("gap", F.lit(0))).over(Window.partitionBy(*pair).orderBy("shift")))
    merged = runs.groupBy(*pair, "run").agg(F.min("shift").alias("shift"), F.flatten(F.collect_list("hs")).alias("hs"))
    level = hits.where("hit.kind = 0").groupBy(*pair, (F.col("hit.doc_part") - F.col("hit.part")).alias("shift")).agg(F.collect_list("hit").alias("hs"))
    able = run.keep(enough(level.unionByName(merged.select(*level.columns))).select(*pair, "n_hits", F.array_sort(F.array_distinct("hs")).alias("hs")).distinct())

    # Slots of the matched windows; only documents with a hit are read again.
    places = run.keep(able.select("doc_id", "copy").distinct())
    doc_parts = parsed(docs.join(small(places, 16), ["doc_id", "copy"]).dropDuplicates(["doc_id", "copy"]), "doc_id", "copy")
    doc_parts = doc_parts.select("doc_id", "copy", F.col("raw").alias("doc_raw"), F.col("places.at").alias("doc_starts"))
    paired = able.join(items, "item_id").join(doc_parts, ["doc_id", "copy"])
    equal = F.exists("hs", lambda h: F.slice("doc_raw", h["place"] + 1, F.size("raw")) == F.col("raw"))
    paired = paired.where((F.col("n_windows") > 0) | equal).select(*pair, "n_hits", slot_pairs(n).alias("slots"))
    values = F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["own"])))
    changed = F.size(F.filter("slots", lambda s: ~s["own"].eqNullSafe(s["theirs"]))).cast("long")
    steady = paired.where(F.size("slots") == F.size(values)).select("doc_id", "item_id", "n_windows", F.col("n_hits").cast("long").alias("n_hits"), F.size("slots").cast("long").alias("n_slots"), changed.alias("n_changed"))
    best = steady.groupBy("doc_id", "item_id", "n_windows").agg(F.max(F.struct("n_hits", (-F.col("n_changed")).alias("kept"), "n_slots")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_hits", (F.col("b.n_hits") / F.greatest("n_windows", F.lit(1))).alias("coverage"), "b.n_slots", (-F.col("b.kept")).alias("n_changed"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    found = Run(docs.sparkSession, "leaked").keep(find_leaks(docs, items).select(F.col("doc_id").alias("gone")).distinct())
    return docs.join(small(found, 8), docs["doc_id"].cast("long") == F.col("gone"), "left_anti")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
