"""Spelling variants: words that differ by one inserted, deleted or replaced character, grouped under the commonest form.

Words are laid out as rows of a padded code-point matrix, once from the left and once from
the right. Two blocks of rows are compared as a whole: where the rows differ first gives
their common prefix, from the other side their common suffix, and a prefix and suffix that
together reach the longer length less one leave room for a single edit.

Only words that can be near are laid side by side. A single edit of a word of m characters
falls into one of three ranges of positions, and leaves what lies before and after
that range as it was; so words are sorted by the length, the range and what lies around it,
and blocks are compared along that order. A pair is reported in the range where its
difference begins, so once. Groups of more than a few blocks are sorted anew by single
positions, where the alphabet bounds them, so no group grows with the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.tables import Run, table

LETTERS = r"[a-zÀ-ÿ]"
LENGTH, COUNT, EVERY, TIMES, RANGES = 6, 5, 199, 5, 3
#: Rows of a block, bytes that one comparison of two blocks may take, and rows of a group beyond which it is sorted by single positions.
BLOCK, TILE_BYTES, CROWD = 128, 1 << 22, 1024


def words_of(docs: DataFrame, *, length: int = LENGTH, count: int = COUNT, every: int = EVERY) -> DataFrame:
    """word, n: runs of letters of all texts, A-Z lower-cased, with one character left out where ``every`` divides the crc of id and run."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.col("doc_id").cast("long").cast("string").alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(f"{LETTERS}{{{length},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    found = runs.select(F.when(h % every == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _ranged(words: DataFrame) -> DataFrame:
    """Each word under the keys of all ranges, as the shorter of a pair (m = its length) or as the longer."""
    m = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")
    k = F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1))).alias("k")
    each = words.select("word", "n", m).select("*", k)
    start, stop = (F.floor(F.col("m") * (F.col("k") + i) / RANGES).cast("int") for i in (0, 1))
    each = each.select("word", "n", "m", start.alias("lo"), stop.alias("hi")).where("lo < hi")
    key = _around(F.col("word"), F.col("lo"), F.col("m") - F.col("hi"))
    # A letter put after the last one belongs to the last range.
    return each.select("m", "lo", F.when(F.col("hi") == F.col("m"), F.col("m") + 1).otherwise(F.col("hi")).alias("hi"), key.alias("key"), "word", "n")


def _around(word: Column, before: Column, after: Column) -> Column:
    return F.xxhash64(F.substring(word, F.lit(1), before), F.substring(word, F.length(word) - after + 1, after))


def _positioned(crowds: DataFrame) -> DataFrame:
    """Rows of crowded groups under one key for each position of their range: one family for replaced characters, one for inserted ones."""
    own, longer = F.length("word") == F.col("m"), F.length("word") == F.col("m") + 1
    each = crowds.select("*", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("p")).select("m", F.col("p").alias("lo"), (F.col("p") + 1).alias("hi"), "word", "n")
    replaced = each.where(own & (F.col("lo") < F.col("m"))).withColumn("key", _around(F.col("word"), F.col("lo"), F.col("m") - 1 - F.col("lo")))
    inserted = each.where(own | longer).withColumn("key", F.xxhash64(F.lit("+"), _around(F.col("word"), F.col("lo"), F.col("m") - F.col("lo"))))
    return replaced.unionByName(inserted).select("m", "lo", "hi", "key", "word", "n")


class Block:
    """Some rows in their order, with their words as code points from the left and from the right."""

    def __init__(self, rows: pa.RecordBatch):
        self.rows = rows
        self.m, self.lo, self.hi, self.key = (rows[c].to_numpy() for c in ("m", "lo", "hi", "key"))
        words = rows["word"].to_pylist()
        self.length = np.array([len(w) for w in words])
        self.codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)

    def matrix(self, width: int, right: bool, pad: int) -> np.ndarray:
        out = np.full((len(self.length), width), pad, np.uint32)
        column = np.arange(width)
        out[column >= width - self.length[:, None] if right else column < self.length[:, None]] = self.codes
        return out


def _same(a: np.ndarray, b: np.ndarray, right: bool) -> np.ndarray:
    """For each row of ``a`` and of ``b`` the number of columns, from either side, before the first in which they differ."""
    return (a[:, None, :] != b[None, :, :])[:, :, :: -1 if right else 1].argmax(axis=2)


def near_pairs(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` that share a group and are one edit apart within its range. ``a`` may be ``b``: each pair once."""
    width = int(max(a.length.max(), b.length.max())) + 1  # one column more, where the pads differ
    prefix, suffix = (_same(a.matrix(width, right, 0x110000), b.matrix(width, right, 0x110001), right) for right in (False, True))
    together = np.ones(prefix.shape, bool)
    for x, y in ((a.m, b.m), (a.lo, b.lo), (a.key, b.key), (a.hi, b.hi)):
        together &= x[:, None] == y[None, :]
    longer = np.maximum(a.length[:, None], b.length[None, :])
    shorter = np.minimum(a.length[:, None], b.length[None, :])
    hit = together & (shorter == a.m[:, None]) & (longer - shorter <= 1) & (prefix + suffix >= longer - 1) & (prefix >= a.lo[:, None]) & (prefix < a.hi[:, None])
    if a is b:
        hit = np.triu(hit, 1)
    return np.nonzero(hit)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare blocks of sorted rows with themselves and with the blocks before them that share their first group."""
    open_blocks: list[Block] = []
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            longest = int(batch["m"][at : at + BLOCK].to_numpy().max()) + 2
            size = min(BLOCK, max(2, int((TILE_BYTES / longest) ** 0.5)))
            block = Block(batch.slice(at, size))
            at += size
            group = lambda x, i: (x.m[i], x.lo[i], x.hi[i], x.key[i])
            open_blocks = [x for x in open_blocks if group(x, -1) == group(block, 0)] + [block]
            for other in open_blocks:
                i, j = near_pairs(other, block)
                if len(i):
                    left, right = other.rows.take(pa.array(i)), block.rows.take(pa.array(j))
                    yield pa.RecordBatch.from_arrays([left["word"], left["n"], right["word"], right["n"]], ["a", "n_a", "b", "n_b"])


def pairs_of(run: Run, words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each two near words of ``words`` (word, n), a stored table of distinct words, once."""
    group = ["m", "lo", "hi", "key"]
    ranged = _ranged(words)
    sizes = run.keep(ranged.groupBy(*group).agg(F.count("*").alias("size")).where("size > 1"))
    together = ranged.join(sizes, group)
    rows = together.where(F.col("size") <= CROWD).drop("size").unionByName(_positioned(together.where(F.col("size") > CROWD)))
    return run.keep(rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(_tiles, "a string, n_a long, b string, n_b long"))


def spelling_variants(docs: DataFrame, *, length: int = LENGTH, count: int = COUNT, every: int = EVERY, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of ``docs`` (doc_id, text, any other columns).

    A word has ``length`` characters and ``count`` occurrences at least. Its form is its near
    word of largest n, the first in code-point order of equal ones, if that is ``times`` its
    own n; its root ends the chain of forms. Null and empty texts have no words, rows that
    repeat are counted as often, in rows with a null id no character is left out, and an
    empty table gives an empty result. Words of any length are compared as a whole.
    """
    run = Run(docs.sparkSession, "spelling")
    words = run.keep(words_of(docs, length=length, count=count, every=every))
    pairs = pairs_of(run, words)
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    sides = sides.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    formed = -F.col("best.less") >= F.col("n") * times
    named = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")
    )
    named = run.keep(named)

    # Forms are commoner than their words, so chains end; each round doubles the steps taken.
    steps = run.keep(named.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = run.keep(steps.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        steps = further.drop("moved")
        if further.where("moved").isEmpty():
            break
    return named.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE steps AS (
    SELECT list(list_reduce(range(1, 9), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (
    SELECT *, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END
        FOR c IN string_split(doc_id || ':' || run, '')]) AS b FROM counted),
hashed AS (
    SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x::BIGINT) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, steps),
cut AS (
    SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
-- levenshtein counts bytes, so each letter beyond ASCII stands as another ASCII sign
plain AS MATERIALIZED (
    SELECT *, length(word) AS l, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ',
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_`{|}~ ') AS w FROM words),
sides AS (SELECT a.word, b.word AS near, b.n FROM plain a JOIN plain b ON b.l BETWEEN a.l - 1 AND a.l + 1 AND levenshtein(a.w, b.w) = 1),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM sides GROUP BY word),
named AS MATERIALIZED (
    SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
    FROM words w LEFT JOIN best USING (word)),
chain(word, root) AS (
    SELECT word, word FROM named
    UNION ALL
    SELECT chain.word, form FROM chain JOIN named ON named.word = chain.root WHERE form IS NOT NULL)
SELECT n1.*, root FROM named n1 JOIN chain USING (word) JOIN named n2 ON n2.word = root AND n2.form IS NULL
"""
