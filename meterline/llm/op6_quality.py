"""Quality by a sparse ensemble of rules over text statistics.

Shallow trees are grown by Spark ML on statistics of the labelled rows. Every path from a
root to a node is a conjunctive rule. A lasso logistic regression weighs the rules, most of
which drop out, and what is left becomes one Spark column expression over the statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.tables import Run, table
from meterline.llm.text_arrays import pieces, words

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "letters", "upper", "digits", "symbols", "stops", "bangs", "bars", "other", "lines",
    "distinct", "repeats", "long_words", "plain_ends",
)
_CLASS = {
    "upper": range(65, 91), "digits": range(48, 58), "symbols": b"#$%&*+<=>@[]^_{}~\\", "stops": b".,;:?", "bangs": b"!", "bars": b"|",
    "lines": b"\n",
}
Condition = tuple[int, bool, float]  # statistic, True for <=, threshold


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text; a null or empty text has zeros."""
    tables = {}
    for name, members in _CLASS.items():
        tables[name] = np.zeros(256, np.uint8)
        tables[name][list(members)] = 1
    letters = np.zeros(256, np.uint8)
    letters[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    tables["letters"] = letters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = words(batch["text"])
            size, count, n = np.diff(found.offsets), found.counts, batch.num_rows
            some, many = np.maximum(size, 1), np.maximum(count, 1)
            out = {"log_bytes": np.log1p(size), "log_words": np.log1p(count)}

            def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])

            for name, marks in tables.items():
                out[name] = per_text(marks[found.data], found.offsets) / some
            out["other"] = 1 - out["letters"] - out["digits"] - out["stops"]
            length, owner, hashes = found.ends - found.starts, found.text_of, found.hashes()
            out["word_bytes"] = per_text(length, found.first) / many
            out["long_words"] = per_text(length > 14, found.first) / many
            out["plain_ends"] = per_text(tables["letters"][found.data[found.ends - 1]] if len(length) else length, found.first) / many
            again = np.zeros(len(hashes), bool)
            again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
            out["repeats"] = per_text(again, found.first) / many
            order = np.lexsort((hashes, owner))
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[1:] != owner[:-1])
            out["distinct"] = np.bincount(owner[order][new], minlength=n) / many
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(out[s].astype(float)) for s in STATISTICS)], ["doc_id", *STATISTICS])

    kinds = ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {kinds}")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id's text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


@dataclass
class Rules:
    rules: list[tuple[Condition, ...]]
    weights: list[float]
    bias: float

    def score(self) -> Column:
        """The probability of label 1 as an expression over the statistics."""
        total = reduce(lambda s, r: s + F.when(rule_column(r[0]), F.lit(r[1])).otherwise(F.lit(0.0)), zip(self.rules, self.weights), F.lit(self.bias))
        return 1 / (1 + F.exp(-total))


def rule_column(rule: tuple[Condition, ...]) -> Column:
    parts = [F.col(STATISTICS[s]) <= t if low else F.col(STATISTICS[s]) > t for s, low, t in rule]
    return reduce(lambda a, b: a & b, parts)


def tightened(path: list[Condition]) -> tuple[Condition, ...]:
    """The path with one bound a side for each statistic."""
    bounds: dict[tuple[int, bool], float] = {}
    for s, low, t in path:
        old = bounds.get((s, low), t)
        bounds[s, low] = min(old, t) if low else max(old, t)
    return tuple((s, low, t) for (s, low), t in sorted(bounds.items()))


def tree_rules(node, path: list[Condition]) -> Iterator[tuple[Condition, ...]]:
    """The rule of every node below the root of a Spark ML tree."""
    if path:
        yield tightened(path)
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        s, t = split.featureIndex(), split.threshold()
        yield from tree_rules(node.leftChild(), [*path, (s, True, t)])
        yield from tree_rules(node.rightChild(), [*path, (s, False, t)])


def fit(rows: DataFrame, *, trees: int = 20, depth: int = 3, penalty: float = 5e-4, seed: int = 6) -> Rules:
    """Rules learned from all ``rows`` (statistics and y). Without rows of both labels every text scores the same."""
    counts = {int(r["y"]): r["count"] for r in rows.groupBy("y").count().collect()}
    bad, good = counts.get(0, 0), counts.get(1, 0)
    if not bad or not good:
        return Rules([], [], math.log((good + 0.5) / (bad + 0.5)))
    data = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(rows).select("x", F.col("y").cast("double").alias("y"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.5", subsamplingRate=0.7, seed=seed).fit(data)
    rules = list(dict.fromkeys(rule for tree in forest.trees for rule in tree_rules(tree._call_java("rootNode"), [])))
    if not rules:
        return Rules([], [], math.log(good / bad))
    marks = rows.select(*(rule_column(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)), F.col("y").cast("double").alias("y"))
    marks = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(marks).select("x", "y")
    lasso = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(marks)
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if abs(w) > 1e-9]
    return Rules([r for r, _ in kept], [w for _, w in kept], float(lasso.intercept))


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text, any other columns).

    Null and empty texts score by their zero statistics. Null ids are scored, never held
    out and never learned from; of contradicting labels the larger holds.
    """
    run = Run(docs.sparkSession, "quality")
    measured = run.keep(statistics(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = run.keep(measured.join(known, "doc_id").select(*STATISTICS, "y"))
    model = fit(rows)
    return measured.select("doc_id", held_out().alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
