"""Toxicity by a counterfactual-regularised linear classifier.

Features are the distinct words of a text and their first four and five bytes. Words that
separate the labels are chosen on a bounded sample of labelled rows, and a logistic model
is fitted on them. Next to the usual loss it pays for every change of score that swapping
one identity term for another, or merely mentioning one, would cause in a labelled text.
So a group's name carries (almost) no weight of its own, even where the labels tie it to
toxic texts. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from meterline.llm.tables import Run, table
from meterline.llm.text_arrays import Words, pieces, plain_words, vacate

#: At most so many labelled rows of each label are fitted on, those with the least hash of their id.
SAMPLE_PER_LABEL = 5000
MAX_FEATURES = 20000
#: Terms of a line can stand for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "european", "latino"),
    ("gay", "lesbian", "straight", "bisexual"),
    ("young", "old", "disabled", "deaf", "blind"),
)
_U = np.uint64


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id's text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_label: int, seed: int = 9) -> DataFrame:
    """text and y of a bounded sample of rows that may be learned from; of contradicting labels the larger holds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id", F.lit(seed))
    some = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_label) for y in (0, 1)]
    # At most 2 * per_label rows of 12 bytes, whatever the input.
    chosen = F.broadcast(some[0].unionByName(some[1]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("text", "y")


def features(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Owner text and hash of each word and of its first four and five bytes."""
    size, owner = found.ends - found.starts, found.text_of
    out, who = [found.hashes(lower=True)], [owner]
    for n in (4, 5):
        long = size > n
        cut = Words(found.data, found.offsets, found.starts[long], found.starts[long] + n, found.first)
        out.append(cut.hashes(lower=True) ^ _U(n))
        who.append(owner[long])
    return np.concatenate(who), np.concatenate(out)


def term_features(term: str) -> list[int]:
    return [int(h) for h in features(plain_words(pa.array([term], pa.large_string())))[1]]


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        found = plain_words(column)
        n, total = len(column), np.zeros(len(column))
        if len(self.hashes) and len(found.starts):
            sieve = np.zeros(1 << 20, bool)
            sieve[self.hashes >> _U(44)] = True
            owner, hashes = features(found)
            near = sieve[hashes >> _U(44)]
            owner, hashes = owner[near], hashes[near]
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            pairs = np.unique(owner[hit] * len(self.hashes) + at[hit])
            total = np.bincount(pairs // len(self.hashes), self.weights[pairs % len(self.hashes)], n)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -50, 50)))


Change = tuple[list[int], list[int], float]  # features that come, features that go, share of labelled texts it can happen to


def fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, changes: list[Change], width: int, *, fairness: float = 5.0, ridge: float = 5e-4, steps: int = 800, positive: float = 0.2) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic loss plus ridge plus ``fairness`` times the squared score changes.

    ``rows`` and ``cols``: the features of each text, paired. ``positive`` is the weight of
    all toxic texts together, near their share in a corpus, so that 0.5 is a cautious limit.
    Accelerated gradient steps on data of bounded size.
    """
    n = len(y)
    balance = np.where(y == 1, positive / max(1, y.sum()), (1 - positive) / max(1, n - y.sum()))
    at = np.array([f for come, go, _ in changes for f in (*come, *go)], int)
    sign = np.array([s for come, go, _ in changes for s in (*[1.0] * len(come), *[-1.0] * len(go))])
    which = np.repeat(np.arange(len(changes)), [len(come) + len(go) for come, go, _ in changes])
    share = np.array([s for _, _, s in changes])
    w, bias = np.zeros(width), 0.0
    v, v_bias = w.copy(), bias
    reach = np.bincount(rows, minlength=n).max(initial=1) + 1
    rate = 1 / (0.125 * min(reach, 60) + ridge + 2 * fairness * (share[which].sum() if len(which) else 0.0))
    for step in range(steps):
        z = np.bincount(rows, v[cols], n) + v_bias
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * balance
        grad = np.bincount(cols, error[rows], width) + ridge * v
        if len(which):
            moved = np.bincount(which, sign * v[at], len(changes))
            grad += np.bincount(at, 2 * fairness * (share * moved)[which] * sign, width)
        new, new_bias = v - rate * grad, v_bias - rate * error.sum()
        pace = step / (step + 3)
        v, v_bias = new + pace * (new - w), new_bias + pace * (new_bias - bias)
        w, bias = new, new_bias
    return w, float(bias)


def train(sample: DataFrame, *, fairness: float = 5.0, max_features: int = MAX_FEATURES, terms: tuple = IDENTITY_TERMS) -> Model:
    """A model of a bounded sample (text, y). Without rows of both labels it gives every text the same score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            owner, hashes = features(plain_words(batch["text"]))
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
            bounds = np.searchsorted(owner[new], np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["y"], lists], ["y", "hashes"])

    sample = Run(sample.sparkSession, "labelled").keep(sample)
    seen = sample.mapInArrow(run, "y int, hashes array<long>")
    # Counting stays in Spark; the driver gets the chosen features and their places only.
    one = seen.select("y", F.explode("hashes").alias("h")).groupBy("h").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    size = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad")).first()
    n, n_bad = int(size["n"]), int(size["bad"])
    if not n or n_bad in (0, n):
        return Model(np.empty(0, _U), np.empty(0), float(np.log((n_bad + 0.5) / (n - n_bad + 0.5))) if n else 0.0)
    groups = [[term_features(t) for t in line] for line in terms]
    named = sorted({h - (1 << 64) if h >= 1 << 63 else h for line in groups for term in line for h in term})
    odds = F.log((F.col("bad") + 0.5) / F.lit(n_bad + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(n - n_bad + 1.0))
    gap = F.abs(odds) / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    chosen = one.withColumn("gap", F.when(F.col("h").isin(named), 1e9).otherwise(gap)).where("gap >= 3 AND bad + good >= 4").orderBy(F.desc("gap"), "h").limit(max_features)
    hashes = np.sort(np.array([r["h"] for r in chosen.select("h").collect()], np.int64).view(_U))
    if not len(hashes):
        return Model(hashes, np.empty(0), float(np.log(n_bad / (n - n_bad))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            owner, own = features(plain_words(batch["text"]))
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            hit = hashes[at] == own
            pairs = np.unique(owner[hit] * len(hashes) + at[hit])
            bounds = np.searchsorted(pairs // len(hashes), np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch["y"], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((pairs % len(hashes)).astype(np.int32)))], ["y", "cols"])

    got = sample.mapInArrow(pick, "y int, cols array<int>").toArrow().combine_chunks()
    lists = got["cols"].combine_chunks() if isinstance(got["cols"], pa.ChunkedArray) else got["cols"]
    counts = np.array([len(x) for x in lists])
    cols, y = lists.flatten().to_numpy().astype(int), got["y"].to_numpy().astype(float)
    rows = np.repeat(np.arange(len(y)), counts)

    place = {int(h): i for i, h in enumerate(hashes)}
    often = np.bincount(cols, minlength=len(hashes)) / len(y)
    changes: list[Change] = []
    for line in groups:
        known = [[place[h] for h in term if h in place] for term in line]
        known = [(own, max(often[own].min(), 1 / len(y))) for own in known if own]
        changes += [(own, [], share) for own, share in known]
        changes += [([f for f in a if f not in b], [f for f in b if f not in a], share) for a, share in known for b, _ in known if a != b]
    weights, bias = fit(rows, cols, y, changes, len(hashes), fairness=fairness)
    return Model(hashes, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``score``; a null or empty text scores as one without known words."""
    kind = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in batches:
            done = 0
            for part in pieces(iter([batch]), "text"):  # null texts are empty there, and stay null in what is sent back
                yield batch.slice(done, part.num_rows).append_column("score", pa.array(model.scores(part["text"])))
                done += part.num_rows

    return docs.mapInArrow(run, kind)


def toxicity(docs: DataFrame, labels: DataFrame, *, per_label: int = SAMPLE_PER_LABEL, threshold: float = 0.5, fairness: float = 5.0) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; rows with a null id are scored and never held out."""
    model = train(labelled(docs, labels, "toxic", per_label), fairness=fairness)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    model = train(labelled(docs, labels, "toxic", SAMPLE_PER_LABEL))
    return score(docs.drop("score"), model).where(F.col("score") < threshold).select(*docs.columns)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
