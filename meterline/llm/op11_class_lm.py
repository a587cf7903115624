"""Language-model scores by Brown classes: transition of classes, emission of words.

1. One pass counts every word of all texts. The commonest words are listed: a bounded
   table that every task gets. All other words are looked up by joins.
2. What is put in classes is a unit: each of the most listed words is one of its own, the
   rest share units by their last bytes, so a word never seen in training has a class too.
   A second pass counts pairs of neighbouring units.
3. Exchange clustering: for each unit the class counts to its left and right are summed, the
   unit is taken out of its class, and the gain in likelihood of every class is computed
   exactly with the others held; it goes where the gain is largest. In a round half of the
   units may move, all at once on all executors; between rounds only the class of each unit
   and the matrix of class pairs pass through the driver. The best round counts.
4. A text's probability is the product of P(class | class before) and P(word | class) over
   its words and one end. Transitions are interpolated with class frequencies, emissions are
   discounted, and what that leaves is the probability of an unknown word of the class, so
   for each history the probabilities sum to one.

Words are told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.llm.tables import Run, table
from meterline.llm.text_arrays import Words, mix, pieces, words

#: Classes of words (one more holds the end), rounds of exchange, units of one word and of shared endings, words listed for all tasks.
CLASSES, ROUNDS, SINGLE, ENDINGS, LISTED = 64, 8, 1 << 14, 1 << 11, 1 << 18
#: Taken off each word's count in its class; weight of the class frequencies in a transition.
DISCOUNT, PRIOR = 0.5, 32.0
#: Entries a task holds before it passes them on; units that are exchanged in one group.
HELD, GROUP = 1 << 20, 256
_U = np.uint64


class Tally:
    """Sums for each key, passed on when there are many of them."""

    def __init__(self, held: int = HELD):
        self.held, self.size, self.parts = held, 0, []

    def add(self, keys: np.ndarray, *sums: np.ndarray) -> Iterator[list[np.ndarray]]:
        self.parts.append(self._merged([[keys, *sums]]))
        self.size += len(self.parts[-1][0])
        if self.size > self.held:
            self.parts = [self._merged(self.parts)]
            self.size = len(self.parts[0][0])
            if self.size > self.held // 2:
                yield from self.rest()

    def rest(self) -> Iterator[list[np.ndarray]]:
        if self.parts:
            yield self._merged(self.parts)
        self.size, self.parts = 0, []

    @staticmethod
    def _merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        keys, *sums = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
        return [keys[at], *(np.add.reduceat(s[order], at) if len(at) else s for s in sums)]


def endings(found: Words) -> np.ndarray:
    """For each word a number below ``ENDINGS`` by its last three bytes, digits being alike, and whether it has more."""
    fold = np.arange(256, dtype=_U)
    fold[65:91] += _U(32)
    fold[48:58] = 48
    length = found.ends - found.starts
    key = np.minimum(length, 4).astype(_U)
    for back in (1, 2, 3):
        byte = fold[found.data[np.maximum(found.ends - back, 0)]]
        key = key * _U(256) + np.where(length >= back, byte, _U(0))
    return (mix(key + _U(1)) % _U(ENDINGS)).astype(np.int64)


@dataclass
class Listed:
    """The listed words by hash: count in training and unit. Bounded by ``LISTED``."""

    hashes: np.ndarray  # sorted
    counts: np.ndarray
    units: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, single: int) -> Listed:
        h, n, unit, total = (rows[c].to_numpy() for c in ("hash", "n", "ending", "n_all"))
        rank = np.lexsort((h, -total, -n))
        units = unit.astype(np.int64) + single
        own = rank[:single]
        own = own[n[own] > 0]
        units[own] = np.arange(len(own))
        order = np.argsort(h)
        return cls(h[order], n[order], units[order])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is, and whether it is."""
        if not len(self.hashes):
            return np.zeros(len(hashes), int), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


@dataclass
class Units:
    """Words as units: each listed one its own or its ending's, others that of their ending; the end is the last unit."""

    listed: Listed
    single: int

    @property
    def end(self) -> int:
        return self.single + ENDINGS

    def sequence(self, found: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Units of all texts one after another, each closed by an end, then the place of each word in them, and where it is listed."""
        at, known = self.listed.find(hashes)
        own = np.where(known, self.listed.units[at] if len(self.listed.units) else 0, endings(found) + self.single)
        place = np.arange(len(own)) + found.text_of
        out = np.full(len(own) + len(found.counts), self.end)
        out[place] = own
        return out, place, at, known


def _hashes(found: Words) -> np.ndarray:
    return found.hashes(lower=True).view(np.int64)


def vocabulary(docs: DataFrame) -> DataFrame:
    """hash, ending, n (in training texts), n_all of every word in ``docs`` (text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def out(keys, ones, n, n_all, kind):
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(kind // ones), pa.array(n), pa.array(n_all)], ["hash", "ending", "n", "n_all"])

        for batch in pieces(batches, "text"):
            found = words(batch["text"])
            train = (~batch["held_out"].to_numpy(zero_copy_only=False)).astype(np.int64)[found.text_of]
            ones = np.ones(len(train), np.int64)
            for done in tally.add(_hashes(found), ones, train, ones, endings(found)):
                yield out(*done)
        for done in tally.rest():
            yield out(*done)

    rows = docs.select("text", "held_out").mapInArrow(run, "hash long, ending long, n long, n_all long")
    return rows.groupBy("hash").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


PACKED = "part long, side int, own binary, other binary, n binary"


def packed(before: np.ndarray, after: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Counts of unit pairs, seen from either unit: a row for each ``GROUP`` of units and side (0: what follows, 1: what precedes).

    A row holds arrays of bytes: place of the unit in its group, the other unit, the count
    (of one task, which reads far fewer than 2**32 words).
    """
    rows = []
    for side, (own, other) in enumerate(((before, after), (after, before))):
        order = np.argsort(own, kind="stable")
        own, other, count = own[order], other[order].astype(np.uint32), n[order].astype(np.uint32)
        at = np.flatnonzero(np.concatenate([[True], own[1:] // GROUP != own[:-1] // GROUP])) if len(own) else []
        for i, j in zip(at, [*at[1:], len(own)]):
            rows.append((int(own[i]) // GROUP, side, (own[i:j] % GROUP).astype(np.uint8).tobytes(), other[i:j].tobytes(), count[i:j].tobytes()))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["part", "side", "own", "other", "n"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """part, side, place in the part, other unit and count of each packed row."""
    for b in batches:
        for part, side, own, other, n in zip(*(b[c].to_pylist() for c in ("part", "side", "own", "other", "n"))):
            yield part, side, np.frombuffer(own, np.uint8).astype(np.int64), np.frombuffer(other, np.uint32).astype(np.int64), np.frombuffer(n, np.uint32)


def neighbours(texts: DataFrame, units: Units) -> DataFrame:
    """Packed counts of how often each unit is followed by each other, texts (text) standing between ends."""
    shared = texts.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, span = Tally(2 * HELD), shared.value.end + 1
        for batch in pieces(batches, "text"):
            found = words(batch["text"])
            seq = shared.value.sequence(found, _hashes(found))[0]
            before = np.concatenate([[shared.value.end], seq[:-1]])
            for keys, n in tally.add(before * span + seq, np.ones(len(seq), np.int64)):
                yield packed(keys // span, keys % span, n)
        for keys, n in tally.rest():
            yield packed(keys // span, keys % span, n)

    return texts.select("text").mapInArrow(run, PACKED)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """What classes decide of the log likelihood of the training texts, from the counts of class pairs."""
    return float(_xlogx(pairs).sum() - 2 * _xlogx(pairs.sum(axis=1)).sum())


def best_class(pairs: np.ndarray, right: np.ndarray, left: np.ndarray, itself: float, now: int) -> int:
    """The class that makes the likelihood largest for one unit, its present one if none is better.

    ``right`` and ``left`` count the classes that follow and precede the unit, ``itself``
    how often it follows itself. The last class is the end's.
    """
    m = pairs.copy()
    n = right.sum()
    right, left = right.copy(), left.copy()
    m[now] -= right
    m[:, now] -= left
    m[now, now] += itself
    right[now] -= itself
    left[now] -= itself
    k = len(m) - 1
    c = np.flatnonzero(right)
    gain = (_xlogx(m[:k, c] + right[c]) - _xlogx(m[:k, c])).sum(axis=1)
    c = np.flatnonzero(left)
    gain += (_xlogx(m[c, :k] + left[c, None]) - _xlogx(m[c, :k])).sum(axis=0)
    # In a corner a unit's right and left neighbours meet.
    corner, r, f = np.diag(m)[:k], right[:k], left[:k]
    gain += _xlogx(corner + r + f + itself) - _xlogx(corner + r) - _xlogx(corner + f) + _xlogx(corner)
    total = pairs.sum(axis=1)[:k]
    total[now] -= n
    gain -= 2 * (_xlogx(total + n) - _xlogx(total))
    best = int(gain.argmax())
    return best if gain[best] > gain[now] + 1e-9 else now


def exchange(run: Run, counted: DataFrame, n_units: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit, and the counts of class pairs, from packed counts. The last unit, the end, keeps the last class."""
    spark, span = counted.sparkSession, classes + 1
    wide = 2 * span + 1
    # Units of a part meet in few tasks; adaptive execution splits a part that is large.
    counted = run.keep(counted.hint("rebalance", "part"))
    of = np.arange(n_units) % classes
    of[-1] = classes

    def matrix(of: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(of)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(span * span)
            for part, _, own, other, n in _unpacked(batches):
                total += np.bincount(shared.value[part * GROUP + own] * span + shared.value[other], weights=n, minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["at", "n"])

        out = np.zeros(span * span)
        for r in counted.where("side = 0").mapInArrow(add_up, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            out[r["at"]] = r["n"]
        return out.reshape(span, span)

    def moves(of: np.ndarray, pairs: np.ndarray, turn: int) -> dict[int, int]:
        shared = spark.sparkContext.broadcast((of, pairs))

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Counts by unit, side and class, the last column for the unit itself."""
            own_class, sums = shared.value[0], {}
            for part, side, own, other, n in _unpacked(batches):
                total = sums.setdefault(part, np.zeros(GROUP * wide))
                total += np.bincount(own * wide + side * span + own_class[other], weights=n, minlength=len(total))
                if side == 0:
                    same = part * GROUP + own == other
                    total += np.bincount(own[same] * wide + 2 * span, weights=n[same], minlength=len(total))
            for part, total in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part)), pa.array(at), pa.array(total[at].astype(np.int64))], ["part", "at", "n"])

        def move(group: pa.Table) -> pa.Table:
            own, pairs = shared.value
            first = group["part"][0].as_py() * GROUP
            counts = np.bincount(group["at"].to_numpy(), weights=group["n"].to_numpy(), minlength=GROUP * wide).reshape(GROUP, wide)
            todo = [u for u in range(first, min(first + GROUP, n_units - 1)) if counts[u - first].any() and int(mix(np.array([u * rounds + turn // 2], _U))[0] >> _U(9)) % 2 == turn % 2]
            new = [best_class(pairs, c[:span], c[span : 2 * span], c[2 * span], int(own[u])) for u, c in ((u, counts[u - first]) for u in todo)]
            moved = [(u, k) for u, k in zip(todo, new) if k != own[u]]
            return pa.table([pa.array([u for u, _ in moved], pa.int64()), pa.array([k for _, k in moved], pa.int64())], names=["unit", "class"])

        summed = counted.mapInArrow(cells, "part long, at long, n long").groupBy("part", "at").agg(F.sum("n").cast("long").alias("n"))  # bounded for a part
        rows = summed.groupBy("part").applyInArrow(move, "unit long, class long")
        return {r["unit"]: r["class"] for r in rows.collect()}  # a row a unit at most

    pairs = matrix(of)
    best = (likelihood(pairs), of, pairs)
    still = 0
    for turn in range(rounds):
        change = moves(of, pairs, turn)
        still = 0 if change else still + 1
        if still == 2:
            break
        of = of.copy()
        of[list(change)] = list(change.values())
        pairs = matrix(of)
        best = max(best, (likelihood(pairs), of, pairs), key=lambda x: x[0])
    return best[1], best[2]


@dataclass
class Model:
    """Class transitions and what all words of a class have in common; logarithms of base 10."""

    units: Units
    of: np.ndarray  # class of each unit
    transition: np.ndarray
    size: np.ndarray  # of each class: what its words' discounted counts are divided by
    unknown: np.ndarray  # of each class: an unknown word of it, before that division
    n: int  # tokens in training
    v: int  # distinct ones
    ends: int

    @classmethod
    def of_counts(cls, units: Units, of: np.ndarray, pairs: np.ndarray, kinds: np.ndarray, v: int, ends: int) -> Model:
        total = pairs.sum(axis=1)
        share = (total + 1) / (total.sum() + len(total))
        transition = (pairs + PRIOR * share) / (total + PRIOR)[:, None]
        return cls(units, of, np.log10(transition), np.log10(total + 1), np.log10(DISCOUNT * kinds + 1), int(total.sum()), v, ends)

    def emission(self, n: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Of words with n occurrences in training and of class k."""
        return np.where(n > 0, np.log10(np.maximum(n, 1) - DISCOUNT), self.unknown[k]) - self.size[k]

    @property
    def base(self) -> float:
        return float(np.log10(self.n + 1 * (self.v + 1)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; ``first`` as in Words."""
    total = np.bincount(np.repeat(np.arange(len(first) - 1), np.diff(first)), weights=values, minlength=len(first) - 1)
    return total


def class_scores(
    docs: DataFrame, *, classes: int = CLASSES, rounds: int = ROUNDS, single: int = SINGLE, listed: int = LISTED, modulus: int = 7, held: int = 2
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of ``docs`` (doc_id, text, any other columns).

    Learns from rows whose crc32 of the id modulo ``modulus`` is not ``held``; a row without an id is
    held out. Null and blank texts are one end. Rows that repeat an id are texts of their
    own, and are learned from as often as they occur. Without any training text all words are unknown;
    an empty table gives an empty result.
    """
    run = Run(docs.sparkSession, "classes")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % modulus == held, F.lit(True))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", out.alias("held_out"))
    vocab = run.keep(vocabulary(docs))
    ends = docs.where("NOT held_out").count()

    # Words of the largest counts, all of one count or none, as many as may be listed. There are at most as many counts as the root of twice the tokens.
    counts = run.keep(vocab.groupBy("n_all").agg(F.count("*").alias("kinds")))
    running = counts.withColumn("upto", F.sum("kinds").over(W.orderBy(F.desc("n_all"))))
    least = running.where(F.col("upto") <= listed).agg(F.min("n_all")).first()[0]
    least = least if least is not None else 2**62
    units = Units(Listed.of(vocab.where(F.col("n_all") >= least).toArrow(), single), single)
    rare = vocab.where(F.col("n_all") < least)

    of, pairs = exchange(run, neighbours(docs.where("NOT held_out"), units), units.end + 1, classes, rounds)
    kinds = np.zeros(units.end + 1)
    seen = units.listed.counts > 0
    kinds += np.bincount(units.listed.units[seen], minlength=len(kinds))
    for r in rare.where("n > 0").groupBy("ending").count().collect():  # one row an ending at most
        kinds[single + r["ending"]] += r["count"]
    v = int(kinds.sum()) + (ends > 0)
    model = Model.of_counts(units, of, pairs, np.bincount(of, weights=kinds, minlength=classes + 1), v, ends)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, end = shared.value, classes
        for batch in pieces(batches, "text"):
            found = words(batch["text"])
            hashes, texts = _hashes(found), len(found.counts)
            seq, place, at, known = m.units.sequence(found, hashes)
            k = m.of[seq]
            moves = m.transition[np.concatenate([[end], k[:-1]]), k]
            word_k = k[place]
            n = np.where(known, m.units.listed.counts[at] if len(m.units.listed.counts) else 0, 0)
            # Words that are not listed lack their count: the join adds what depends on it.
            emitted = np.where(known, m.emission(n, word_k), -m.size[word_k])
            base = np.where(known, np.log10(n + 1), 0.0)
            lone = np.flatnonzero(~known)
            text = found.text_of
            keys = np.lexsort((hashes[lone], text[lone]))
            lone = lone[keys]
            new = np.ones(len(lone), bool)
            new[1:] = (hashes[lone][1:] != hashes[lone][:-1]) | (text[lone][1:] != text[lone][:-1])
            start = np.flatnonzero(new)
            times = np.diff(np.append(start, len(lone)))
            bounds = pa.array(np.searchsorted(text[lone[start]], np.arange(texts + 1)).astype(np.int32))
            lists = (hashes[lone[start]], word_k[lone[start]].astype(np.int64), times.astype(np.int64))
            closed = np.append(0, np.cumsum(found.counts + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["held_out"], pa.array(found.counts + 1), pa.array(_sums(known & (n > 0), found.first).astype(np.int64) + (m.ends > 0)),
                    pa.array(_sums(base, found.first) + np.log10(m.ends + 1) - (found.counts + 1) * m.base),
                    pa.array(_sums(moves, closed) + _sums(emitted, found.first)), *(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in lists),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "hash", "class", "times"],
            )

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, hash array<long>, class array<long>, times array<long>"
    first = run.keep(docs.select("doc_id", "held_out", "text").mapInArrow(score, kind).withColumn("row", F.monotonically_increasing_id()))
    lone = first.select("row", F.explode(F.arrays_zip("hash", "class", "times")).alias("x")).select("row", "x.*")
    looked = lone.join(rare.select("hash", "n"), "hash", "left")
    unknown = F.element_at(F.array(*map(F.lit, model.unknown.tolist())), F.col("class").cast("int") + 1)
    more = looked.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("base"),
        F.sum(F.col("times") * F.when(F.col("n") > 0, F.log10(F.col("n") - DISCOUNT)).otherwise(unknown)).alias("emitted"),
    )
    whole = first.drop("hash", "class", "times").join(more, "row", "left")
    total = F.col("score") + F.coalesce("emitted", F.lit(0.0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return class_scores(table(spark, folder, "documents").select("doc_id", "text"))
