"""Nearest neighbours by a forest of random-projection trees.

Trees are grown on a bounded sample of the vectors; every vector is then placed in a leaf
of each tree. A query walks all trees through one priority queue, always opening the
node whose border it is closest to, until it has reached its share of the leaves. Leaves are dealt
over parts. A vector or query is sent once to each part that holds leaves of it; there queries stream
past the vectors, the candidates of the opened leaves are scored exactly, and only the best of all
leaves of the part go on. Equal vectors are one candidate with its few smallest ids, and equal
queries search once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.llm.tables import Run, table

TREES, LEAF, NEAREST, EVERY = 8, 256, 5, 50
#: A query opens this share of all leaves, and so many at least. Vectors without structure need such a share for a recall of 0.95.
SHARE, VISITS = 0.12, 64
#: The trees are grown on at most so many vectors, those with the least hash of their id.
SAMPLE = 20_000
#: Vectors of a leaf beyond so many are cut into blocks.
BLOCK = 16_384
#: A part holds about so many bytes of vectors: the number of parts follows the table.
PART_BYTES = 32 << 20
MEETING = "part long, asks boolean, id long, ids array<long>, v array<double>, cells array<long>"


@dataclass
class Forest:
    """All nodes of all trees in flat arrays. Child ~k is leaf k; leaves are numbered through all trees."""

    normals: np.ndarray
    borders: np.ndarray
    children: np.ndarray  # (nodes, 2)
    roots: list[int]
    size: int  # number of leaves

    @classmethod
    def grow(cls, sample: np.ndarray, trees: int, leaf: int, seed: int = 10) -> Forest:
        rng = np.random.default_rng(seed)
        normals, borders, children, roots, leaves = [], [], [], [], 0
        for _ in range(trees):
            todo = [(np.arange(len(sample)), -1, 0)]
            while todo:
                rows, parent, side = todo.pop()
                direction = None
                if len(rows) > leaf:
                    for _ in range(5):
                        a, b = rng.choice(rows, 2, replace=False)
                        direction = sample[a] - sample[b] + 1e-3 * rng.standard_normal(sample.shape[1])
                        direction /= np.linalg.norm(direction)
                        far = sample[rows] @ direction
                        border = float(np.median(far))
                        right = far > border
                        if 0 < right.sum() < len(rows):
                            break
                        direction = None
                if direction is None:
                    name, leaves = ~leaves, leaves + 1
                else:
                    name = len(normals)
                    normals.append(direction)
                    borders.append(border)
                    children.append([0, 0])
                    todo += [(rows[~right], name, 0), (rows[right], name, 1)]
                if parent < 0:
                    roots.append(name)
                else:
                    children[parent][side] = name
        width = sample.shape[1]
        return cls(np.array(normals).reshape(-1, width), np.array(borders), np.array(children, int).reshape(-1, 2), roots, leaves)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(vectors), len(self.roots)), int)
        for t, root in enumerate(self.roots):
            node = np.full(len(vectors), root)
            live = np.flatnonzero(node >= 0)
            while len(live):
                at = node[live]
                side = np.einsum("ij,ij->i", vectors[live], self.normals[at]) > self.borders[at]
                node[live] = self.children[at, side.astype(int)]
                live = live[node[live] >= 0]
            out[:, t] = ~node
        return out

    def search(self, vectors: np.ndarray, visits: int) -> list[list[int]]:
        """The leaves each query opens, most promising first."""
        margins = vectors @ self.normals.T - self.borders if len(self.normals) else np.empty((len(vectors), 0))
        found = []
        for row in margins.tolist():
            queue = [(float("-inf"), root) for root in self.roots]
            heapq.heapify(queue)
            opened: list[int] = []
            while queue and len(opened) < visits:
                cost, node = heapq.heappop(queue)
                if node < 0:
                    opened.append(~node)
                    continue
                margin = row[node]
                near = int(margin > 0)
                heapq.heappush(queue, (cost, int(self.children[node, near])))
                heapq.heappush(queue, (max(cost, abs(margin)), int(self.children[node, 1 - near])))
            found.append(opened)
        return found


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors as rows, each times a power of two that brings its largest component near 1: no square overflows or vanishes, cosines stay."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    _, exponent = np.frexp(np.abs(rows).max(axis=1, initial=0, keepdims=True))
    return np.ldexp(rows, -exponent)


def by_part(owners: np.ndarray, cells: np.ndarray, parts: int, ids: pa.Array, same: pa.Array, v: pa.Array, asks: bool) -> pa.RecordBatch:
    """One row for each owner and part, with the cells of that owner in that part: a vector is sent once to a part, whatever it shares there."""
    part = (cells * 0x9E3779B1 >> 8) % parts
    order = np.lexsort((cells, part, owners))
    owners, part, cells = owners[order], part[order], cells[order]
    first = np.flatnonzero(np.diff(owners, prepend=-1) | np.diff(part, prepend=-1))
    own = pa.array(owners[first])
    bounds = pa.array(np.append(first, len(cells)).astype(np.int32))
    columns = [pa.array(part[first]), pa.array(np.full(len(first), asks)), ids.take(own), same.take(own), v.take(own), pa.ListArray.from_arrays(bounds, pa.array(cells))]
    return pa.RecordBatch.from_arrays(columns, ["part", "asks", "id", "ids", "v", "cells"])


def meet(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The ``most`` nearest vectors of each query within each part, over all cells the query opens there.

    Rows come by part, vectors before queries. The vectors of one part are held, their number
    is bounded by the number of parts; queries stream by in blocks.
    """
    part, held, cells = None, [], None
    for batch in batches:
        keys = batch["part"].to_numpy() * 2 + batch["asks"].to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(keys, prepend=-1, append=-1))
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
            at, asks = divmod(int(keys[start]), 2)
            if at != part:
                part, held, cells = at, [], None
            rows = batch.slice(start, stop - start)
            if not asks:
                held.append(rows)
                continue
            if cells is None:
                cells = Cells(held)
            for block in range(0, rows.num_rows, 256):
                yield cells.nearest(rows.slice(block, 256), most)


class Cells:
    """The vectors of one part by cell."""

    def __init__(self, held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks() if held else None
        self.count = table.num_rows if held else 0
        if not self.count:
            return
        column = {name: table[name].chunk(0) for name in ("id", "ids", "v", "cells")}
        self.ids, self.reps, self.v = column["ids"], column["id"].to_numpy(), matrix(column["v"])
        self.norm = np.sqrt((self.v * self.v).sum(axis=1))
        cells, rows = flat(column["cells"])
        order = np.argsort(cells, kind="stable")
        self.rows = rows[order]
        self.names, self.first = np.unique(cells[order], return_index=True)
        self.stop = np.append(self.first[1:], len(rows))

    def nearest(self, queries: pa.RecordBatch, most: int) -> pa.RecordBatch:
        out = [np.empty(0, int)], [np.empty(0, int)]
        if self.count:
            q = matrix(queries["v"])
            q_norm = np.sqrt((q * q).sum(axis=1))
            cells, asking = flat(queries["cells"])
            order = np.argsort(cells, kind="stable")
            cells, asking = cells[order], asking[order]
            names, first = np.unique(cells, return_index=True)
            place = np.searchsorted(self.names, names)
            for n, p, a, b in zip(names.tolist(), place.tolist(), first.tolist(), [*first[1:].tolist(), len(cells)]):
                if p == len(self.names) or self.names[p] != n:
                    continue
                c, who = self.rows[self.first[p] : self.stop[p]], asking[a:b]
                near = (q[who] / q_norm[who, None]) @ (self.v[c] / self.norm[c, None]).T
                keep = min(most, len(c))
                least = np.partition(near, len(c) - keep, axis=1)[:, len(c) - keep]
                i, j = np.nonzero(near >= least[:, None] - 1e-9)
                out[0].append(who[i])
                out[1].append(c[j])
        pairs = np.unique(np.stack([np.concatenate(out[0]), np.concatenate(out[1])]), axis=1)
        rows, cols, scores = pairs[0], pairs[1], np.empty(0)
        if len(rows):
            scores = (self.v[cols] * q[rows]).sum(axis=1) / (self.norm[cols] * q_norm[rows])
            order = np.lexsort((self.reps[cols], -scores, rows))
            rows, cols, scores = rows[order], cols[order], scores[order]
            kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < most
            rows, cols, scores = rows[kept], cols[kept], scores[kept]
        found = pa.array(cols)
        reps, same = (pa.array(self.reps).take(found), self.ids.take(found)) if self.count else (pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays([queries["id"].take(pa.array(rows)), reps, same, pa.array(scores)], ["q", "rep", "ids", "score"])


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The items of all lists, and the row each comes from."""
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part: no null, zero or non-finite ones, all of the length most rows have."""
    v = F.col("embedding").cast("array<double>")
    fit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fit = fit.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return fit


def nearest(vectors: DataFrame, *, every: int = EVERY, k: int = NEAREST, trees: int = TREES, leaf: int = LEAF, share: float = SHARE, visits: int = VISITS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``every``, the k vectors of largest cosine found.

    ``vectors`` (vec_id, embedding, any other columns). Ties go to the smaller id; a query
    never finds its own id. It opens ``share`` of all leaves, ``visits`` at least, so small
    inputs give exact results, and all candidates where there are fewer than k.
    Vectors of another length than most take no part; rows that repeat an id with the same
    vector are one; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    run = Run(spark, "ann")
    fit = usable(vectors)
    common = fit.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    width = common["n"] if common else 0
    fit = fit.where(F.size("v") == width)
    # Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest.
    ranked = fit.distinct().withColumn("place", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    distinct = run.keep(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v"))
    asked = fit.where(F.col("vec_id") % every == 0).distinct().join(distinct.select("rep", "v"), "v")
    asked = run.keep(asked.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("q"), "v"))
    searches = asked.groupBy("q").agg(F.any_value("v").alias("v"))

    total = distinct.count()
    some = distinct.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").toArrow()["v"].combine_chunks()
    known = unit(matrix(some)) if len(some) else np.zeros((1, max(width, 1)))
    forest = Forest.grow(known, trees, max(8, leaf * len(known) // max(total, 1)))
    reach = max(visits, math.ceil(share * forest.size))
    shared = spark.sparkContext.broadcast(forest)  # bounded by the sample

    # A leaf that outgrew the sample is cut into blocks by a hash of the id; a query opens all of them.
    cuts = max(1, math.ceil(total * trees / max(forest.size, 1) / BLOCK))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * trees * width * 8 / PART_BYTES))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch["rep"].to_numpy()
            cells = shared.value.leaves(unit(matrix(batch["v"]))) * cuts + ((reps * 0x9E3779B1 >> 8) % cuts)[:, None]
            owners = np.repeat(np.arange(len(reps)), cells.shape[1])
            yield by_part(owners, cells.ravel(), parts, batch["rep"], batch["ids"], batch["v"], False)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                opened = shared.value.search(unit(matrix(part["v"])), reach)
                owners = np.repeat(np.arange(part.num_rows), [len(x) * cuts for x in opened])
                cells = (np.array([x for own in opened for x in own], np.int64)[:, None] * cuts + np.arange(cuts)).ravel()
                none = pa.nulls(part.num_rows, pa.list_(pa.int64()))
                yield by_part(owners, cells, parts, part["q"], none, part["v"], True)

    index = distinct.select("rep", "ids", "v").mapInArrow(place, MEETING)
    walks = searches.select("q", "v").mapInArrow(walk, MEETING)
    met = index.union(walks).repartition(parts, "part").sortWithinPartitions("part", "asks").mapInArrow(lambda batches: meet(batches, k + 1), "q long, rep long, ids array<long>, score double")
    one = met.groupBy("q", "rep").agg(F.any_value("ids").alias("ids"), F.max("score").alias("score"))
    top = one.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("place") <= k + 1)
    pairs = asked.select("query_id", "q").join(top.select("q", "score", F.explode("ids").alias("vec_id")), "q").where("vec_id != query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))
