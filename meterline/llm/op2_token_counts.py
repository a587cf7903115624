"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie. A node whose text cannot be continued has a failure link to the
node of what is left once the longest pieces are taken off its front, and the number of
pieces taken off. Walking a word follows each byte once and adds those numbers up, so the
length comes out in linear time and no piece is ever built.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.tables import table
from meterline.llm.text_arrays import pieces

#: Words a worker remembers; it forgets all of them beyond that.
REMEMBERED = 300_000


class Automaton:
    """Piece counts under greedy longest match. A word with no way on is one unknown piece."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.step: dict[int, int] = {}  # node * 256 + byte -> node
        final = [False]
        for piece in vocabulary:
            node = 0
            for b in piece:
                nxt = self.step.get(node << 8 | b)
                if nxt is None:
                    nxt = self.step[node << 8 | b] = len(final)
                    final.append(False)
                node = nxt
            final[node] = node > 0
        edges: list[list[tuple[int, int]]] = [[] for _ in final]
        for key, node in self.step.items():
            edges[key >> 8].append((key & 255, node))
        # Parents come first, so a node's link follows from its parent's.
        self.link, self.popped = [-1] * len(final), [0] * len(final)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for b, node in edges[parent]:
                queue.append(node)
                if final[node]:
                    self.link[node], self.popped[node] = 0, 1
                    continue
                at, popped = self.link[parent], self.popped[parent]
                while at >= 0 and (at << 8 | b) not in self.step:
                    popped += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.popped[node] = self.step[at << 8 | b], popped

    def count(self, word: bytes) -> int:
        """Number of pieces of a word; 0 for an empty one."""
        step, link, popped = self.step.get, self.link, self.popped
        node = total = 0
        for b in word:
            while (nxt := step(node << 8 | b)) is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 1
            node = nxt
        while node:
            total += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return total


@lru_cache(maxsize=2)
def automaton(path: str) -> tuple[Automaton, dict[bytes, int]]:
    """The automaton of a rank file, and what the worker remembers."""
    with open(path, "rb") as f:
        return Automaton(base64.b64decode(line.split()[0]) for line in f if line.strip()), {}


def token_counts(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens for each row of ``docs`` (doc_id, text, any other columns).

    Words are runs between ASCII white space, each measured as it stands after a space. Null
    and blank texts have none; rows keep their ids, null or repeated.
    """
    vocab = vocab or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton(vocab)
        for batch in pieces(batches, "text"):
            split = [t.encode().split() for t in batch["text"].to_pylist()]
            need = set().union(*split)
            if not need <= known.keys():
                if len(known) + len(need) > REMEMBERED:
                    known.clear()
                known.update((w, machine.count(b" " + w)) for w in need if w not in known)
            get = known.__getitem__
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(ws) for ws in split], pa.int64()), pa.array([sum(map(get, ws)) for ws in split], pa.int64())], ["doc_id", "n_words", "n_tokens"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"))
