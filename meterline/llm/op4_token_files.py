"""Token ids of a corpus in compressed binary chunks.

The documents are put in ascending order of doc_id by ranges, encoded, and written as
chunks of whole documents. The ids of a chunk are cut into blocks of fixed size, each block
is transposed into planes (one for each byte or each bit of an id), and every plane is
compressed with zstandard on its own. A second table is the chunk index: where each chunk
starts in the stream of all ids. Both are written by Spark, so a lost task is written
again and any store that Spark reaches will do.

    <folder>/chunks  shard, chunk, n_ids, doc_ids, lengths, plane_bytes, planes
    <folder>/index   shard, chunk, start, n_ids, n_docs
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.llm.tables import Run, small, table
from meterline.llm.text_arrays import pieces, resident

END_ID = 2
BLOCK, CHUNK_IDS = 16384, 1 << 18
#: Texts are looked up in slices of so many bytes, whose words are still at hand when their ids are joined.
_SLICE = 1 << 17
_MARKS = b".,;:!?%$&*#()[]|"
#: Words a worker remembers at least, and at most twice as many; it forgets those not met for the longest time.
REMEMBERED = 400_000
_CHUNKS = "shard int, chunk int, n_ids long, doc_ids array<long>, lengths array<int>, plane_bytes array<int>, planes binary"


class WordCoder:
    """The library's ids of a text, word by word.

    The vocabulary drops white space and never looks across it, so a text's ids are those
    of its words in turn. Each worker asks the library once for a word it remembers. The
    special tokens hold no white space either.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def ask(self, words: list[bytes]) -> Iterator[bytes]:
        """The ids of each word on its own."""
        return (np.array(c.ids, "<u4").tobytes() for c in self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False))

    def ask_letters(self, stems: list[bytes]) -> Iterator[bytes]:
        """The same for words of letters only, as one text: each ends with a piece that ends a word."""
        ids = np.array(self.library.encode_batch_fast([b" ".join(stems).decode()], add_special_tokens=False)[0].ids, "<u4")  # without places in the text
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(stems):  # a letter that lower-cases to more than letters
            return self.ask(stems)
        raw, edges = ids.tobytes(), [0, *(4 * stops).tolist()]
        return (raw[a:b] for a, b in zip(edges, edges[1:]))

    def learn(self, fresh: list[bytes]) -> None:
        """Words of letters, with marks after them or not, are looked up by their letters; the library splits there, too."""
        known, split, odd, stems, marks = self.known, [], [], set(), set()
        for w in fresh:
            stem = w.rstrip(_MARKS)
            if stem.isalpha() or stem.decode().isalpha():
                if len(stem) < len(w):
                    mark = w[len(stem) :]
                    split.append((w, stem, mark))
                    marks.add(mark)
                stems.add(stem)
            else:
                odd.append(w)
        new = self.missing(stems)
        for at in range(0, len(new), 2000):
            known.update(zip(new[at : at + 2000], self.ask_letters(new[at : at + 2000])))
        odd += self.missing(marks)
        for at in range(0, len(odd), 2000):
            known.update(zip(odd[at : at + 2000], self.ask(odd[at : at + 2000])))
        known.update((w, known[stem] + known[mark]) for w, stem, mark in split)

    def missing(self, words: set[bytes]) -> list[bytes]:
        """The words in neither generation; those of the older one are taken over."""
        known, older = self.known, self.older
        fresh = words.difference(known)
        if older:
            known.update((w, older[w]) for w in fresh if w in older)
            fresh = fresh.difference(older)
        return list(fresh)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        # A to Z are lower-cased by the vocabulary; only the names of special tokens depend on them.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        fresh = self.missing(set(filterfalse(self.known.__contains__, chain.from_iterable(split))))
        if fresh:
            self.learn(fresh)
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


def word_coder(path: str) -> WordCoder:
    return resident(("words", path), lambda: WordCoder(path))


def to_planes(ids: np.ndarray, kind: str, level: int = 3) -> tuple[list[int], bytes]:
    """Compressed sizes and bytes of the planes of all blocks, block after block."""
    press, parts = zstandard.ZstdCompressor(level=level), []
    for at in range(0, len(ids), BLOCK):
        block = np.ascontiguousarray(ids[at : at + BLOCK], "<u4").view(np.uint8).reshape(-1, 4)
        planes = block.T if kind == "byte" else np.packbits(np.unpackbits(block, axis=1, bitorder="little").T, axis=1)
        parts += [press.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
    return [len(p) for p in parts], b"".join(parts)


def from_planes(sizes: list[int], data: bytes, n_ids: int) -> np.ndarray:
    """The ids again; the number of planes tells bytes from bits."""
    if not n_ids:
        return np.empty(0, "<u4")
    expand, out, at, k = zstandard.ZstdDecompressor(), [], 0, 0
    each = len(sizes) // -(-n_ids // BLOCK)
    for done in range(0, n_ids, BLOCK):
        planes = []
        for size in sizes[k : k + each]:
            planes.append(np.frombuffer(expand.decompress(data[at : at + size]), np.uint8))
            at += size
        k += each
        stack, n = np.stack(planes), min(BLOCK, n_ids - done)
        block = stack.T if each == 4 else np.packbits(np.unpackbits(stack, axis=1)[:, :n].T, axis=1, bitorder="little")
        out.append(np.ascontiguousarray(block).view("<u4").reshape(-1))
    return np.concatenate(out)


def write_ids(docs: DataFrame, folder: str, vocab: str | None = None, *, end_id: int = END_ID, planes: str = "byte", chunk_ids: int = CHUNK_IDS) -> None:
    """Encode ``docs`` (doc_id, text, any other columns) into ``folder``.

    A null or empty text is the end id alone. Null ids come first; rows of one id are ordered
    by text. An empty table makes empty files.
    """
    vocab = vocab or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, chunk = word_coder(vocab), TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        owners: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), "<u4")
            sizes, data = to_planes(flat, planes)
            row = {"shard": shard, "chunk": chunk, "n_ids": len(flat), "doc_ids": list(owners), "lengths": [len(x) // 4 for x in ids], "plane_bytes": sizes, "planes": data}
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

        for batch in pieces(batches, "text", _SLICE):
            for owner, own in zip(batch["doc_id"].to_pylist(), coder.encode(batch["text"].cast(pa.large_binary()).to_pylist())):
                ids.append(own + end)
                owners.append(owner)
                held += len(own) // 4 + 1
                if held >= chunk_ids:
                    yield flush()
                    ids, owners, held, chunk = [], [], 0, chunk + 1
        if ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _CHUNKS).write.mode("overwrite").parquet(f"{folder}/chunks")

    chunks = docs.sparkSession.read.schema(_CHUNKS).parquet(f"{folder}/chunks").select("shard", "chunk", "n_ids", F.size("doc_ids").alias("n_docs"))
    # One row for each task that wrote, then running sums within each shard.
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    offsets = shards.select("shard", (F.sum("total").over(W.orderBy("shard")) - F.col("total")).alias("base"))
    inside = F.sum("n_ids").over(W.partitionBy("shard").orderBy("chunk")) - F.col("n_ids")
    index = chunks.withColumn("inside", inside).join(offsets, "shard").select("shard", "chunk", (F.col("base") + F.col("inside")).alias("start"), "n_ids", "n_docs")
    index.write.mode("overwrite").parquet(f"{folder}/index")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit) of each document written."""
    index = spark.read.schema("shard int, chunk int, start long").parquet(f"{folder}/index")
    chunks = spark.read.schema(_CHUNKS).parquet(f"{folder}/chunks").join(small(index, 24), ["shard", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch[name][row].as_py() for name in batch.schema.names}
                raw = from_planes(one["plane_bytes"], one["planes"], one["n_ids"]).tobytes()
                bounds = np.cumsum([0, *one["lengths"]])
                texts = [raw[4 * a : 4 * b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(one["doc_ids"], pa.int64()), pa.array(bounds[:-1] + one["start"]), pa.array(texts, pa.binary())], ["doc_id", "start", "ids"])

    return chunks.select("start", "n_ids", "doc_ids", "lengths", "plane_bytes", "planes").mapInArrow(run, "doc_id long, start long, ids binary")


def query(spark: SparkSession, folder: str) -> DataFrame:
    files = Run(spark, "token-files").folder
    write_ids(table(spark, folder, "documents"), files)
    return read_ids(spark, files).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
