"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent words of the corpus, counted in Spark over all texts, are encoded once and
compiled into an automaton whose equal suffixes share their states. Each transition knows
how many words come before it, so walking a word adds up to its rank, which is its place
in the table of id sequences. The file (bounded by ``max_words``) is handed to every
executor by Spark and memory-mapped there. Words it lacks are merged exactly by rank.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import uuid
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.tables import Run, small_batches, table
from meterline.llm.text_arrays import pieces, plain_words, resident, vacate

MAX_WORDS = 50_000
#: Words a worker remembers at least, and at most twice as many; it forgets those not met for the longest time.
REMEMBERED = 25_000
_BUCKET_BYTES = 2 << 20
#: Texts are split and encoded in slices of so many bytes: a slice takes some forty times its size as words and ids.
_SLICE = 1 << 18
#: Words of up to so many bytes are merged together; longer ones on their own.
_WIDTHS = (6, 8, 10, 12, 16, 24, 40, 64)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Merger:
    """The vocabulary: exact merging of one word, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in piece) for piece, i in vocab.items() if all(c in letters for c in piece)}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.single = {b: vocab[c] for c, b in letters.items() if c in vocab}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: the leftmost pair of least rank is merged until no pair is in the vocabulary."""
        ids = list(map(self.single.__getitem__, word))
        if len(ids) > 200:
            return self._merge_long(ids)
        get, none = self.rank.get, len(self.made)
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [new] = [self.made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | new, none)
            if i < len(ranks):
                ranks[i] = get(new << 20 | ids[i + 1], none)
        return tuple(ids)

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of bytes, ranks of pairs of bytes, all pairs in ascending order, their ranks, and what each rank makes."""
        single = np.array([self.single.get(b, -1) for b in range(256)], np.int32)
        pairs = np.array(sorted(self.rank), np.int64)
        ranks = np.array([self.rank[p] for p in pairs.tolist()], np.int32)
        first = np.array([self.rank.get(int(a) << 20 | int(b), len(self.made)) for a in single for b in single], np.int32)
        return single, first, pairs, ranks, np.array(self.made, np.int32)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """``merge`` for many words at once, as bytes of 32-bit ids: a step merges one pair of every word that still has one."""
        out, sizes = [b""] * len(words), np.fromiter(map(len, words), np.int64, len(words))
        for low, high in zip((0, *_WIDTHS), _WIDTHS):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            for at in range(0, len(own), 8192):
                self._merge_matrix(words, own[at : at + 8192], sizes, high, out)
        for i in np.flatnonzero(sizes > _WIDTHS[-1]).tolist():
            out[i] = array("i", self.merge(words[i])).tobytes()
        return out

    def _merge_matrix(self, words: list[bytes], rows: np.ndarray, sizes: np.ndarray, width: int, out: list[bytes]) -> None:
        single, first, pairs, pair_ranks, made = self.tables
        none = len(made)

        def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            if not none:
                return np.full(len(a), none, np.int32)
            key = a.astype(np.int64) << 20 | b  # -1 where b is behind the word
            at = np.minimum(np.searchsorted(pairs, key), none_at)
            return np.where(pairs[at] == key, pair_ranks[at], none)

        def emit(done: np.ndarray, ids: np.ndarray) -> None:
            raw, step = ids.tobytes(), 4 * ids.shape[1]
            for k, (i, n) in enumerate(zip(done.tolist(), (ids >= 0).sum(1).tolist())):
                out[i] = raw[k * step : k * step + 4 * n]

        none_at = len(pairs) - 1
        data = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in rows.tolist()]), np.uint8).reshape(-1, width)
        behind = np.arange(width) >= sizes[rows][:, None]
        ids = single[data]
        if (ids[~behind] < 0).any():
            raise KeyError("a byte is not in the vocabulary")
        ids[behind] = -1
        ranks = first[data[:, :-1].astype(np.int64) << 8 | data[:, 1:]]
        ranks[behind[:, 1:]] = none
        while ranks.shape[1]:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            going = best < none
            if not going.all():
                emit(rows[~going], ids[~going])
                rows, ids, ranks, at, best = rows[going], ids[going], ranks[going], at[going], best[going]
                if not len(rows):
                    return
            line, new = np.arange(len(rows)), made[best]
            ids[line, at] = new
            kept = np.ones(ids.shape, bool)
            kept[line, at + 1] = False
            ids = ids[kept].reshape(len(rows), -1)
            kept = np.ones(ranks.shape, bool)
            kept[line, at] = False
            ranks = ranks[kept].reshape(len(rows), -1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < ranks.shape[1])
            ranks[left, at[left] - 1] = rank(ids[left, at[left] - 1], new[left])
            ranks[right, at[right]] = rank(new[right], ids[right, at[right] + 1])
        emit(rows, ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap over a linked list, so that long runs take n log n steps."""
        n, rank = len(ids), self.rank.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.made[r], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (r := rank(ids[left] << 20 | ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return tuple(x for x, live in zip(ids, alive) if live)


class Lexicon:
    """A minimal acyclic automaton over byte strings, as flat arrays."""

    FIELDS = (("first", np.int32), ("label", np.uint8), ("target", np.int32), ("skip", np.int32), ("final", np.uint8), ("starts", np.int32), ("ids", np.int32))

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, entries: dict[bytes, tuple[int, ...]]) -> Lexicon:
        """From words in ascending order: what follows the shared prefix of the last word is frozen, equal states become one."""
        keys = sorted(entries)
        edges: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path = [0]

        def freeze(depth: int, word: bytes) -> None:
            while len(path) - 1 > depth:
                state = path.pop()
                form = (final[state], *edges[state].items())
                edges[path[-1]][word[len(path) - 1]] = register.setdefault(form, state)

        last = b""
        for key in keys:
            shared = len(os.path.commonprefix([key, last]))
            freeze(shared, last)
            for b in key[shared:]:
                edges.append({})
                final.append(False)
                edges[path[-1]][b] = len(edges) - 1
                path.append(len(edges) - 1)
            final[path[-1]] = True
            last = key
        freeze(0, last)

        order, place, stack = [], {}, [0]
        while stack:
            state = stack.pop()
            if state not in place:
                place[state] = len(order)
                order.append(state)
                stack.extend(edges[state].values())
        reach: dict[int, int] = {}
        todo = [0]
        while todo:
            state = todo[-1]
            missing = [t for t in edges[state].values() if t not in reach]
            if missing:
                todo.extend(missing)
                continue
            reach[state] = final[state] + sum(reach[t] for t in edges[state].values())
            todo.pop()
        first, label, target, skip = [0], [], [], []
        for state in order:
            before = int(final[state])
            for b, t in sorted(edges[state].items()):
                label.append(b)
                target.append(place[t])
                skip.append(before)
                before += reach[t]
            first.append(len(label))
        lengths = [len(entries[k]) for k in keys]
        arrays = {
            "first": first, "label": label, "target": target, "skip": skip, "final": [final[s] for s in order],
            "starts": np.cumsum([0, *lengths]), "ids": [i for k in keys for i in entries[k]],
        }
        return cls(**{name: np.asarray(arrays[name], kind) for name, kind in cls.FIELDS})

    @property
    def states(self) -> int:
        return len(self.final)

    def find(self, word: bytes) -> tuple[int, ...] | None:
        state, rank = 0, 0
        first, label, target, skip = self.first, self.label, self.target, self.skip
        for b in word:
            a, z = first[state], first[state + 1]
            at = a + int(np.searchsorted(label[a:z], b))
            if at == z or label[at] != b:
                return None
            rank += skip[at]
            state = target[at]
        return tuple(self.ids[self.starts[rank] : self.starts[rank + 1]].tolist()) if self.final[state] else None

    def find_all(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """``find`` for many words at once, a byte of all of them a step."""
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        keys = self.keys
        state, rank, live = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        step = 0
        while len(live) and len(keys):
            going = live[sizes[live] > step]
            wanted = state[going] * 256 + data[begin[going] + step]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            good = keys[at] == wanted
            state[going[~good]] = -1
            live, at = going[good], at[good]
            rank[live] += self.skip[at]
            state[live] = self.target[at]
            step += 1
        known = (state >= 0) & (np.asarray(self.final, bool)[np.maximum(state, 0)])
        starts, ids = self.plain
        return [tuple(ids[starts[r] : starts[r + 1]]) if k else None for k, r in zip(known.tolist(), rank.tolist())]

    @cached_property
    def keys(self) -> np.ndarray:
        """State and label of every edge, in order."""
        return np.repeat(np.arange(self.states), np.diff(self.first)).astype(np.int64) * 256 + self.label

    @cached_property
    def plain(self) -> tuple[list[int], list[int]]:
        return np.asarray(self.starts).tolist(), np.asarray(self.ids).tolist()

    def save(self, path: str) -> None:
        sizes = np.array([len(getattr(self, n)) for n, _ in self.FIELDS], np.int64)
        with open(path, "wb") as f:
            f.write(sizes.tobytes())
            for name, _ in sorted(self.FIELDS, key=lambda x: -np.dtype(x[1]).itemsize):
                f.write(np.ascontiguousarray(getattr(self, name)).tobytes())

    @classmethod
    def open(cls, path: str) -> Lexicon:
        sizes = dict(zip([n for n, _ in cls.FIELDS], np.fromfile(path, np.int64, len(cls.FIELDS)).tolist()))
        at, arrays = 8 * len(cls.FIELDS), {}
        for name, kind in sorted(cls.FIELDS, key=lambda x: -np.dtype(x[1]).itemsize):
            n = sizes[name]
            arrays[name] = np.memmap(path, kind, "r", at, (n,)) if n else np.empty(0, kind)
            at += n * np.dtype(kind).itemsize
        return cls(**arrays)


class Coder:
    """Encoder and decoder of one worker. Ids of remembered words are held as bytes of 32-bit numbers."""

    def __init__(self, vocab: str, lexicon: str | None):
        self.merger = merger_of(vocab)
        self.lexicon = Lexicon.open(SparkFiles.get(lexicon)) if lexicon else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        """Ids of words that are not in ``known``; all words of a batch stay there until the next."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        older = self.older
        self.known.update((w, older[w]) for w in words if w in older)
        fresh = [w for w in words if w not in self.known]
        raw = [w.encode() for w in fresh]
        found = self.lexicon.find_all(raw) if self.lexicon and raw else [None] * len(raw)
        self.known.update((w, array("i", ids).tobytes()) for w, ids in zip(fresh, found) if ids is not None)
        rare = [i for i, ids in enumerate(found) if ids is None]
        self.known.update(zip([fresh[i] for i in rare], self.merger.merge_many([raw[i] for i in rare])))

    def encode(self, texts: list[str]) -> list[list[int]]:
        merger = self.merger
        split = []
        for text in texts:
            parts = merger.splitter.split(text) if merger.splitter and any(s in text for s in merger.special) else [text]
            split.append([p if p in merger.special else merger.words.findall(p) for p in parts if p])
        need = set().union(*(part for doc in split for part in doc if not isinstance(part, str)))
        if not need <= self.known.keys():
            self.learn(need)
        known, out = self.known.__getitem__, []
        for doc in split:
            ids = b"".join(array("i", [merger.special[part]]).tobytes() if isinstance(part, str) else b"".join(map(known, part)) for part in doc)
            out.append(np.frombuffer(ids, np.int32).tolist())
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.merger.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def merger_of(vocab: str) -> Merger:
    return Merger(vocab)


def coder(vocab: str, lexicon: str | None) -> Coder:
    return resident(("bpe", vocab, lexicon), lambda: Coder(vocab, lexicon))


def frequent_words(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """word, n of the words met most often in all texts.

    Parts of 2 MB are counted in memory first. A word met once in a part leaves no count
    there, so a count is short by the number of parts at most (lossy counting).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in pieces(batches, "text", _BUCKET_BYTES):
            found = plain_words(batch["text"])
            hashes, at, n = np.unique(found.hashes(), return_index=True, return_counts=True)
            often = (n > 1) & (found.ends[at] - found.starts[at] <= 64)
            raw = found.data.tobytes()
            a, b = found.starts[at[often]].tolist(), found.ends[at[often]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([raw[x:y] for x, y in zip(a, b)], pa.binary()), pa.array(n[often].astype(np.int64))], ["word", "n"])

    parts = docs.select("text").mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(max_words)


def compile_lexicon(docs: DataFrame, vocab: str, max_words: int = MAX_WORDS) -> str:
    """Compile the frequent words, as they stand after a space, and hand the file to all executors. Returns the file's name."""
    merger = merger_of(vocab)
    entries = {}
    for row in frequent_words(docs, max_words).collect():  # at most max_words short words
        word = b" " + bytes(row["word"])
        try:
            if merger.words.fullmatch(word.decode()):
                entries[word] = merger.merge(word)
        except UnicodeDecodeError:
            continue
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(), name)
    Lexicon.build(entries).save(path)
    docs.sparkSession.sparkContext.addFile(path)
    return name


def encode(docs: DataFrame, vocab: str | None = None, lexicon: str | None = None) -> DataFrame:
    """doc_id and ids of each row of ``docs``, and the text decoded from those ids as ``decoded``.

    A null or empty text has no ids and decodes to the empty text. Texts of special tokens
    become their ids, as the library does. Rows keep their ids, null or repeated.
    """
    vocab = vocab or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocab, lexicon)
        for batch in pieces(batches, "text", _SLICE):
            ids = own.encode(batch["text"].to_pylist())
            bounds = np.cumsum([0, *map(len, ids)])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, bounds[-1])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat)), pa.array(list(map(own.decode, ids)), pa.large_string())],
                ["doc_id", "ids", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from the real ids and texts."""
    vocab = vocab or public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    with small_batches(spark):  # texts are counted and encoded in here, their digests kept
        coded = encode(docs, vocab, compile_lexicon(docs, vocab))
        return Run(spark, "bpe").keep(_digested(coded))


def _digested(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"))
