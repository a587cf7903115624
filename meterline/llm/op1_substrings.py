"""Exact repeats of at least 20 words, by fixed-block anchors.

1. Anchors. The non-overlapping blocks of 10 words at places 0, 10, 20 ... of every document
   are the index; every rolling window of 10 words probes it. Any repeat of 20 words holds a
   whole block of its earlier copy, so it cannot be missed. Fingerprints travel in packed
   arrays by bucket of the hash, 31 bits and a mark for blocks; a false hit costs work only.
2. Extension. Around the hits, windows of 20 words are compared in full by a 64-bit hash
   within a bucket dealt by another hash. Each learns whether it starts earlier somewhere.
   Runs of such windows are the maximal exact repeats.
3. Words covered by them are removed.

A window met often is sent once by each part of the input: a part settles its own copies
first. So a passage in a third of all documents gives a bucket one entry for each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.tables import BROADCAST_BYTES, Run, table
from meterline.llm.text_arrays import mix, pieces, windows, words

BLOCK, REPEAT = 10, 20
#: Hits are kept by segments of so many words, 64 segments to a row.
SEGMENT = 16
PART_BYTES = 4 << 20
#: Text for each bucket of fingerprints; the number of buckets follows the input.
BUCKET_BYTES = 12 << 20
_U = np.uint64
_HOMED = "home int, owners binary, blocks binary, masks binary"
_PACKED = "bucket int, kind int, owners binary, counts binary, prints binary, places binary"


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, so that the zeros of small numbers compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes() if len(values) else b""


def _values(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


@dataclass
class Entries:
    """Fingerprints with their documents and places; in order of document and place when packed."""

    owners: np.ndarray
    places: np.ndarray
    prints: np.ndarray

    def take(self, which: np.ndarray) -> Entries:
        return Entries(self.owners[which], self.places[which], self.prints[which])

    def packed(self) -> list[bytes]:
        """A document's places are kept as steps from one to the next."""
        n = len(self.owners)
        new = np.ones(n, bool)
        new[1:] = self.owners[1:] != self.owners[:-1]
        starts = np.flatnonzero(new)
        steps = self.places.copy()
        steps[1:] -= np.where(new[1:], 0, self.places[:-1])
        return [_planes(self.owners[starts]), _planes(np.diff(np.append(starts, n)).astype("<u4")), self.prints.tobytes(), _planes(steps.astype("<u4"))]

    @classmethod
    def unpacked(cls, group: pa.Table, kind: str) -> Entries:
        owners, places, prints = [np.empty(0, "<i8")], [np.empty(0, np.int64)], [np.empty(0, kind)]
        for o, c, p, s in zip(*(group[x].to_pylist() for x in ("owners", "counts", "prints", "places"))):
            counts = _values(c, "<u4").astype(np.int64)
            steps = np.cumsum(_values(s, "<u4").astype(np.int64))
            first = np.cumsum(counts) - counts
            base = np.concatenate([[0], steps])[first]
            owners.append(np.repeat(_values(o, "<i8"), counts))
            places.append(steps - np.repeat(base, counts))
            prints.append(np.frombuffer(p, kind))
        return cls(np.concatenate(owners), np.concatenate(places), np.concatenate(prints))


def _marks(owners: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, block, mask: one bit for each spot of a document, 64 to a mask."""
    blocks = spots >> 6
    order = np.lexsort((blocks, owners))
    owners, blocks, bits = owners[order], blocks[order], _U(1) << (spots[order] & 63).astype(_U)
    new = np.ones(len(owners), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (blocks[1:] != blocks[:-1])
    starts = np.flatnonzero(new)
    masks = np.bitwise_or.reduceat(bits, starts) if len(starts) else np.empty(0, _U)
    return owners[starts], blocks[starts], masks


def _bits(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and spot of every bit of a column array<struct<block, mask>>; null is none."""
    lists = lists.cast(pa.list_(pa.struct([("block", pa.int64()), ("mask", pa.int64())])))
    counts = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], int)
    flat = lists.flatten()
    blocks, masks = flat.field("block").to_numpy(), np.ascontiguousarray(flat.field("mask").to_numpy())
    at, bit = np.nonzero(np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")) if len(masks) else (np.empty(0, int), np.empty(0, int))
    return np.repeat(np.arange(len(lists)), counts)[at], blocks[at] * 64 + bit


def _rows(buckets: np.ndarray, n: int, entries: Entries, marks: tuple[np.ndarray, np.ndarray, np.ndarray], spread: int) -> pa.RecordBatch:
    """A row (kind 0) for each bucket's entries and one (kind 1) for the marks settled here."""
    out = []
    order = np.argsort(buckets, kind="stable")
    edges = np.searchsorted(buckets[order], np.arange(n + 1))
    for b in range(n):
        which = order[edges[b] : edges[b + 1]]
        if len(which):
            out.append((b, 0, *entries.take(which).packed()))
    if len(marks[0]):
        out.append((spread % n, 1, marks[0].astype("<i8").tobytes(), b"", marks[2].astype("<u8").tobytes(), marks[1].astype("<i8").tobytes()))
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
    columns = list(zip(*out)) if out else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "kind", "owners", "counts", "prints", "places"])


def _settled(group: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [(np.frombuffer(o, "<i8"), np.frombuffer(b, "<i8"), np.frombuffer(m, "<u8")) for o, m, b in zip(*(group[x].to_pylist() for x in ("owners", "prints", "places")))]


def _united(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All marks, one mask for each document and block, in their order."""
    docs, blocks, masks = (np.concatenate([np.empty(0, kind), *(p[i] for p in parts)]) for i, kind in enumerate(("<i8", "<i8", "<u8")))
    order = np.lexsort((blocks, docs))
    docs, blocks, masks = docs[order], blocks[order], masks[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (blocks[1:] != blocks[:-1])
    starts = np.flatnonzero(new)
    return docs[starts], blocks[starts], np.bitwise_or.reduceat(masks, starts) if len(starts) else masks


def _sent_home(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], homes: int) -> pa.Table:
    """Marks in packed arrays, one row for each home of documents: few rows, however many documents."""
    docs, blocks, masks = _united(parts)
    home = (mix(docs.view(_U)) % _U(homes)).astype(int)
    order = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[order], np.arange(homes + 1))
    rows = [(h, *(x[order[edges[h] : edges[h + 1]]].tobytes() for x in (docs, blocks, masks))) for h in range(homes) if edges[h] < edges[h + 1]]
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["home", "owners", "blocks", "masks"])


def _split(group: pa.Table) -> tuple[pa.Table, pa.Table]:
    kinds = group["kind"].to_numpy()
    return group.take(pa.array(np.flatnonzero(kinds == 0))), group.take(pa.array(np.flatnonzero(kinds == 1)))


def _gathered(run: Run, packed: DataFrame) -> DataFrame:
    """doc_id and its marks as array<struct<block, mask>>, stored."""

    def unpack(group: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(o, "<i8"), np.frombuffer(b, "<i8"), np.frombuffer(m, "<u8")) for o, b, m in zip(*(group[x].to_pylist() for x in ("owners", "blocks", "masks")))]
        docs, blocks, masks = _united(parts)
        new = np.ones(len(docs), bool)
        new[1:] = docs[1:] != docs[:-1]
        starts = np.flatnonzero(new)
        lists = pa.StructArray.from_arrays([pa.array(blocks), pa.array(masks.view("<i8"))], ["block", "mask"])
        return pa.table({"doc_id": pa.array(docs[starts]), "marks": pa.ListArray.from_arrays(pa.array(np.append(starts, len(docs)).astype(np.int32)), lists)})

    return run.keep(packed.groupBy("home").applyInArrow(unpack, "doc_id long, marks array<struct<block: long, mask: long>>"))


def _near(marks: DataFrame) -> DataFrame:
    """``marks`` with a broadcast hint if its counted size allows it."""
    size = marks.agg(F.coalesce(F.sum(24 + 32 * F.size("marks")), F.lit(0))).first()[0]
    return F.broadcast(marks) if size <= BROADCAST_BYTES else marks


def anchor_hits(docs: DataFrame, buckets: int, block: int = BLOCK, repeat: int = REPEAT) -> DataFrame:
    """Packed marks of segments around windows of ``block`` words that equal a block elsewhere, or in the same part of the input."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PART_BYTES):
            found, ids = words(batch["text"]), batch["doc_id"].to_numpy()
            runs, text_of, first = windows(found.hashes(), block), found.text_of, found.first
            at = np.arange(len(runs))
            own = text_of[: len(runs)]
            at = at[(at + block <= first[own + 1]) & (found.counts[own] >= repeat)]
            runs, own = runs[at], own[at]
            places = at - first[own]
            order = np.argsort(runs, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = runs[order][1:] != runs[order][:-1]
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            copies = np.diff(np.append(starts, len(order)))
            aligned = np.bitwise_or.reduceat((places[order] % block == 0).astype(np.uint32), starts) if len(starts) else np.empty(0, np.uint32)
            again = order[copies[group] > 1]
            marks = _marks(ids[own[again]], places[again] // SEGMENT)
            sent = order[starts]
            back = np.argsort(sent)
            sent, aligned = sent[back], aligned[back]
            prints = ((runs[sent] & _U(0x7FFFFFFF)).astype("<u4") << np.uint32(1)) | aligned
            bucket = (((runs[sent] >> _U(33)) * _U(buckets)) >> _U(31)).astype(int)
            yield _rows(bucket, buckets, Entries(ids[own[sent]], places[sent] // SEGMENT, prints), marks, int(ids[0]))

    def meet(group: pa.Table) -> pa.Table:
        sent, local = _split(group)
        entries = Entries.unpacked(sent, "<u4")
        order = np.argsort(entries.prints, kind="stable")
        ranked = entries.prints[order]
        new = np.ones(len(order), bool)
        new[1:] = (ranked[1:] >> 1) != (ranked[:-1] >> 1)
        starts = np.flatnonzero(new)
        ends = np.append(starts, len(order))[1:]
        good = (ends - starts > 1) & ((ranked[ends - 1] & 1) == 1) if len(starts) else np.empty(0, bool)
        hit = order[good[np.cumsum(new) - 1]] if len(starts) else order
        return _sent_home([*_settled(local), _marks(entries.owners[hit], entries.places[hit])], buckets)

    return docs.mapInArrow(probe, _PACKED).groupBy("bucket").applyInArrow(meet, _HOMED)


def repeated_windows(docs: DataFrame, buckets: int, repeat: int = REPEAT, block: int = BLOCK) -> DataFrame:
    """Packed marks, a bit for each window of ``repeat`` words that also starts earlier. ``docs`` has the anchor hits as ``marks``."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PART_BYTES):
            found, ids = words(batch["text"]), batch["doc_id"].to_numpy()
            hashes, first = found.hashes(), found.first
            row, segment = _bits(batch["marks"])
            # A hit at place p of the segment is inside the windows that start at p - (repeat - block) ... p.
            low = np.maximum(first[row] + segment * SEGMENT - (repeat - block), first[row])
            high = np.minimum(first[row] + segment * SEGMENT + SEGMENT, first[row + 1] - repeat + 1)
            some = high > low
            near = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(near, low[some], 1)
            np.add.at(near, high[some], -1)
            at = np.flatnonzero(np.cumsum(near) > 0)
            runs, other = windows(hashes, repeat), windows(mix(hashes), repeat)
            runs, other, own = runs[at] if len(at) else runs[:0], other[at] if len(at) else other[:0], found.text_of[at] if len(at) else at
            owners, places = ids[own], at - first[own]
            order = np.lexsort((places, owners, runs))
            new = np.ones(len(order), bool)
            new[1:] = runs[order][1:] != runs[order][:-1]
            earliest = order[new][np.cumsum(new) - 1] if len(order) else order
            late = (owners[order] != owners[earliest]) | (places[order] != places[earliest])
            marks = _marks(owners[order[late]], places[order[late]])
            sent = np.sort(order[new])
            bucket = (((other[sent] >> _U(33)) * _U(buckets)) >> _U(31)).astype(int)
            yield _rows(bucket, buckets, Entries(owners[sent], places[sent], runs[sent].astype("<u8")), marks, int(ids[0]))

    def meet(group: pa.Table) -> pa.Table:
        sent, local = _split(group)
        entries = Entries.unpacked(sent, "<u8")
        order = np.lexsort((entries.places, entries.owners, entries.prints))
        ranked = entries.prints[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        earliest = order[new][np.cumsum(new) - 1] if len(order) else order
        late = order[(entries.owners[order] != entries.owners[earliest]) | (entries.places[order] != entries.places[earliest])]
        return _sent_home([*_settled(local), _marks(entries.owners[late], entries.places[late])], buckets)

    return docs.mapInArrow(extend, _PACKED).groupBy("bucket").applyInArrow(meet, _HOMED)


def without_repeats(docs: DataFrame, repeat: int = REPEAT) -> DataFrame:
    """doc_id, n_words, n_removed, n_repeats, kept_text for each row of ``docs`` (doc_id, text, any other columns).

    n_repeats: maximal repeats removed; kept_text: the words left, joined by one space. Null
    and blank texts have no words. Rows with a null doc_id stay whole and repeat nothing. Rows
    of one doc_id are the same document; where their texts differ, a place repeated in one
    is removed in all of them. An empty table gives an empty result.
    """
    block = repeat // 2
    run = Run(docs.sparkSession, "repeats")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // BUCKET_BYTES
    hits = _gathered(run, anchor_hits(known, buckets, block, repeat))
    late = _gathered(run, repeated_windows(known.join(_near(hits), "doc_id"), buckets, repeat, block))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            row, place = _bits(batch["marks"])
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out: list[tuple] = []
            for i, text in enumerate(batch["text"].to_pylist()):
                own, starts = text.encode().split(), place[edges[i] : edges[i + 1]]
                n, repeats, kept = len(own), 0, own
                starts = starts[starts + repeat <= n]
                if len(starts):
                    near = np.zeros(n + 1, np.int64)
                    near[starts] += 1
                    np.add.at(near, starts + repeat, -1)
                    covered = np.cumsum(near)[:n] > 0
                    repeats = int(np.count_nonzero(np.diff(np.concatenate([[0], covered.astype(int)])) == 1))
                    kept = [own[k] for k in np.flatnonzero(~covered).tolist()]
                out.append((n, n - len(kept), repeats, b" ".join(kept).decode()))
            kinds = [pa.int64()] * 3 + [pa.large_string()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "n_words", "n_removed", "n_repeats", "kept_text"])

    return docs.join(_near(late), "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(cut, "doc_id long, n_words long, n_removed long, n_repeats long, kept_text string")


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = without_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
    SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM words WHERE len(w) >= 20),
windows AS (SELECT doc_id, p, hash(array_to_string(w[p:p + 19], ' ')) AS h, md5(array_to_string(w[p:p + 19], ' ')) AS m FROM starts),
ranked AS (
    SELECT doc_id, p, row_number() OVER (PARTITION BY h, m ORDER BY doc_id, p) AS k FROM windows),
covered AS (
    SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM ranked WHERE k > 1),
lists AS (SELECT doc_id, list(i) AS gone FROM covered GROUP BY doc_id),
kept AS (
    SELECT doc_id, len(w) AS n,
        [w[i] FOR i IN range(1, len(w) + 1) IF gone IS NULL OR NOT list_contains(gone, i)] AS k
    FROM words LEFT JOIN lists USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
