"""Secrets in texts, also under layers of encoding.

A text is scanned as it stands. Then a worklist unwraps it: percent escapes, Unicode
escapes, base64 runs and compressed data are decoded, each layer is scanned by the same
detectors and unwrapped again, until nothing new appears. A layer met before at the same
place is not entered again. Every character of a layer knows the span of the original
text it came from, so all spans are given in code points of the original.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.tables import table
from meterline.llm.text_arrays import pieces, vacate

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_UNPRINTABLE = bytes(b for b in range(256) if not (32 <= b < 127 or b in b"\t\r\n"))
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_ONE_ESCAPE = re.compile(r"\\[uUx]([0-9A-Fa-f]+)")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{18,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,}+\r?\n)++[A-Za-z0-9+/]+={0,2}")
_SEPARATOR = re.compile(r"[/_+-]")
_URL_SAFE = str.maketrans("-_", "+/")
#: Compressed data is inflated and scanned in parts of this size. Each part has the end of the last before it: so much of it, or
#: the whole of an encoded run that is still open there, up to a part. A longer run is cut, and found again by its alignment.
PART_BYTES, OVERLAP = 4 << 20, 4096
_RUN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\\"


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every match that passes, leftmost and non-overlapping within a kind."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


@dataclass
class Layer:
    text: str
    starts: np.ndarray  # of each character, in the original text
    ends: np.ndarray

    def at(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.ends[end - 1])

    def key(self) -> bytes:
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass") + self.starts.tobytes()[:8] + self.ends.tobytes()[-8:], digest_size=16).digest()


def _replaced(layer: Layer, runs: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer:
    """The layer with each run [start, end) replaced by its decoded characters (character, start, end)."""
    texts, starts, ends, done = [], [], [], 0
    for start, end, chars in runs:
        texts += [layer.text[done:start], "".join(c for c, _, _ in chars)]
        starts += [layer.starts[done:start], layer.starts[[a for _, a, _ in chars]]]
        ends += [layer.ends[done:start], layer.ends[[b - 1 for _, _, b in chars]]]
        done = end
    return Layer("".join([*texts, layer.text[done:]]), np.concatenate([*starts, layer.starts[done:]]), np.concatenate([*ends, layer.ends[done:]]))


def _percent(layer: Layer) -> Iterator[Layer]:
    runs = []
    for m in _PERCENT.finditer(layer.text):
        chars, at = [], m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            lone = 0xDC80 <= ord(c) < 0xDD00  # a byte that is not UTF-8 stands for itself
            chars.append((chr(ord(c) - 0xDC00) if lone else c, at, at + 3 * (1 if lone else len(c.encode("utf-8")))))
            at = chars[-1][2]
        runs.append((m.start(), m.end(), chars))
    if runs:
        yield _replaced(layer, runs)


def _escapes(layer: Layer) -> Iterator[Layer]:
    runs = []
    for m in _ESCAPE.finditer(layer.text):
        units = [(int(x[1], 16), m.start() + x.start(), m.start() + x.end()) for x in _ONE_ESCAPE.finditer(m[0])]
        chars, i = [], 0
        while i < len(units):
            code, a, b = units[i]
            if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
                code, b, i = 0x10000 + ((code - 0xD800) << 10) + units[i + 1][0] - 0xDC00, units[i + 1][2], i + 1
            chars.append((chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "�", a, b))
            i += 1
        runs.append((m.start(), m.end(), chars))
    if runs:
        yield _replaced(layer, runs)


def _decompressor(head: bytes) -> Callable | None:
    """What inflates data that begins so."""
    if head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] & 0x8F == 8 and (head[0] * 256 + head[1]) % 31 == 0):
        return lambda: zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\x00" or head[:3] == b"\x5d\x00\x00":
        return lzma.LZMADecompressor
    return None


def _inflated(parts: Iterable[bytes], new: Callable) -> Iterator[bytes]:
    """Inflated parts of bounded size, member after member; what follows the last whole member is left."""
    d, fed = new(), False
    for feed in parts:
        while feed or fed:
            if d.eof:
                feed = (d.unused_data or feed).lstrip(b"\0") if fed else feed
                d, fed = new(), False
                if not feed:
                    break
            try:
                out = d.decompress(feed, PART_BYTES)
            except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
                return
            fed = True
            if out:
                yield out
            if d.eof:
                feed = b""
                continue
            feed = getattr(d, "unconsumed_tail", b"")
            if not feed and len(out) < PART_BYTES and getattr(d, "needs_input", True):
                break


def _raw_deflated(raw: bytes) -> Iterator[bytes]:
    """Deflated data without any header: taken for that only if it goes through to its end, or fills a part."""
    d = zlib.decompressobj(-15)
    try:
        first = d.decompress(raw, PART_BYTES)
    except zlib.error:
        return
    if first and (len(first) == PART_BYTES or (d.eof and not d.unused_data)):
        yield from _inflated([raw], lambda: zlib.decompressobj(-15))


def _reading(raw: bytes, whole: bool) -> str:
    """Bytes as text: UTF-16 if it looks like it, UTF-8 if it is, otherwise each byte a character. The ends of a part may cut a character."""
    some = raw[:4096]
    half = max(len(some) // 2, 1)
    for zeros, kind in ((some[1::2].count(0), "utf-16-le"), (some[::2].count(0), "utf-16-be")):
        if zeros > 0.4 * half and len(some) >= 8:
            return raw.decode(kind, "ignore")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as error:
        return raw.decode("utf-8", "ignore") if not whole and _plain(raw[error.start : error.start + 4096]) >= 0.9 else raw.decode("latin-1")


def _plain(raw: bytes) -> float:
    """The share of printable ASCII and white space in the first bytes."""
    some = raw[:4096]
    return len(some.translate(None, _UNPRINTABLE)) / len(some) if some else 0.0


def _from_bytes(raw: Iterable[bytes], start: int, end: int) -> Iterator[Layer]:
    """Layers of decoded bytes, given in parts: what they inflate to, as deep as it goes, or the text they are."""
    parts, head = iter(raw), b""
    for part in parts:
        head += part
        if len(head) >= 64:
            break
    new, before, whole = _decompressor(head), b"", True
    if new:
        inside = _inflated(chain([head], parts), new)
        first = next(inside, None)
        if first is not None:
            yield from _from_bytes(chain([first], inside), start, end)
            return
    for part in chain([head], parts):
        known = before + part
        text = _reading(known, whole)
        if text:
            yield Layer(text, np.full(len(text), start), np.full(len(text), end))
        tail = known[-PART_BYTES:]
        size = max(len(tail) - len(tail.rstrip(_RUN)), OVERLAP)
        before, whole = known[-(size + size % 2) :], False


def _decoded(run: str) -> bytes:
    run = run[: len(run) - (len(run) % 4 == 1)]
    return binascii.a2b_base64(run.translate(_URL_SAFE) + "=" * (-len(run) % 4))


def _base64(layer: Layer) -> Iterator[Layer]:
    """A run is read from its start; where that gives no plain text, also from the places at which a prefix glued to it may end."""
    runs = [(m.start(), m.end(), m[0].rstrip("=")) for m in _BASE64.finditer(layer.text)]
    runs += [(m.start(), m.end(), re.sub(r"\s", "", m[0]).rstrip("=")) for m in _WRAPPED.finditer(layer.text)]
    for start, end, run in runs:
        at, first = layer.at(start, end), _decoded(run)
        if _plain(first) >= 0.95:
            yield from _from_bytes([first], *at)
            continue
        found = False
        for skip in sorted({0, 1, 2, 3, *(m.end() for m in _SEPARATOR.finditer(run[:16]))}):
            raw = _decoded(run[skip:]) if skip else first
            if _decompressor(raw) or _plain(raw) >= 0.7:
                found = True
                yield from _from_bytes([raw], *at)
        if not found:
            yield from _from_bytes([first], *at)
            yield from _from_bytes(_raw_deflated(first), *at)


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    if "%" in layer.text:
        yield from _percent(layer)
    if "\\" in layer.text:
        yield from _escapes(layer)
    yield from _base64(layer)


def scan_layers(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans (base ones and those found under layers), and the number of layers entered."""
    base = scan(text)
    spans, seen, entered = set(base), set(), 0
    stack = [_unwrapped(Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1)))] if text else []
    while stack:
        layer = next(stack[-1], None)
        if layer is None:
            stack.pop()
            continue
        key = layer.key()
        if key in seen or not layer.text:
            continue
        seen.add(key)
        entered += 1
        for start, kind, end in scan(layer.text):
            a, b = layer.at(start, end)
            spans.add((a, kind, b))
        stack.append(_unwrapped(layer))
    return base, sorted(spans), entered


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    out, done = [], 0
    for a, _, b in spans:
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, any other columns).

    doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers, clean_text (spans
    replaced by ``mark``). A null or empty text has no spans and stays empty; a null
    doc_id stays null. Repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows: list[tuple] = []
            for text in batch["text"].to_pylist():
                base, spans, layers = scan_layers(text)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), layers, redacted(text, spans, mark) if spans else text))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.large_string()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "clean_text"],
            )

    out = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, clean_text string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, out)


def without_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets masked in the text, and n_chars, where there is one, counted anew. Null texts stay null."""
    others = [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in pieces(batches, "text", nulls=True):
            at = batch.schema.get_field_index("text")
            texts = [t if t is None else redacted(t, scan_layers(t)[1], mark) for t in batch["text"].to_pylist()]
            yield batch.set_column(at, pa.field("text", batch.schema.field(at).type), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if any(f.name == "n_chars" for f in others) else out


def query(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(table(spark, folder, "documents").select("doc_id", "text")).drop("clean_text")
