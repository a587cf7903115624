"""Words of many texts as NumPy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D, the same split as
``bytes.split()``. Hashes are 64-bit and depend on the bytes alone, so they agree
between workers and runs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_RATIO = pow(0x9E3779B97F4A7C15, 1, 1 << 64)
_INVERSE = pow(_RATIO, -1, 1 << 64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.ones(256, bool)
_PLAIN[128:] = _PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = False
_VALUES = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=_U, endpoint=True)
_LOWERED = _VALUES.copy()
_LOWERED[65:91] = _VALUES[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[int, np.ndarray] = {}
#: Words are hashed in runs of about so many bytes, so that one very long text needs no more memory than many short ones.
_SPAN = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base; each worker keeps the longest run it has needed, up to a megabyte of text."""
    have = _POWERS.get(base, np.ones(1, _U))
    while len(have) < n:
        have = np.concatenate([have, have[: max(n - len(have), 1 << 18)] * _U(pow(base, len(have), 1 << 64))])
    if len(have) <= 1 << 20:
        _POWERS[base] = have
    return have[:n]


_RESIDENT: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], object]) -> object:
    """The large table this worker keeps between tasks: one at a time, as a worker serves one operator after another."""
    if key not in _RESIDENT:
        vacate()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def vacate() -> None:
    """Let go of the table of an operator that is done."""
    if _RESIDENT:
        _RESIDENT.clear()
        trim()


def trim() -> None:
    """Give free memory back to the system, where the C library can; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 20, nulls: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``max_bytes`` of text, or of one row where a text is longer. Null texts become empty, or stay with ``nulls``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        column = batch.column(at).cast(pa.large_string())
        column = column if nulls else column.fill_null("")
        batch = batch.set_column(at, pa.field(text, pa.large_string()), column)
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + max_bytes, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    trim()


@dataclass
class Words:
    data: np.ndarray  # all bytes
    offsets: np.ndarray  # of the texts in data
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    first: np.ndarray  # of each text, its first word; one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """One 64-bit hash for each word; ``lower`` takes A-Z as a-z."""
        if not len(self.starts):
            return np.empty(0, _U)
        out, values, at = np.empty(len(self.starts), _U), _LOWERED if lower else _VALUES, 0
        while at < len(out):
            base = int(self.starts[at])
            stop = max(at + 1, int(np.searchsorted(self.ends, base + _SPAN, "right")))
            data = self.data[base : int(self.ends[stop - 1])]
            total = np.empty(len(data) + 1, _U)
            total[0] = 0
            np.cumsum(values[data] * _powers(_RATIO, len(data)), out=total[1:])
            start = self.starts[at:stop] - base
            out[at:stop] = mix((total[self.ends[at:stop] - base] - total[start]) * _powers(_INVERSE, len(data))[start])
            at = stop
        return out


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def plain_words(column: pa.Array) -> Words:
    """Runs of ASCII letters, digits and all bytes beyond ASCII."""
    return words(column, _PLAIN)


def words(column: pa.Array, separator: np.ndarray = _SEPARATOR) -> Words:
    data, offsets = buffer(column)
    inside = ~separator[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive hashes, by doubling: ``len(hashes) - n + 1`` of them."""
    if len(hashes) < n:
        return np.empty(0, _U)
    whole, have = hashes, 1
    for bit in bin(n)[3:]:
        whole = whole[:-have] * _U(pow(_RATIO, have, 1 << 64)) + whole[have:]
        have *= 2
        if bit == "1":
            whole = whole[:-1] * _U(_RATIO) + hashes[have:][: len(whole) - 1]
            have += 1
    return mix(whole + _U(n))
