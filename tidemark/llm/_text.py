"""Vectorised words and hashes of Arrow string columns.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. Hashes are 64-bit polynomial hashes over byte (or word) sequences with a
finaliser; they are the same on every executor, and the chance that two given sequences collide
is about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240131)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i modulo 2**64 for i below n; grown by doubling and kept per process."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            base = np.full(size, _BASE, dtype=np.uint64)
            base[0] = 1
            _powers = np.cumprod(base, dtype=np.uint64)
            base[1:] = pow(_BASE, -1, 2**64)
            _inverses = np.cumprod(base, dtype=np.uint64)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ranges(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of values[first[i]:last[i]] for each i."""
    power, inverse = _power_tables(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * power[: len(values)], out=total[1:])
        return mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))


@dataclass
class Words:
    """The words of some texts: byte positions, the first word of each text, and their hashes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        """The text's number for each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on; only those that `whole(k)` marks lie in one text."""
        first = np.arange(max(0, len(self.hash) - k + 1))
        return ranges(self.hash, first, first + k)

    def whole(self, k: int) -> np.ndarray:
        """For each k-gram of grams(k): whether it ends in the text in which it starts."""
        first = np.arange(max(0, len(self.hash) - k + 1))
        return first + k <= self.bounds[1:][self.doc()[: len(first)]]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch whose texts have about `size` bytes together, so that work arrays stay small."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of texts that lie one after another; a word never reaches over the end of its text."""
    if lower:
        data = LOWER[data]
    n = len(data)
    solid = ~SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:n]
    ends[:-1] &= ~solid[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), ranges(BYTE[data], start, end))


def joined(parts: Words, keep: np.ndarray) -> list[bytes]:
    """Per text its words for which keep is true, joined by one space."""
    length = (parts.end - parts.start + 1) * keep
    ends = np.cumsum(length)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, dtype=np.uint8)
    if len(out):
        shift = np.repeat((parts.start - (ends - length))[keep], length[keep])
        at = np.arange(len(out)) + shift
        text = np.append(parts.data, np.uint8(32))
        blank = np.zeros(len(out), dtype=bool)
        blank[ends[keep] - 1] = True
        out = np.where(blank, np.uint8(32), text[np.minimum(at, len(parts.data))])
    edges = np.append(0, ends)[parts.bounds]
    raw = out.tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
