"""Words of many texts at once: numpy over the buffers of an Arrow string column, without a Python object per text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the operators here count it: the space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_MOD = 1 << 64
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 1 << 20)
        _powers = np.full(n, _BASE, np.uint64)
        _inverses = np.full(n, pow(_BASE, -1, _MOD), np.uint64)
        _powers[0] = _inverses[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
        np.multiply.accumulate(_inverses, out=_inverses)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type) and not pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches that hold about `limit` bytes of text each (one row at least), with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = texts(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            last = min(last, batch.num_rows)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word, in order."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] = word[cuts]
    end[cuts - 1] = word[cuts - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offsets, s, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, never 0: a polynomial's prefix sums, divided by the power at the start, then mixed."""
    _grow(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=prefix[1:])
    h = (prefix[end] - prefix[start]) * _inverses[start]
    h = mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.where(h == 0, np.uint64(1), h)


def windows(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of k hashes that lies in one row."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        g = g * np.uint64(0x9FB21C651E98DF25) + h[j : len(h) - k + 1 + j]
    inside = row[: len(h) - k + 1] == row[k - 1 :]
    return mix(g[inside]), row[: len(h) - k + 1][inside]


class HashIndex:
    """64-bit keys to the order in which they came, as open addressing in numpy arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.keys, self.at = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it isn't there."""
        shift, mask = np.uint64(64 - self.bits), (1 << self.bits) - 1
        slot = (h >> shift).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.at[slot], np.int32(-1))
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            key = self.keys[slot[left]]
            hit = key == h[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Adds keys that are distinct and not there yet."""
        while (self.count + len(h)) * 2 > 1 << self.bits:
            old, order = self.keys[self.keys != 0], self.at[self.keys != 0]
            self.bits += 1
            self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self._put(old, order)
        self._put(h, np.arange(self.count, self.count + len(h), dtype=np.int32))
        self.count += len(h)

    def _put(self, h: np.ndarray, order: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = h[free]
            done = self.keys[slot[left]] == h[left]
            self.at[slot[left[done]]] = order[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & mask
