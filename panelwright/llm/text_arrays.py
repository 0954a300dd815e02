"""Vectorised token, hash and window arithmetic over Arrow text columns, for operators that run in Python tasks.

Texts are worked on in runs of a few MB, so memory follows the run (or one text, if that is longer), not the
size of a batch or partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

RUN_BYTES = 2_000_000
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_SEED = np.random.default_rng(20240501)
BYTE_KEYS = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(65535, _BASE)]))
_HIGH = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.repeat(_LOW[-1:] * _BASE, 65535)]))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x)])) for x in (_BASE, inverse))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse (mod 2 ** 64), at least ``size`` of each."""
    return _powers(1 << max(16, int(size - 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values, so sums of products spread over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of consecutive rows; nulls are empty; offsets start at 0."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and len(texts) else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of ``inside`` bytes; none crosses a text border."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the disjoint, ascending byte spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(size.sum()) - np.repeat(first, size)
    terms = BYTE_KEYS[data[np.repeat(starts, size) + place]]
    terms *= _LOW[place & 65535]
    if size.max() > 65536:
        terms *= _HIGH[(place >> 16) & 65535]
    return mix(np.add.reduceat(terms, first) + size.astype(np.uint64))


def windows(hashes: np.ndarray, rows: np.ndarray, width: int, lead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(first word, hash)`` of every run of ``width`` words of one row; a shorter row gives one of all its words.

    ``lead``: second hashes of the words; only runs whose first word has another one there, which is then used.
    """
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(rows)]]))
    row_size = np.repeat(sizes, sizes)
    place = np.arange(len(rows)) - np.repeat(starts, sizes)
    wanted = (place + width <= row_size) | (place == 0)
    first = np.flatnonzero(wanted if lead is None else wanted & (lead != hashes))
    total = np.zeros(len(first), np.uint64)
    for j in range(width):
        within = place[first] + j < row_size[first]
        own = hashes if j or lead is None else lead
        total += np.where(within, own[np.minimum(first + j, len(hashes) - 1)] * _LOW[3 * j + 1], np.uint64(0))
    return first, mix(total + np.minimum(row_size[first], width).astype(np.uint64))


def coded(data: np.ndarray, inside: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of each word among the distinct ones, and these; the words are the runs of ``inside`` bytes, in order."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    kinds = spans.dictionary_encode()
    return kinds.indices.to_numpy(), kinds.dictionary


def binary_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hash of each non-empty binary value."""
    values = values.cast(pa.large_binary())
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8) if len(values) else np.zeros(0, np.uint8)
    return span_hashes(data, ends[:-1], ends[1:])
