"""Words and their hashes, straight from the bytes of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 2 << 20
SOLID = np.ones(256, dtype=bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUE = mix(FOLD.astype(np.uint64) + _U(1))
_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), _U(_BASE))
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers[:n]


class Words(NamedTuple):
    """The words of consecutive texts: ``hash`` of each (A-Z lower-cased),
    ``start`` and ``end`` in ``raw``, and ``first``: text i has the words
    first[i] to first[i + 1]."""

    raw: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def split(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts raw[offsets[i]:offsets[i + 1]]."""
    solid = SOLID[raw]
    before = np.empty_like(solid)
    before[:1], before[1:] = False, solid[:-1]
    bounds = offsets[(offsets > 0) & (offsets < len(raw))]
    before[bounds] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1:], after[:-1] = False, solid[1:]
    after[bounds - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    first = np.searchsorted(start, offsets)
    if not len(start):
        return Words(raw, np.zeros(0, np.uint64), start, end, first)
    size = end - start
    head = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(head, size)
    value = _VALUE[raw[solid]] * _power(int(size.max()))[place]
    return Words(raw, mix(np.add.reduceat(value, head) + size.astype(np.uint64) * _U(_BASE)), start, end, first)


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(a, b, words of the texts a to b) over a text column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b, split(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the ``width``-word shingles of each text in order; a
    text of fewer words has one, its whole sequence, and none without words."""
    h, first = words.hash, words.first
    count = np.diff(first)
    size = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out_first = np.concatenate([[0], np.cumsum(size)])
    if not out_first[-1]:
        return np.zeros(0, np.uint64), out_first
    begin = np.repeat(first[:-1] - out_first[:-1], size) + np.arange(out_first[-1])
    length = np.repeat(np.minimum(count, width), size)
    out = length.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    for k in range(width):
        within = length > k
        out[within] = mix(out[within] * _U(0xA0761D6478BD642F) + h[begin[within] + k])
    return out, out_first
