"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Words are runs of bytes that are no separators, so a whole chunk of texts is cut and hashed by a
few array operations; Python never loops over words.  Chunks hold whole rows, of about
``CHUNK_BYTES`` together, which bounds memory whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: The separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators that leave only ASCII letters and digits and all bytes beyond ASCII.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """The words of one chunk: ``start``/``end`` byte places, ``hash``, and ``first[row]`` : word range of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, lower: bool = True):
        n = len(data)
        inside = ~separators[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self._up, self._down = up, _ = powers(n + 1)
        codes = (_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes * up[:n], out=self._sums[1:])

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of the lower-cased bytes from ``start`` to ``end``: equal bytes, equal hash, wherever they stand."""
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + np.uint64(0x632BE59BD9B4E019))

    def joined_hash(self, spans: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """``span_hash`` of what the spans hold, one after the other."""
        total, size = np.zeros(len(spans[0][0]), np.uint64), np.zeros(len(spans[0][0]), np.int64)
        for start, end in spans:
            total += (self._sums[end] - self._sums[start]) * self._down[start] * self._up[size]
            size += end - start
        return mix(total + np.uint64(0x632BE59BD9B4E019))

    @property
    def hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of each row, their row limits, their first words and their numbers of words.

    A row with fewer words, but one at least, has its whole sequence as its one shingle.
    """
    h, count, first = words.hash, words.count, words.first
    out = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(out)])
    rows = np.repeat(np.arange(len(count)), out)
    place = first[:-1][rows] + (np.arange(at[-1]) - at[:-1][rows])
    width = np.minimum(count, k)[rows]
    acc = mix(width.astype(np.uint64))
    for i in range(k):
        have = width > i
        step = h[np.minimum(place + i, max(len(h) - 1, 0))] if len(h) else np.zeros(0, np.uint64)
        acc = np.where(have, mix(acc * np.uint64(0xD6E8FEB86659FD93) + step), acc)
    return acc, at, place, width
