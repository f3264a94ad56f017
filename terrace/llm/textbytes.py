"""Words, lines and n-gram hashes of a block of texts, as numpy arrays over UTF-8 bytes.

A block holds the bytes of consecutive texts of one Arrow batch; a text is
never split over blocks, so every count covers the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: 64 random bits for each byte value, and an odd base with its inverse modulo 2**64.
BYTE_BITS = _RNG.integers(0, 2**64, 256, dtype=U64)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((BASE, BASE_INVERSE)):
            p = np.full(n, U64(b))
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes so that each output bit depends on all input bits."""
    x = (x ^ (x >> U64(31))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(29))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


class Block:
    """Consecutive texts: ``data`` their bytes, ``off`` the start of each and the end."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n = data, off, len(off) - 1
        self._sum: np.ndarray | None = None

    def prefix(self) -> np.ndarray:
        """Prefix sums of the polynomial hash; any span's hash is a difference of two."""
        if self._sum is None:
            up, _ = _powers(len(self.data) + 1)
            self._sum = np.zeros(len(self.data) + 1, U64)
            np.cumsum(BYTE_BITS[self.data] * up[:-1], out=self._sum[1:])
        return self._sum

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span; equal bytes, equal hash, wherever they stand."""
        total = self.prefix()
        _, down = _powers(len(self.data) + 1)
        return mix((total[end] - total[start]) * down[start])

    def of(self, start: np.ndarray) -> np.ndarray:
        """The text that each (ascending) start position falls in."""
        return np.repeat(np.arange(self.n), np.diff(np.searchsorted(start, self.off)))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes that aren't white space."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        solid = ~IS_SPACE[self.data]
        full = np.flatnonzero(np.diff(self.off))
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        head, tail = self.off[:-1][full], self.off[1:][full] - 1
        first[head], last[tail] = solid[head], solid[tail]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text of the lines between line feeds; an empty text has one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        per = np.diff(np.searchsorted(breaks, self.off)) + 1
        doc = np.repeat(np.arange(self.n), per)
        first = np.cumsum(per) - per
        start, end = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
        inner = np.ones(len(doc), bool)
        inner[first] = False
        start[inner], start[first] = breaks + 1, self.off[:-1]
        inner[:] = True
        inner[first + per - 1] = False
        end[inner], end[first + per - 1] = breaks, self.off[1:]
        return start, end, doc

    def counts(self, flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many set flags each span holds."""
        total = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum(flags, out=total[1:], dtype=np.int32)
        return (total[end] - total[start]).astype(np.int64)


def blocks(column: pa.Array, most_bytes: int = 1 << 20, most_rows: int = 256) -> Iterator[tuple[int, Block]]:
    """(first row, block) over a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, values = column.buffers()
    off = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(off, off[at] + most_bytes, "right")) - 1
        to = min(max(to, at + 1), at + most_rows, len(column))
        yield at, Block(data[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to


def repeats(key: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: does its (group, key) occur again anywhere; does it occur earlier. 64-bit keys."""
    mixed = mix(key + group.astype(U64) * U64(0xD6E8FEB86659FD93))
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = np.zeros(len(key) + 1, bool)
    np.equal(ranked[1:], ranked[:-1], out=same[1:-1]) if len(key) else None
    again, earlier = np.empty(len(key), bool), np.empty(len(key), bool)
    again[order], earlier[order] = same[1:] | same[:-1], same[:-1]
    return again, earlier
