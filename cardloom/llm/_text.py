"""Vectorised text primitives shared by the corpus operators.

Everything here works on one Arrow string column at a time, cut into blocks of about ``BLOCK_BYTES`` so the
numpy temporaries of a task stay small however many rows an Arrow batch holds.  A block never splits a document.
Hashes are 64 bit and depend on content only, so they agree between tasks, executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def keyed(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed)) * _U(0x9E3779B97F4A7C15))


def byte_class(chars: bytes, base: bool = False) -> np.ndarray:
    """Boolean table of 256 entries, ``not base`` at the given bytes."""
    table = np.full(256, base)
    table[list(chars)] = not base
    return table


WORD_BYTE = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d", base=True)
_CASED = np.arange(1, 257, dtype=np.uint64)
_LOWER = _CASED.copy()
_LOWER[65:91] = _CASED[97:123]
# Polynomial hashes are taken modulo this prime; modulo a power of two some texts collide whatever the base.
_PRIME = _U((1 << 61) - 1)
_BASE = 0x1545F4914F6CDD1D
_powers: list[np.ndarray] = [np.ones(1, np.uint32), np.zeros(1, np.uint32), np.ones(1, np.uint64)]


def _fold(x: np.ndarray) -> np.ndarray:
    """Modulo the prime."""
    x = (x & _PRIME) + (x >> _U(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo the prime of numbers below it, by halves of 31 bits."""
    half = _U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> _U(31), a & half, b >> _U(31), b & half
    middle = a1 * b0 + a0 * b1
    low = (middle & _U((1 << 30) - 1)) << _U(31)
    return _fold((a1 * b1 << _U(1)) + (middle >> _U(30)) + low + _fold(a0 * b0))


def _series(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of the base modulo the prime."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, _times(out, np.full(len(out), pow(base, len(out), int(_PRIME)), np.uint64))))
    return out[:n]


def _tables(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of the base, their low 32 and their high bits, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 3))
        power = _series(_BASE, size)
        _powers[:] = [power.astype(np.uint32), (power >> _U(32)).astype(np.uint32), _series(pow(_BASE, -1, int(_PRIME)), size)]
    return _powers


class Block:
    """Documents ``first`` .. ``last`` of a column as one byte array with offsets."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.rows = len(offsets) - 1

    def runs(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes in ``table``; no run crosses a document."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = table[self.data]
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, inside[1:]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before[cuts] = False
        after[cuts - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def prefix(self, lower: bool = False) -> np.ndarray:
        """Two rows of prefix sums from which :meth:`hashes` takes the hash of any byte range."""
        n = len(self.data)
        out = np.zeros((2, n + 1), np.uint64)
        values = (_LOWER if lower else _CASED)[self.data]
        for k, power in enumerate(_tables(n + 1)[:2]):
            np.cumsum(values * power[:n], out=out[k, 1:])
        return out

    def hashes(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit content hash of each byte range; sums of ranges above 4 MB wrap, which is as well a hash of the content."""
        low, high = (row[ends] - row[starts] for row in prefix)
        value = _fold(_times(_fold(high), np.full(len(high), 1 << 32, np.uint64)) + _fold(low))
        value = _times(value, _tables(len(self.data) + 1)[2][starts])
        return mix(value + (ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the \\n-split lines, and the index of each document's first line (one more than rows)."""
        breaks = np.flatnonzero(self.data == 10)
        per_doc = np.searchsorted(breaks, self.offsets)
        first = per_doc + np.arange(self.rows + 1)  # a document has one line more than line breaks
        starts = np.empty(len(breaks) + self.rows, np.int64)
        ends = np.empty(len(breaks) + self.rows, np.int64)
        is_first = np.zeros(len(starts), bool)
        is_first[first[:-1]] = True
        starts[is_first] = self.offsets[:-1]
        starts[~is_first] = breaks + 1
        is_last = np.zeros(len(starts), bool)
        is_last[first[1:] - 1] = True
        ends[is_last] = self.offsets[1:]
        ends[~is_last] = breaks
        return starts, ends, first

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are set in ``flags`` (one entry a byte)."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column's documents, null as empty, in blocks of about ``size`` bytes and at least one document."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield Block(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def combine(hashes: np.ndarray, width: int, seed: int = 29) -> np.ndarray:
    """Hash of every window of ``width`` consecutive values (fewer values: none)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k, factor in enumerate(keyed(width, seed) | _U(1)):
        out += hashes[k : k + n] * factor
    return mix(out)


def ranges_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[i]:first[i+1]]`` for each i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
