"""Vectorised word and window hashing over Arrow string columns.

Everything works on the UTF-8 bytes of a batch at once: the separators are
ASCII, so cutting bytes equals cutting code points.  Hashes are 64-bit
polynomial sums over random byte values, finalised by a bijective mixer.
Null texts count as empty.  Work is cut into blocks of about ``BLOCK`` bytes so
that memory follows the block (or the longest single text), not the batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_HASH_BLOCK = 1 << 16  # bytes hashed at a time, so that what is in work stays in the cache
_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95
_INV_PRIME = pow(_PRIME, -1, 1 << 64)
_INV_STEP = pow(_STEP, -1, 1 << 64)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives free memory back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (murmur-style xor-multiply)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


@functools.cache
def _byte_values(fold: bool, family: int = 0) -> np.ndarray:
    """A random odd-ish value for each byte; with fold, A-Z get those of a-z.
    Families of hashes are independent of one another."""
    table = mix(np.arange(1, 257, dtype=_U) * _U(_PRIME) + _U(family << 40))
    if fold:
        table[65:91] = table[97:123]
    return table


@functools.cache
def _separators() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return table


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1024), base, _U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and len + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes together are about `most`, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


class Words:
    """The words of a run of texts.

    start, end: byte positions of each word; first: index of each text's first
    word, and the number of words at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, n = data, len(data)
        word = ~_separators()[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = True, True
            before[1:], after[:-1] = ~word[:-1], ~word[1:]
        self.start = np.flatnonzero(word & (before | edge[:-1]))
        self.end = np.flatnonzero(word & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self, fold: bool = False, family: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; with fold, A-Z are taken as a-z."""
        return span_hashes(self.data, self.start, self.end, fold, family)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False, family: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    out = np.empty(len(start), _U)
    values, at = _byte_values(fold, family), 0
    while at < len(out):
        base = start[at]
        to = max(int(np.searchsorted(end, base + _HASH_BLOCK, "right")), at + 1)
        span = data[base : end[to - 1]]
        total = np.empty(len(span) + 1, _U)
        total[0] = 0
        np.cumsum(values[span] * powers(_PRIME, len(span)), out=total[1:])
        s, e = start[at:to] - base, end[at:to] - base
        out[at:to] = mix((total[e] - total[s]) * powers(_INV_PRIME, len(span))[s] + (e - s).astype(_U))
        at = to
    return out


def spans_of(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... (count of them) for each pair, one after another."""
    ends = np.cumsum(count, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not len(begin) or int(begin.max()) < (1 << 31) - total) else np.int64
    shift = (begin - (ends - count)).astype(kind)
    out = np.repeat(shift, count)
    out += np.arange(total, dtype=kind)
    return out


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each window of `size` neighbours; windows may cross texts."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, _U)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum(hashes * powers(_STEP, n), out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(_INV_STEP, n)[: n - size + 1] + _U(size))


def spread(first: np.ndarray) -> np.ndarray:
    """The text's index of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def as_long(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed numbers, for Spark's long."""
    return values.view(np.int64)
