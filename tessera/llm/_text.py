"""Vectorised text helpers that run inside Arrow tasks.

Texts arrive as Arrow string columns.  Their UTF-8 bytes are one contiguous
buffer, so words, rolling hashes and windows are computed with numpy over
slices of a few MB, never one Python call per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes handled at once.  A single longer text is one slice of its own.
SLICE_BYTES = 1 << 19

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

#: ASCII upper case to lower case, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of 256 entries, true within the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: `[^\x20\x09-\x0D]` on bytes.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` on lower-cased bytes.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(29))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.ones(size, dtype=U)
        done = 1
        while done < size:
            step = U(pow(base, done, 1 << 64))
            more = min(done, size - done)
            have[done : done + more] = have[:more] * step
            done += more
        if n > 4 * SLICE_BYTES:
            return have[:n]
        _POWERS[base] = have
    return have[:n]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches; memory that Arrow holds back is released between them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


class Words:
    """Words of a slice: starts, ends, and where each text's words begin in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> None:
        self.bytes = LOWER[data]
        n = len(data)
        inside = kept[self.bytes]
        fresh = np.zeros(n + 1, dtype=bool)
        fresh[offsets] = True
        begins, stops = inside.copy(), inside.copy()
        if n:
            cut = fresh[1:n]
            begins[1:] &= ~inside[:-1] | cut
            stops[:-1] &= ~inside[1:] | cut
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.of = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.bytes)
        total = np.zeros(n + 1, dtype=U)
        np.cumsum(_BYTE[self.bytes] * _powers(_BASE, n), out=total[1:])
        raw = (total[self.ends] - total[self.starts]) * _powers(_BASE_INVERSE, n + 1)[self.starts]
        return mix(raw + (self.ends - self.starts).astype(U) * U(0x9FB21C651E98DF25))


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each piece [start, end)."""
    n = len(data)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(_BYTE[data] * _powers(_BASE, n), out=total[1:])
    raw = (total[ends] - total[starts]) * _powers(_BASE_INVERSE, n + 1)[starts]
    return mix(raw + (ends - starts).astype(U) * U(0x9FB21C651E98DF25))


def combined(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive word hashes."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=U)
    out = np.full(count, U((n * 0xD6E8FEB86659FD93) % (1 << 64)))
    for k in range(n):
        out = out * U(0xA0761D6478BD642F) + hashes[k : k + count] * U((2 * k + 1) * 0xE7037ED1A0B428DB % (1 << 64))
    return mix(out)


def shingle_sets(column: pa.Array, n: int, kept: np.ndarray = NOT_SPACE) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its n-word shingles.

    A text of fewer words has its whole sequence as its only shingle; one
    without words, or a null, has none.
    """
    for first, last, data, offsets in slices(column):
        words = Words(data, offsets, kept)
        hashes = words.hashes()
        full = combined(hashes, n)
        for k in range(last - first):
            a, b = words.of[k], words.of[k + 1]
            if b - a >= n:
                yield np.unique(full[a : b - n + 1])
            elif b > a:
                yield combined(hashes[a:b], int(b - a))
            else:
                yield np.zeros(0, dtype=U)
