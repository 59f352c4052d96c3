"""Words of an Arrow string column as NumPy arrays.

The text buffer of an Arrow column is one run of UTF-8 bytes. Words are found
by a table look-up per byte, and each word gets a 64-bit hash from one running
sum over the buffer, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time inside a task; one longer text is one slice.
SLICE_BYTES = 1 << 20

#: Separators of blank-split words: space, tab, line feed to carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

#: Everything in ASCII but digits and letters separates words here.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.default_rng(20240901).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit hash of a pair of hashes."""
    return mix(a * np.uint64(_BASE) + (b ^ (b >> np.uint64(29))) + np.uint64(0x632BE59BD9B4E019))


def give_back() -> None:
    """Free memory that the allocators keep for later goes back to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(step: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's step over batches that keeps no free memory once it has ended.

    Its Python worker lives on, beside those of other steps in the same executor.
    """

    @functools.wraps(step)
    def run(*args, **kwargs) -> Iterator:
        yield from step(*args, **kwargs)
        give_back()

    return run


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_powers = _Powers()


@dataclass
class Words:
    """Words of consecutive texts; ``first[i]:first[i + 1]`` are text i's."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        _powers.upto(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _powers.up[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * _powers.down[self.start] + (self.end - self.start).astype(np.uint64))

    def text_of(self) -> np.ndarray:
        """For each word, the position of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null reads as empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS) -> Words:
    """Lower-case A-Z and cut into words; no word spans two texts."""
    data = LOWER[data]
    n = len(data)
    if not n:
        zero = np.zeros(0, np.int64)
        return Words(data, zero, zero, np.zeros(len(offsets), np.int64))
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(starts)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``limit`` bytes, or one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    data, offsets = buffer(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def gram_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every ``width``-word shingle; a shorter non-empty text is one shingle."""
    n, texts = len(hashes), len(first) - 1
    counts = np.diff(first)
    of = np.repeat(np.arange(texts), counts)
    if n >= width:
        h = hashes[: n - width + 1]
        for k in range(1, width):
            h = combine(h, hashes[k : n - width + 1 + k])
        whole = of[: n - width + 1] == of[width - 1 :]
        h, at = h[whole], of[: n - width + 1][whole]
    else:
        h, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] = combine(extra[has] + np.uint64(k + 1), hashes[first[:-1][short[has]] + k])
        h, at = np.concatenate([h, mix(extra + np.uint64(0x51ED270B))]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at
