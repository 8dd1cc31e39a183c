"""Vectorised reading of Arrow text columns: words, hashes and shingles in numpy.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``.  All hashes are
64-bit polynomial hashes of the word's UTF-8 bytes, mixed at the end; they are
the same on every machine and in every batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_MUL = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_MUL, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place of a fresh hash."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation.
PUNCTUATION = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
_WINDOW_MUL = np.array([pow(0xC2B2AE3D27D4EB4F | 1, k, 1 << 64) for k in range(64)], dtype=U)
_END = U(0x5851F42D4C957F2D)


class _Powers:
    """Powers of the multiplier and of its inverse, grown as needed."""

    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def to(cls, n: int):
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.concatenate([np.ones(1, U), np.full(size, _MUL, U)]), dtype=U)
                cls.down = np.cumprod(np.concatenate([np.ones(1, U), np.full(size, _INV, U)]), dtype=U)
        return cls.up, cls.down


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offsets[0] : offsets[-1]] if bufs[2] is not None and n else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of a run of rows: ``starts``, ``ends`` (bytes), ``hashes``, and
    ``first[d]:first[d + 1]``, the words of row d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, hashes: bool = True, between: np.ndarray = _SPACE):
        n = len(data)
        self.data, self.offsets = data, offsets
        word = ~between[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        before &= ~edge[:-1]
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        after &= ~edge[1:]
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        if hashes:
            up, down = _Powers.to(n + 1)
            total = np.zeros(n + 1, U)
            np.cumsum((_LOWER if lower else _TABLE)[data] * up[:n], out=total[1:], dtype=U)
            h = (total[self.ends] - total[self.starts]) * down[self.starts]
            self.hashes = mix(h + (self.ends - self.starts).astype(U) * _END)


def runs(offsets: np.ndarray, size: int = 1 << 20):
    """Cut rows into runs of about ``size`` bytes; a longer row is a run alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def words_by_run(column, lower: bool, hashes: bool = True, size: int = 1 << 20, between: np.ndarray = _SPACE):
    """(first row, last row + 1, Words) over the column, about a megabyte at a time.

    ``between``: which bytes stand between words."""
    data, offsets = text_buffer(column)
    for a, b in runs(offsets, size):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower, hashes, between)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words (row bounds are the caller's matter)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = hashes[:m] * _WINDOW_MUL[0]
    for k in range(1, n):
        out = out + hashes[k : k + m] * _WINDOW_MUL[k]
    return mix(out + U(int(n) * int(_END) & _MASK))


def shingle_set(hashes: np.ndarray, grams: np.ndarray, a: int, b: int, n: int = 5) -> np.ndarray:
    """The sorted distinct n-word shingles of the row with words a:b; fewer than
    n words count as one shingle, no word as none.  ``grams``: windows(hashes, n)."""
    if b - a >= n:
        return np.unique(grams[a : b - n + 1])
    if b == a:
        return np.zeros(0, U)
    return windows(hashes[a:b], b - a)
