"""Vectorised hashes of bytes, words and windows, over whole Arrow batches at once.

A byte or a word stands for a number; the sum of numbers times powers of an odd base, modulo 2**64, is kept
for every prefix, so that the hash of any window is one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of a text whose prefix sums are held at once.
PART_BYTES = 1 << 22


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ U((salt * 0xD6E8FEB86659FD93) % (1 << 64))
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U), 1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept for later calls."""
    if base not in _powers or len(_powers[base]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.full(size, base, dtype=U)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of value times power over every prefix, the empty one included."""
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def windows(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], wherever they lie."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start])


def leftmost_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` keys the place of its smallest one, the leftmost of equal ones.

    The upper 40 bits of a key are compared."""
    n, step = len(keys) - width + 1, 1 << 23
    if n > step:
        return np.concatenate([leftmost_minima(keys[k : min(k + step, n) + width - 1], width) + k for k in range(0, n, step)])
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    packed = (keys & ~U(0xFFFFFF)) | np.arange(len(keys), dtype=U)
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, ~U(0), dtype=U)
    padded[: len(keys)] = packed
    table = padded.reshape(blocks, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & U(0xFFFFFF)).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows, without a copy; a null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data and data.size else np.empty(0, np.uint8)), offsets


IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words (runs of other than space and control white space) of a run of rows of a batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False):
        base, end = int(offsets[0]), int(offsets[-1])
        part = data[base:end]
        if fold:
            part = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
        self.bytes, self.row_start = part, (offsets - base).astype(np.int64)
        inside = ~IS_SPACE[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts_row = np.zeros(len(part) + 1, dtype=bool)
        starts_row[self.row_start] = True
        if len(part):
            first |= inside & starts_row[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        if len(part):
            last |= inside & starts_row[1:]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row_word = np.searchsorted(self.start, self.row_start)  # first word of every row, then the end
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.row_word))

    def hashes(self) -> np.ndarray:
        """Hashes of all words; the sums of a few MB of bytes are held at once, whatever the text."""
        out, lo = np.empty(len(self.start), dtype=U), 0
        while lo < len(out):
            a = int(self.start[lo])
            if self.end[lo] - a > PART_BYTES:
                out[lo] = _long_word(self.bytes[a : self.end[lo]])
                lo += 1
                continue
            hi = int(np.searchsorted(self.end, a + PART_BYTES, side="right"))
            sums = prefix_sums(BYTE_VALUES[self.bytes[a : self.end[hi - 1]]])
            out[lo:hi] = windows(sums, self.start[lo:hi] - a, self.end[lo:hi] - a)
            lo = hi
        return out


def _long_word(data: np.ndarray) -> np.uint64:
    total = 0
    for at in range(0, len(data), PART_BYTES):
        total += int(prefix_sums(BYTE_VALUES[data[at : at + PART_BYTES]])[-1]) * pow(BASE, at, 1 << 64)
    return mix(np.array([total % (1 << 64)], dtype=U))[0]


def row_runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `limit` bytes; a longer row is a run of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
