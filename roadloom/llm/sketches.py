"""SetSketch registers of shingle sets: exponentially spaced, truncated minima.

A register keeps floor(1 - log_b(x)) of the smallest of the exponential variates that the shingles draw for
it, truncated to one byte. Registers of a union are the larger ones of its parts (`merge`), equal registers
tell similar sets, and counts of smaller, equal and larger registers of two sets of known sizes give the
Jaccard similarity by maximum likelihood (`similarity`).
"""

from __future__ import annotations

import math

import numpy as np

from . import hashing

B = 1.1
TOP = 254
SHINGLE = 5
U32 = np.uint32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted by row: (hashes, bounds). A to Z count as a to z. A row of
    fewer words has its whole sequence as one shingle, one without words none."""
    words = hashing.Words(data, offsets, fold=True)
    sums = hashing.prefix_sums(words.hashes())
    n, rows = len(words.start), len(offsets) - 1
    start = np.arange(max(0, n - shingle + 1))
    row = words.row[: len(start)]
    fits = start + shingle <= words.row_word[row + 1] if len(start) else np.empty(0, bool)
    start, row = start[fits], row[fits]
    hashes = hashing.windows(sums, start, start + shingle)
    size = np.diff(words.row_word)
    short = np.flatnonzero((size > 0) & (size < shingle))
    if len(short):
        whole = hashing.windows(sums, words.row_word[short], words.row_word[short + 1]) ^ size[short].astype(np.uint64)
        hashes, row = np.concatenate((hashes, whole)), np.concatenate((row, short))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(rows + 1))


def registers(hashes: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """A row of m registers for every set; zeros for an empty one."""
    out = np.zeros((len(bounds) - 1, m), dtype=np.uint8)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    x = (hashes >> np.uint64(32)).astype(U32) ^ (hashes & np.uint64(0xFFFFFFFF)).astype(U32)
    y, begins = (hashes >> np.uint64(16)).astype(U32), bounds[full]
    least = np.empty((len(full), m), dtype=U32)
    multipliers = hashing.mix(np.arange(1, 2 * m + 1, dtype=np.uint64), 2)
    for j in range(m):
        v = x * U32(int(multipliers[2 * j]) & 0xFFFFFFFF | 1)
        v ^= y
        v *= U32(int(multipliers[2 * j + 1]) & 0xFFFFFFFF | 1)
        v ^= v >> U32(15)
        v *= U32(0x2C1B3C6D)
        least[:, j] = np.minimum.reduceat(v, begins)
    variates = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    scaled = np.floor(1 - np.log(variates) / math.log(B)) + 32
    out[full] = np.clip(scaled, 1, TOP).astype(np.uint8)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def _step(x):
    """The probability that of two registers with that share of own elements the first is larger."""
    return -np.log(1 - x * (B - 1) / B) / math.log(B)


def similarity(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the numbers of registers of a that are larger than, smaller
    than and equal to those of b, and the sizes of both sets."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    lo, hi = np.zeros(len(u)), most.copy()

    def likelihood(j):
        p, q = _step(np.maximum(u - v * j, 0)), _step(np.maximum(v - u * j, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = [np.where(k > 0, k * np.log(np.maximum(x, 1e-300)), 0) for k, x in ((larger, p), (smaller, q), (equal, 1 - p - q))]
        return parts[0] + parts[1] + parts[2]

    for _ in range(40):  # the likelihood has one peak
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = likelihood(a) < likelihood(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2
