"""Suffix and common-prefix arrays by external induced sorting.

A suffix is of type S if it is smaller than the one that starts a symbol later, else of type L; an S suffix
after an L suffix is a star. The substrings between stars get names by their order, the string of names is
sorted by recursion, and the order of all other suffixes is induced from the stars: scanned in order, each
suffix hands the suffix before it to a priority queue as a tuple (symbol, place, common prefix with the tuple
handed to that symbol before). Tuples leave by symbol and, within one, in the order they came, which is the
order of their suffixes; their common prefixes come with them. The queue is a radix heap of symbol ranges:
ranges beyond the one being emptied are lists of runs, kept on disk when they outgrow a bound, and arrays
that outgrow it are files too, so memory holds one range. All ranges are emptied in numpy batches: a batch ends at
the first symbol that receives a tuple from the batch itself. The recursion ends at a string of names that
fits in memory, which is sorted there by doubling.

Suffixes are told apart by their first `cap` symbols; those equal so far may come in any order.
"""

from __future__ import annotations

import tempfile

import numpy as np

BLOCK = 64
FINE = 64
#: Bytes beyond which an array, or what a queue holds, goes to a file that ends with the task.
MEMORY_BYTES = 96 << 20


def scratch(n: int, dtype, memory_bytes: int) -> np.ndarray:
    """An array in memory, or in an unnamed file of the task when it is large."""
    if n * np.dtype(dtype).itemsize <= memory_bytes:
        return np.empty(n, dtype=dtype)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, dtype=dtype, shape=(n,), mode="w+")


class Spool:
    """Bytes as they arrive: in memory up to a bound, in an unnamed file of the task beyond it."""

    def __init__(self, memory_bytes: int):
        self.limit, self.parts, self.held, self.size, self.file = memory_bytes, [], 0, 0, None

    def add(self, part: np.ndarray) -> None:
        self.parts.append(part)
        self.held += len(part)
        self.size += len(part)
        if self.held > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            self._flush()

    def _flush(self) -> None:
        for x in self.parts:
            self.file.write(x.tobytes())
        self.parts, self.held = [], 0

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else np.empty(0, np.uint8)
        self._flush()
        self.file.flush()
        return np.memmap(self.file, dtype=np.uint8, mode="r+", shape=(self.size,))


class Minima:
    """A growing array of numbers with minima over any range of it."""

    def __init__(self, size: int, memory_bytes: int):
        n = size + BLOCK
        self.values, self.before, self.after = (scratch(n, np.int16, memory_bytes) for _ in range(3))
        self.n = 0
        blocks = n // BLOCK + 2
        self.table = [np.empty(blocks, dtype=np.int16) for _ in range(max(1, blocks.bit_length()))]
        self.done = 0  # completed blocks

    def append(self, x: np.ndarray) -> None:
        if not len(x):
            return
        self.values[self.n : self.n + len(x)] = x
        at, end = self.n // BLOCK * BLOCK, self.n + len(x)
        self.n = end
        rows = -(-(end - at) // BLOCK)
        part = np.full(rows * BLOCK, 32767, dtype=np.int16)
        part[: end - at] = self.values[at:end]
        part = part.reshape(rows, BLOCK)
        self.before[at:end] = np.minimum.accumulate(part, axis=1).ravel()[: end - at]
        after = np.minimum.accumulate(part[:, ::-1], axis=1)[:, ::-1]
        self.after[at:end] = after.ravel()[: end - at]
        done = end // BLOCK
        if done > self.done:
            first = self.done
            self.table[0][first:done] = after[first - at // BLOCK : done - at // BLOCK, 0]
            for k in range(1, len(self.table)):
                if 1 << k > done:
                    break
                lo = max(first, (1 << k) - 1)
                half = 1 << (k - 1)
                self.table[k][lo:done] = np.minimum(self.table[k - 1][lo:done], self.table[k - 1][lo - half : done - half])
            self.done = done

    def query(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of values[lo..hi], both included."""
        first, last = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.after[lo], self.before[hi])
        same = np.flatnonzero(first == last)
        if len(same):
            a, b = lo[same], hi[same]
            m = self.values[b].copy()
            left = np.flatnonzero(a < b)
            at = a.copy()
            while len(left):
                m[left] = np.minimum(m[left], self.values[at[left]])
                at[left] += 1
                left = left[at[left] < b[left]]
            out[same] = m
        wide = np.flatnonzero(last - first > 1)
        if len(wide):
            a, b = first[wide] + 1, last[wide] - 1  # whole blocks
            k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
            m = out[wide]
            for level in np.unique(k):
                own = np.flatnonzero(k == level)
                table, size = self.table[level], 1 << int(level)
                m[own] = np.minimum(m[own], np.minimum(table[a[own] + size - 1], table[b[own]]))
            out[wide] = m
        return out


class Queue:
    """A monotone priority queue of (symbol, place, common prefix), first in first out within a symbol."""

    def __init__(self, range_of: np.ndarray, n_ranges: int, memory_bytes: int):
        self.range_of, self.limit = range_of, memory_bytes
        self.far: list[list] = [[] for _ in range(n_ranges // FINE + 1)]
        self.near: list[list] = [[] for _ in range(FINE)]
        self.top, self.held, self.file = -1, 0, None

    def push(self, sym: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        if not len(sym):
            return
        r = self.range_of[sym]
        top = r // FINE
        slot = np.where(top == self.top, r % FINE, FINE + top).astype(np.int16)
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        cuts = np.flatnonzero(np.diff(slot)) + 1
        sym, pos, lcp = sym[order], pos[order], lcp[order]
        lo = 0
        for hi in [*cuts.tolist(), len(slot)]:
            k = int(slot[lo])
            run = (sym[lo:hi], pos[lo:hi], lcp[lo:hi])
            if k < FINE:
                self.near[k].append(run)
            else:
                self.far[k - FINE].append(run)
                self.held += sum(x.nbytes for x in run)
            lo = hi
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        """All far runs go to the file; what stays is where they lie."""
        self.file = self.file or tempfile.TemporaryFile()
        for runs in self.far:
            kept = [x for x in runs if not isinstance(x[0], np.ndarray)]
            fresh = [x for x in runs if isinstance(x[0], np.ndarray)]
            if fresh:
                at = self.file.seek(0, 2)
                whole = [np.concatenate(x) for x in zip(*fresh, strict=True)]
                for x in whole:
                    self.file.write(x.tobytes())
                kept.append((at, len(whole[0]), [x.dtype for x in whole]))
            runs[:] = kept
        self.held = 0

    def _load(self, run):
        if isinstance(run[0], np.ndarray):
            self.held -= sum(x.nbytes for x in run)
            return run
        at, n, kinds = run
        self.file.seek(at)
        return tuple(np.frombuffer(self.file.read(n * k.itemsize), dtype=k) for k in kinds)

    def take(self, r: int) -> list:
        """Runs of the range r, in order; ranges are taken in ascending order."""
        if r // FINE != self.top:
            self.top = r // FINE
            runs, self.far[self.top] = self.far[self.top], []
            if runs:
                self.push(*(np.concatenate(x) for x in zip(*map(self._load, runs), strict=True)))
        runs, self.near[r % FINE] = self.near[r % FINE], []
        return runs


def _runs(text: np.ndarray, at: np.ndarray, cap: int) -> np.ndarray:
    """How often the symbol at a place follows on itself, from 1 to the cap."""
    n, out, left, k = len(text), np.ones(len(at), dtype=np.int64), np.arange(len(at)), 1
    while len(left) and k < cap:
        to = np.minimum(at[left] + k, n - 1)
        left = left[(at[left] + k < n) & (text[to] == text[at[left]])]
        out[left] += 1
        k += 1
    return out


class Induction:
    """One scan: from sorted seeds to the merged order of seeds and of what they induce."""

    def __init__(self, text: np.ndarray, sigma: int, seeds: np.ndarray, seed_lcp: np.ndarray, total: int, cap: int, memory_bytes: int):
        self.text, self.cap = text, cap
        self.pos = scratch(total, np.int32, memory_bytes)
        self.seeded = scratch(total, np.bool_, memory_bytes)
        self.minima = Minima(total, memory_bytes)
        self.last = np.full(sigma, -1, dtype=np.int64)
        self.before = (-1, -1, True)  # symbol, place and kind of what was emitted last
        n_ranges = int(min(sigma, max(64, 2 * int(len(text) ** 0.5))))
        share = np.cumsum(np.bincount(text, minlength=sigma))
        range_of = np.minimum((share - 1) * n_ranges // max(1, len(text)), n_ranges - 1) if n_ranges < sigma else np.arange(sigma)
        edges = np.flatnonzero(np.diff(range_of, prepend=-1))
        range_of = (np.cumsum(np.diff(range_of, prepend=-1) > 0) - 1).astype(np.int32)
        self.queue = Queue(range_of, len(edges), memory_bytes)
        seed_sym = text[seeds]
        bounds = np.searchsorted(seed_sym, [*edges.tolist(), sigma])
        for r, lo in enumerate(edges.tolist()):
            hi = int(edges[r + 1]) if r + 1 < len(edges) else sigma
            a, b = int(bounds[r]), int(bounds[r + 1])
            runs = self.queue.take(r)
            if not runs and a == b:
                continue
            tuples = [np.concatenate(x) for x in zip(*runs, strict=True)] if runs else [text[:0], np.empty(0, np.int32), np.empty(0, np.int16)]
            self._range(lo, hi, tuples, [seed_sym[a:b], seeds[a:b], seed_lcp[a:b]])

    def _range(self, lo: int, hi: int, q: list, s: list) -> None:
        while len(q[0]) or len(s[0]):
            if hi - lo > 1:
                order = np.argsort(q[0], kind="stable")
                q = [x[order] for x in q]
                sym = np.concatenate((q[0], s[0]))
                kind = np.concatenate((np.zeros(len(q[0]), bool), np.ones(len(s[0]), bool)))
                order = np.lexsort((kind, sym))
                sym, kind = sym[order], kind[order]
                pos = np.concatenate((q[1], s[1]))[order]
                lcp = np.concatenate((q[2], s[2]))[order]
                to = self.text[pos - 1]
                inner = (pos > 0) & np.where(kind, to > sym, to >= sym) & (to < hi)
                cut = int(to[inner].min()) if inner.any() else hi
                n = int(np.searchsorted(sym, cut))
                late = self._emit(sym[:n], pos[:n], lcp[:n], kind[:n], hi)
                if cut == hi:
                    return
                a, b = np.searchsorted(q[0], cut), np.searchsorted(s[0], cut)
                q = [np.concatenate((x[a:], y)) for x, y in zip(q, late, strict=True)]
                s = [x[b:] for x in s]
                lo = cut
            # one symbol: what it induces within itself comes after what is there
            own = q[0] == lo
            now, q = [x[own] for x in q], [x[~own] for x in q]
            while len(now[0]):
                late = self._emit(*now, np.zeros(len(now[0]), bool), hi)
                own = late[0] == lo
                q = [np.concatenate((x, y[~own])) for x, y in zip(q, late, strict=True)]
                now = [y[own] for y in late]
            own = s[0] == lo
            if own.any():
                late = self._emit(*(x[own] for x in s), np.ones(int(own.sum()), bool), hi)
                q = [np.concatenate((x, y)) for x, y in zip(q, late, strict=True)]
                s = [x[~own] for x in s]
            lo += 1

    def _emit(self, sym, pos, lcp, kind, hi) -> list:
        """Append suffixes to the order, push what they induce beyond the range; the rest is returned."""
        if not len(sym):
            return [sym, pos, lcp]
        g, text = self.minima.n, self.text
        lcp = lcp.astype(np.int16)
        before_sym = np.concatenate(([self.before[0]], sym[:-1]))
        before_pos = np.concatenate(([self.before[1]], pos[:-1]))
        before_kind = np.concatenate(([self.before[2]], kind[:-1]))
        lcp[before_sym != sym] = 0
        joint = np.flatnonzero((before_sym == sym) & kind & ~before_kind)
        if len(joint):  # the last induced suffix of a symbol and its first seed differ where the shorter run ends
            lcp[joint] = np.minimum(_runs(text, before_pos[joint], self.cap), _runs(text, pos[joint], self.cap))
        self.before = (int(sym[-1]), int(pos[-1]), bool(kind[-1]))
        self.pos[g : g + len(pos)], self.seeded[g : g + len(pos)] = pos, kind
        self.minima.append(lcp)
        to = text[pos - 1]
        ok = np.flatnonzero((pos > 0) & np.where(kind, to > sym, to >= sym))
        if not len(ok):
            return [sym[:0], pos[:0], lcp[:0]]
        to, source = to[ok], ok + g
        order = np.argsort(to, kind="stable")
        target, own = to[order], source[order]
        first = np.ones(len(own), dtype=bool)
        first[1:] = target[1:] != target[:-1]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[first] = self.last[target[first]]
        end = np.append(np.flatnonzero(first)[1:] - 1, len(own) - 1)
        self.last[target[end]] = own[end]
        common = np.zeros(len(own), dtype=np.int16)
        some = np.flatnonzero(before >= 0)
        common[some] = np.minimum(1 + self.minima.query(before[some] + 1, own[some]), self.cap)
        new = np.empty_like(common)
        new[order] = common
        at = (pos[ok] - 1).astype(np.int32)
        far = to >= hi
        self.queue.push(to[far], at[far], new[far])
        return [to[~far], at[~far], new[~far]]


def _names(text: np.ndarray, stars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Names of the substrings by their order; where one ends the other goes on with a smaller symbol."""
    per, bits = (8, 8) if text.dtype == np.uint8 else (2, 32)
    pad, n = (1 << bits) - 1, len(text)

    def word(rows: np.ndarray, w: int) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.uint64)
        for k in range(w * per, (w + 1) * per):
            at = stars[rows] + k
            value = np.where(k < lengths[rows], text[np.minimum(at, n - 1)], pad).astype(np.uint64)
            out = (out << np.uint64(bits)) | value
        return out

    rank = np.unique(word(np.arange(len(stars)), 0), return_inverse=True)[1].astype(np.int64)
    w = 1
    while len(long := np.flatnonzero(lengths > w * per)):
        marked = np.zeros(int(rank.max()) + 1, dtype=bool)
        marked[rank[long]] = True
        rows = np.flatnonzero(marked[rank])
        key = word(rows, w)
        order = np.lexsort((key, rank[rows]))
        group, key = rank[rows][order], key[order]
        new_group = np.ones(len(rows), dtype=bool)
        new_group[1:] = group[1:] != group[:-1]
        new = new_group.copy()
        new[1:] |= key[1:] != key[:-1]
        within = np.cumsum(new) - 1
        within -= np.repeat(within[new_group], np.diff(np.append(np.flatnonzero(new_group), len(rows))))
        extra = np.zeros(len(marked) + 1, dtype=np.int64)
        np.maximum.at(extra, group + 1, within)
        rank += np.cumsum(extra)[rank]
        rank[rows[order]] += within
        w += 1
    return rank


def _extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, lcp: np.ndarray, cap: int) -> np.ndarray:
    """Go on comparing the suffixes at a and b from lcp symbols on."""
    n = len(text)
    left = np.flatnonzero(lcp < cap)
    while len(left):
        i, j = a[left] + lcp[left], b[left] + lcp[left]
        left = left[(i < n) & (j < n) & (text[np.minimum(i, n - 1)] == text[np.minimum(j, n - 1)])]
        lcp[left] += 1
        left = left[lcp[left] < cap]
    return np.minimum(lcp, cap)


def _doubled(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The order and common prefixes of a string that fits in memory: ranks by twice as many symbols each time."""
    n, width = len(text), 1
    levels = [np.unique(text, return_inverse=True)[1].astype(np.int32)]
    while width < cap and int(levels[-1].max()) + 1 < n:
        key = levels[-1].astype(np.int64) << 32
        key[: n - width] |= levels[-1][width:] + 1
        levels.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
        width *= 2
    order = np.argsort(levels[-1], kind="stable")
    lcp = np.zeros(n, dtype=np.int64)
    for k in reversed(range(len(levels))):
        a, b = order[:-1] + lcp[1:], order[1:] + lcp[1:]
        same = np.flatnonzero((a < n) & (b < n))
        same = same[levels[k][a[same]] == levels[k][b[same]]]
        lcp[same + 1] += 1 << k
    return order, np.minimum(lcp, cap)


def suffix_order(text: np.ndarray, cap: int, memory_bytes: int = MEMORY_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in order, and the common prefix of each with the one before (the cap at most).

    text: whole numbers, its last the smallest; a suffix that ends is smaller than one that goes on. Bytes
    (np.uint8) must stay below 255."""
    n = len(text)
    if n <= 1:
        return np.arange(n), np.zeros(n, dtype=np.int16)
    sigma = int(text.max()) + 1
    bound = np.append(np.flatnonzero(text[:-1] != text[1:]), n - 1)
    rises = np.append(text[bound[:-1]] < text[bound[:-1] + 1], True)
    small = np.repeat(rises, np.diff(bound, prepend=-1))  # type S
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    lengths = np.append(np.diff(stars) + 1, 1)
    names = _names(text, stars, lengths) + 1
    n_names = int(names.max())
    names[-1] = 0
    if n_names == len(stars):
        order = np.argsort(names, kind="stable")
        common = np.zeros(len(order), dtype=np.int64)
    else:
        sort = suffix_order if len(stars) * 24 > memory_bytes else lambda x, most, _: _doubled(x, most)
        order, common = sort(names.astype(np.uint32), cap, memory_bytes)
        order, common = order.astype(np.int64), common.astype(np.int64)
        before = np.concatenate((order[:1], order[:-1]))
        common = stars[before + common] - stars[before]
    at = stars[order]
    del names, lengths
    lcp = np.zeros(len(at), dtype=np.int64)
    lcp[1:] = _extend(text, at[:-1], at[1:], np.minimum(common[1:], cap), cap)
    n_large = n - int(small.sum())
    up = Induction(text, sigma, at.astype(np.int32), lcp.astype(np.int16), n_large + len(at), cap, memory_bytes)
    large = np.flatnonzero(~up.seeded[: n_large + len(at)])
    seeds = up.pos[large][::-1]
    lcp = up.minima.values[large]
    lcp = np.concatenate((lcp[:1] * 0, lcp[1:][::-1]))
    del up, large
    down = Induction((sigma - 1 - text).astype(text.dtype), sigma, seeds, lcp, n - 1, cap, memory_bytes)
    out, common = scratch(n, np.int32, memory_bytes), scratch(n, np.int16, memory_bytes)
    out[0], out[1:] = n - 1, down.pos[: n - 1][::-1]
    common[0], common[1] = 0, int(text[out[1]] == text[n - 1])
    common[2:] = down.minima.values[1 : n - 1][::-1]
    return out, common
