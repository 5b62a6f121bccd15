"""Suffix-array dedup: remove the bytes of strings of a given length that occur more than once.

A string of ``length`` bytes holds exactly one chosen core: of its substrings of CORE bytes the one with the
smallest hash, the leftmost of equal ones. Equal strings choose equal cores at equal places, so the starts
that share a core form a record, and starts of different cores never match. One pass over the texts emits
records of a few numbers; records whose core occurs once are done, and so are those of a core that always has the same
text around it: all its starts are repeated. The texts around the others, each
distinct one once and with its number of occurrences, go to shards by core, and each shard is sorted by
external induced sorting (`induced`), which tells which starts have an equal string elsewhere. A longer string
that is repeated has a repeated prefix, so the same sort answers for a second, larger length (``longest``): the texts
around cores only have to reach that far.

Copies are counted before the sort, so a group of any size is one text of its shard. A core whose distinct texts
fill more than a shard (a common line in many contexts) is split until none does: a string's core lies `p` bytes
in; strings whose p is in one range share all bytes that every string of the range covers, so range and hash of
those bytes are a finer key. Ranges are quartered round by round, for the cores that need it alone; at the last, of one p, a key is a
whole string. Defined results: a null
text is empty; repeated rows and equal ids are documents like any others (equal rows get equal answers); a null
id is kept; an empty table gives an empty one; documents shorter than ``length`` keep every byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing, induced

LENGTH = 400
#: Bytes from which a repeated string counts as a passage: 50 words have 263 at least in the documents of sf0.1.
PASSAGE = 240
CORE = 64
CHUNK_BYTES = 1 << 18
#: Bytes of texts that a shard is aimed at, and those that one core may have there before it is split.
SHARD_BYTES, HOT_BYTES = 1 << 20, 6 << 20
#: Ranges of a core's place by which a shard tells texts that match nothing before it sorts the others.
RANGES = 4
KEYS = ["_id", "_hash"]
PLACES = ["first", "last", "place", "stop"]
RECORD = "core long, around long, _id long, _hash long, first int, last int, place int, stop int"
PIECE = "core0 long, around0 long, first0 int, n long, " + RECORD


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with the key that tells texts apart: the id (the largest number if null) and a hash of the text."""
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)), "_hash": F.xxhash64("text")})


def _emitter(length: int, longest: int, core: int):
    """Records: starts first to last of strings around the core at place; the text around ends at stop, where the longest
    string of the last start or the document ends."""
    width = length - core + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offsets = hashing.text_bytes(batch.column(2))
            for start in range(int(offsets[0]), int(offsets[-1]) - length + 1, CHUNK_BYTES):
                part = data[start : min(start + CHUNK_BYTES + longest - 1, int(offsets[-1]))]
                n = min(CHUNK_BYTES, len(part) - length + 1)
                sums = hashing.prefix_sums(hashing.BYTE_VALUES[part])
                cores = hashing.windows(sums, np.arange(n + width - 1), np.arange(core, n + width - 1 + core))
                chosen = hashing.leftmost_minima(cores, width)
                row = np.searchsorted(offsets, start + np.arange(n), side="right") - 1
                fits = start + np.arange(n) + length <= offsets[row + 1]
                new = np.ones(n, dtype=bool)
                new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1]) | (fits[1:] != fits[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], n) - 1
                first, last = first[fits[first]], last[fits[first]]
                own = row[first]
                stop = np.minimum(last + longest, offsets[own + 1] - start)
                around = hashing.windows(sums, first, stop) ^ (chosen[first] - first).astype(np.uint64)
                shift = start - offsets[own]
                columns = [hashing.signed(cores[chosen[first]]), hashing.signed(around), ids[own], keys[own]]
                columns += [(x + shift).astype(np.int32) for x in (first, last, chosen[first], stop)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["core", "around", *KEYS, *PLACES])

    return emit


def _cells(data, begin, key, first, last, place, stop, length: int, longest: int, core: int, width: int) -> tuple[np.ndarray, ...]:
    """Pieces of texts that begin at `begin` by ranges of `width` of the core's place within a string: the text's number, the
    first and last start, the end, a finer key and a hash of the piece."""
    low, high = (place - last) // width, (place - first) // width
    k = np.repeat(np.arange(len(begin)), high - low + 1)
    cell = np.arange(len(k)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[k]
    a, b = cell * width, np.minimum(cell * width + width - 1, length - core)
    lo, hi = np.maximum(first[k], place[k] - b), np.minimum(last[k], place[k] - a)
    end = np.minimum(hi + longest, stop[k])
    sums, at = hashing.prefix_sums(hashing.BYTE_VALUES[data]), begin[k] - first[k]
    shared = hashing.windows(sums, at + place[k] - a, at + place[k] - b + length)
    fine = hashing.mix(hashing.mix(key[k].view(np.uint64) ^ shared, 5) ^ cell.astype(np.uint64), 7)
    around = hashing.windows(sums, at + lo, at + end) ^ (place[k] - lo).astype(np.uint64)
    return k, lo, hi, end, fine, around


def _splitter(length: int, longest: int, core: int, width: int):
    """Pieces by ranges of `width` of the core's place within a string."""

    def parts_of(rows: list[tuple], texts: list[bytes]) -> pa.RecordBatch:
        table = np.array(rows, dtype=np.int64).reshape(len(rows), 10)
        core0, around0, first0, n, own, first, last, place, stop, key = table.T
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        begin = np.concatenate(([0], np.cumsum([len(x) for x in texts], dtype=np.int64)))[:-1]
        k, lo, hi, end, fine, around = _cells(data, begin, key, first, last, place, stop, length, longest, core, width)
        columns = [core0[k], around0[k], first0[k].astype(np.int32), n[k], hashing.signed(fine), hashing.signed(around), own[k]]
        columns += [x.astype(np.int32) for x in (lo, hi, place[k], end)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["core0", "around0", "first0", "n", "core", "around", "own", *PLACES])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = hashing.text_bytes(batch.column(2))
            keys = [batch.column(k).to_pylist() for k in (0, 1)]

            def flush(rows: list[tuple], texts: list[bytes], keys=keys) -> pa.RecordBatch:
                made = parts_of(rows, texts)
                own = made.column(6).to_pylist()
                columns = [made.column(k) for k in range(6)] + [pa.array([c[x] for x in own], pa.int64()) for c in keys]
                columns += [made.column(k) for k in range(7, 11)]
                return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PIECE.split(", ")])

            rows, texts, size = [], [], 0
            for k, wanted in enumerate(batch.column(3).to_pylist()):
                for w in wanted:
                    rows.append((w["core0"], w["around0"], w["first0"], w["n"], k, w["first"], w["last"], w["place"], w["stop"], w["core"]))
                    texts.append(data[int(offsets[k]) + w["first"] : int(offsets[k]) + w["stop"]].tobytes())
                    size += len(texts[-1])
                    if size > CHUNK_BYTES:
                        yield flush(rows, texts)
                        rows, texts, size = [], [], 0
            if rows:
                yield flush(rows, texts)

    return split


def _distinct(rows: DataFrame, n) -> DataFrame:
    """Each text around a core once: how often it occurs and where it can be read."""
    return rows.groupBy("core", "around").agg(n.alias("n"), F.min(F.struct(*KEYS, *PLACES)).alias("at"))


def pieces_of(
    texts: DataFrame, distinct: DataFrame, length: int, longest: int, core: int, hot_bytes: int, root: str
) -> tuple[DataFrame, DataFrame, int, bool]:
    """Pieces of the distinct texts around cores; each distinct piece once, with n and at; the bytes of those; and
    whether a core was split. No core has more than hot_bytes of distinct pieces."""
    pieces = distinct.select(F.col("core").alias("core0"), F.col("around").alias("around0"), F.col("at.first").alias("first0"), "n", "core", "around", "at.*")
    width, total, done = length - core + 1, 0, []
    while True:
        by_core = distinct.groupBy("core").agg(F.sum(F.expr("at.stop - at.first")).alias("bytes"))
        all_, much, hot = by_core.agg(F.sum("bytes"), F.sum(F.when(F.col("bytes") > hot_bytes, F.col("bytes"))), F.count_if(F.col("bytes") > hot_bytes)).head()
        if not hot or width == 1:
            done.append((pieces, distinct))
            total += all_ or 0
            break
        total += (all_ or 0) - (much or 0)
        width = -(-width // 4)
        hot = common.store(by_core.where(F.col("bytes") > hot_bytes).select("core"), f"hot{width}", root)
        done.append(tuple(x.join(hot, "core", "left_anti") for x in (pieces, distinct)))
        own = ["core0", "around0", "first0", "n", "core", *PLACES]
        # a piece that several texts share goes on with each of them
        wanted = pieces.join(hot, "core", "left_semi").groupBy(*KEYS).agg(F.collect_list(F.struct(*own)).alias("wanted"))
        parts = texts.join(wanted, KEYS).select(*KEYS, "text", "wanted").mapInArrow(_splitter(length, longest, core, width), PIECE).distinct()
        parts = common.store(parts, f"parts{width}", root)
        often = common.store(parts.groupBy("core").agg(F.sum("n").alias("m")).where("m > 1").select("core"), f"often{width}", root)
        pieces = common.store(parts.join(often, "core", "left_semi"), f"pieces{width}", root)
        common.forget(texts.sparkSession, root, f"parts{width}", f"often{width}")
        distinct = common.store(_distinct(pieces, F.sum("n")), f"distinct{width}", root)
    every, each = done[0]
    for more, one in done[1:]:
        every, each = every.unionByName(more.select(*every.columns)), each.unionByName(one)
    return every, each, total, len(done) > 1


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text around every wanted record of a document, as bytes."""
    for batch in batches:
        data, offsets = hashing.text_bytes(batch.column(0))
        rows, size = [], 0
        for k, wanted in enumerate(batch.column(1).to_pylist()):
            for w in wanted:
                around = data[int(offsets[k]) + w["first"] : int(offsets[k]) + w["stop"]].tobytes()
                rows.append((w["core"], w["around"], w["n"], w["last"] - w["first"], w["place"] - w["first"], around))
                size += len(around)
                if size > 8 << 20:
                    yield _snippets(rows)
                    rows, size = [], 0
        yield _snippets(rows)


SNIPPET = "core long, around long, n long, most int, place int, bytes binary"


def _snippets(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["core", "around", "n", "most", "place", "bytes"])


def repeated_starts(
    text: np.ndarray, sizes: np.ndarray, most: np.ndarray, n: np.ndarray, lengths: tuple[int, ...], memory_bytes: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length (snippet, start) of every start, `most` at the latest, whose string of that length occurs twice
    or more, sorted. text: the snippets, each followed by a 0; sizes: theirs, with that."""
    begins = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    order, lcp = induced.suffix_order(text, max(lengths), memory_bytes)
    owner = np.searchsorted(begins, order, side="right").astype(np.int32) - 1
    start = order - begins[owner]
    out = []
    for length in lengths:
        mine = start <= np.minimum(most[owner], sizes[owner] - 1 - length)
        group, own, at = (np.cumsum(lcp < length, dtype=np.int32) - 1)[mine], owner[mine], start[mine]
        twice = np.bincount(group, weights=n[own]) > 1 if len(group) else np.empty(0, bool)
        hit = twice[group] if len(group) else np.empty(0, bool)
        own, at = own[hit], at[hit]
        by_snippet = np.lexsort((at, own))
        out.append((own[by_snippet], at[by_snippet]))
    return out


def _runs_of(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of runs; breaks: whether a run ends between a place and the next."""
    ends = np.flatnonzero(breaks)
    return np.concatenate(([0], ends + 1)), np.append(ends, len(breaks))


class _Shard:
    """The texts around cores of a shard, cut into pieces by ranges of the core's place.

    A piece whose finer key no other piece has matches nothing; equal ones are sorted once; where all pieces of a key are
    equal nothing is sorted. The others are, adjacent ones of a text in one."""

    def __init__(self, lengths: tuple[int, ...], core: int, memory_bytes: int):
        self.lengths, self.core, self.memory_bytes = lengths, core, memory_bytes
        self.width = -(-(lengths[0] - core + 1) // RANGES)
        self.spool, self.numbers, self.cells, self.rows, self.size = induced.Spool(memory_bytes), [], [], 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        key, around, n, most, place = (batch.column(k).to_numpy() for k in range(5))
        column = batch.column(5).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data, offsets = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
        for a, b in hashing.row_runs(offsets, CHUNK_BYTES):
            begin, sizes = offsets[a:b] - offsets[a], np.diff(offsets[a : b + 1])
            last, at = most[a:b].astype(np.int64), place[a:b].astype(np.int64)
            k, lo, hi, end, fine, alike = _cells(
                data[offsets[a] : offsets[b]], begin, key[a:b], np.zeros_like(last), last, at, sizes, self.lengths[0], self.lengths[-1], self.core, self.width
            )
            self.cells.append([k + self.rows + a, lo.astype(np.int32), hi.astype(np.int32), end.astype(np.int32), fine, alike ^ ((hi - lo).astype(np.uint64) << np.uint64(32))])
        self.numbers.append([key, around, n, offsets[:-1] + self.size])
        self.spool.add(data)
        self.rows, self.size = self.rows + len(key), self.size + len(data)

    def _text(self, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The pieces, each followed by a 0."""
        whole, made = self.spool.array(), induced.Spool(self.memory_bytes)
        for a, b in hashing.row_runs(np.concatenate(([0], np.cumsum(sizes))), CHUNK_BYTES):
            size = sizes[a:b]
            before = np.cumsum(size) - size
            at, own = np.arange(int(size.sum())), np.repeat(np.arange(b - a), size)
            part = np.zeros(len(at) + b - a, dtype=np.uint8)
            part[at + own] = whole[at + (start[a:b] - before)[own]] + 1  # UTF-8 stays below 255
            made.add(part)
        return made.array()

    def runs(self) -> Iterator[pa.RecordBatch]:
        core, around, n, begin = (np.concatenate(x) for x in zip(*self.numbers, strict=True))
        own, lo, hi, end, fine, alike = (np.concatenate(x) for x in zip(*self.cells, strict=True))
        self.cells = []
        order = np.lexsort((alike, fine))
        new_key = np.diff(fine[order], prepend=~fine[order[:1]]) != 0
        new = new_key | (np.diff(alike[order], prepend=~alike[order[:1]]) != 0)
        first = np.flatnonzero(new)  # groups of equal pieces
        size = np.diff(np.append(first, len(order)))
        count, key = np.add.reduceat(n[own[order]], first), (np.cumsum(new_key) - 1)[first]
        several = np.bincount(key)[key] > 1
        made = [self._members(order, first, size, np.flatnonzero(~several & (count > 1)), own, lo, hi, end, far) for far in range(len(self.lengths))]
        group = np.flatnonzero(several)
        if len(group):
            cell = order[first[group]]
            by_place = np.lexsort((lo[cell], own[cell]))
            group, cell = group[by_place], cell[by_place]
            a, b = _runs_of((own[cell[1:]] != own[cell[:-1]]) | (lo[cell[1:]] != hi[cell[:-1]] + 1) | (count[group[1:]] != count[group[:-1]]))
            text, left, sizes = own[cell[a]], lo[cell[a]], (end[cell[b]] - lo[cell[a]]).astype(np.int64)
            joint = self._text(begin[text] + left, sizes)
            found = repeated_starts(joint, sizes + 1, hi[cell[b]] - left, count[group[a]], self.lengths, self.memory_bytes)
            places = (own[cell] << 32) + lo[cell]
            for far, (piece, start) in enumerate(found):
                if not len(piece):
                    continue
                at = start + left[piece]
                mine = np.searchsorted(places, (text[piece] << 32) + at, side="right") - 1
                x, y = _runs_of((mine[1:] != mine[:-1]) | (at[1:] != at[:-1] + 1))
                of = mine[x]
                times = size[group[of]]
                k = np.repeat(np.arange(len(of)), times)
                member = order[first[group[of]][k] + np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)]
                shift = lo[member] - lo[cell[of]][k]
                made.append((own[member], at[x][k] + shift, at[y][k] + shift, np.full(len(k), bool(far))))
        text, lo, hi, far = (np.concatenate(x) for x in zip(*made, strict=True))
        if len(text):
            order = np.lexsort((lo, text, far))
            text, lo, hi, far = text[order], lo[order], hi[order], far[order]
            a, b = _runs_of((text[1:] != text[:-1]) | (far[1:] != far[:-1]) | (lo[1:] != hi[:-1] + 1))
            columns = [core[text[a]], around[text[a]], lo[a].astype(np.int32), hi[b].astype(np.int32), far[a]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["core", "around", "lo", "hi", "far"])

    def _members(self, order, first, size, groups, own, lo, hi, end, far: int) -> tuple[np.ndarray, ...]:
        """Runs of all pieces of groups, from end to end."""
        inside = np.zeros(len(first), dtype=bool)
        inside[groups] = True
        cell = order[np.repeat(inside, size)]
        last = np.minimum(hi[cell], end[cell] - self.lengths[far]) if far else hi[cell]
        some = last >= lo[cell]
        return own[cell][some], lo[cell][some], last[some], np.full(int(some.sum()), bool(far))


RUN = "core long, around long, lo int, hi int, far boolean"


def _sorter(lengths: tuple[int, ...], core: int, memory_bytes: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(lengths, core, memory_bytes)
        for batch in batches:
            if batch.num_rows:
                shard.add(batch)
        if shard.rows:
            yield from shard.runs()

    return sort


def _alike(distinct: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Runs of texts around cores that occur twice or more, from end to end."""
    ends = [(F.expr("at.last - at.first"), False)] + [(F.expr(f"least(at.last, at.stop - {x}) - at.first"), True) for x in lengths[1:]]
    runs = F.array(*(F.struct(F.lit(0).alias("lo"), hi.cast("int").alias("hi"), F.lit(far).alias("far")) for hi, far in ends))
    return distinct.select("core", "around", F.explode(runs).alias("r")).select("core", "around", "r.*").where("hi >= 0")


def repeated(
    docs: DataFrame, length: int = LENGTH, core: int = CORE, shard_bytes: int = SHARD_BYTES, root: str | None = None, longest: int | None = None,
    memory_bytes: int = induced.MEMORY_BYTES, hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """Runs of starts of repeated strings by document: _id, _hash, runs (array of lo, hi: first and last start; far: of
    strings of the longest length, else of `length`)."""
    spark = docs.sparkSession
    root, longest = root or common.shared_dir(spark), max(longest or length, length)
    lengths = (length, longest) if longest > length else (length,)
    texts = keyed(docs)
    records = common.store(texts.select(*KEYS, "text").mapInArrow(_emitter(length, longest, core), RECORD), "records", root)
    # what is joined is stored first, so that Spark can split a core with very many rows
    often = common.store(records.groupBy("core").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("core"), "often", root)
    found = common.store(records.join(often, "core", "left_semi"), "found", root)
    common.forget(spark, root, "records", "often")
    distinct = common.store(_distinct(found, F.count(F.lit(1))), "distinct", root)
    several = common.store(distinct.groupBy("core").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("core"), "several", root)
    mixed = common.store(distinct.join(several, "core", "left_semi"), "mixed", root)
    pieces, parts, total, split = pieces_of(texts, mixed, length, longest, core, hot_bytes, root)
    place = [F.col(f"at.{k}").alias(k) for k in PLACES]
    wanted = parts.groupBy(*(F.col(f"at.{k}").alias(k) for k in KEYS)).agg(F.collect_list(F.struct("core", "around", "n", *place)).alias("wanted"))
    # the same columns as where the texts are cut, so that they are shuffled once for both
    one_each = texts.join(wanted, KEYS).select("text", "wanted", *(c for c in docs.columns if c != "text"))
    shards = one_each.mapInArrow(_cutter, SNIPPET).repartition(max(1, -(-int(total) // shard_bytes)), "core")
    runs = shards.mapInArrow(_sorter(lengths, core, memory_bytes), RUN)
    if split:
        moved = (F.col("first") - F.col("first0")).alias("moved")
        back = pieces.select("core", "around", "core0", "around0", moved).join(common.store(runs.dropDuplicates(), "sorted", root), ["core", "around"])
        lo, hi = ((F.col(k) + F.col("moved")).alias(k) for k in ("lo", "hi"))
        runs = back.select(F.col("core0").alias("core"), F.col("around0").alias("around"), lo, hi, "far")
    alone = distinct.join(several, "core", "left_anti")
    runs = common.store(runs.unionByName(_alike(alone, lengths)).dropDuplicates(), "runs", root)
    hits = found.join(runs, ["core", "around"]).select(
        *KEYS, F.struct((F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"), "far").alias("run")
    )
    return hits.groupBy(*KEYS).agg(F.collect_set("run").alias("runs"))


def spans_of(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal covered byte ranges (row, start, end) of the runs of starts of a batch of rows."""
    order = np.lexsort((lo, row))
    row, lo, end = row[order], lo[order], hi[order] + length
    far = np.int64(1) << 40  # beyond any place in a text
    reach = np.maximum.accumulate(end + row * far) - row * far if len(row) else end
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (lo[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return row[first], lo[first], reach[np.append(first[1:], len(row)) - 1] if len(row) else reach


def _kept(data: np.ndarray, offsets: np.ndarray, spans: tuple, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """What is left of a batch's bytes, and its offsets; whole: without characters of which a byte is gone."""
    row, start, end = spans
    base = int(offsets[0])
    if whole:  # a span grows to the ends of characters, which have four bytes at most
        start, end, stop = offsets[row] + start, offsets[row] + end, offsets[row + 1]
        for _ in range(3):
            start = start - ((data[start] & 0xC0) == 0x80)
            end = end + ((end < stop) & ((data[np.minimum(end, stop - 1)] & 0xC0) == 0x80))
        start, end = start - offsets[row], end - offsets[row]
    edge = np.zeros(int(offsets[-1]) - base + 1, dtype=np.int8)
    edge[offsets[row] - base + start] += 1  # no two spans share a start or an end
    edge[offsets[row] - base + end] -= 1
    gone = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    part = data[base : int(offsets[-1])]
    left = np.cumsum(~gone, dtype=np.int32 if len(part) < 1 << 31 else np.int64)
    return part[~gone], np.where(offsets > base, left[np.maximum(offsets - base - 1, 0)] if len(left) else 0, 0)


def _column(kept: tuple[np.ndarray, np.ndarray], kind: pa.DataType) -> pa.Array:
    data, offsets = kept
    large = pa.large_string() if kind == pa.string() else pa.large_binary()
    return pa.Array.from_buffers(large, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(kind)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _remover(length: int, short: int | None, decoded: bool, given: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            data, offsets = hashing.text_bytes(batch.column(names.index("text")))
            runs = batch.column(names.index("runs"))
            run, row = runs.flatten(), np.repeat(np.arange(len(runs)), pa.compute.fill_null(pa.compute.list_value_length(runs), 0).to_numpy())
            lo, hi = (run.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "hi"))
            far = run.field("far").to_numpy(zero_copy_only=False).astype(bool)
            own = far == (short is not None)
            spans = spans_of(row[own], lo[own], hi[own], length)
            cuts = np.searchsorted(spans[0], np.arange(len(runs) + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(spans[1], pa.int64()), pa.array(spans[2], pa.int64())], ["start", "end"])
            made = {
                "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                "spans": pa.ListArray.from_arrays(pa.array(cuts), pairs).cast(SPANS),
                "kept": _column(_kept(data, offsets, spans, decoded), pa.string() if decoded else pa.binary()),
            }
            if short is not None:
                made["rest"] = _column(_kept(data, offsets, spans_of(row[~far], lo[~far], hi[~far], short), True), pa.string())
            columns = {k: c for k, c in zip(names, batch.columns, strict=True) if k != "runs" and (given or k != "text")} | made
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return remove


def remove_repeats(docs: DataFrame, length: int = LENGTH, root: str | None = None, decoded: bool = False, short: int | None = None, given: bool = False, **options) -> DataFrame:
    """The documents' other columns with n_bytes, spans (array of start, end) and kept (the remaining bytes).

    Decoded, kept is text without the characters of which a byte is gone. With a shorter length as well, `rest` is the
    text that is left, decoded, without strings of that length. `given`: text stays as well. A column named n_bytes, spans,
    kept or rest is dropped for the new one."""
    names = [c for c in docs.columns if c.lower() not in ("n_bytes", "spans", "kept", "rest", "text", "runs", "wanted", "_id", "_hash")]
    docs = docs.select(*names, "text")
    runs = repeated(docs, short or length, root=root, longest=length, **options)
    joined = keyed(docs).join(runs, KEYS, "left").select(*names, "text", "runs")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name in names or (given and f.name == "text")]
    kinds = [*fields, "n_bytes long, spans array<struct<start: long, end: long>>", "kept string" if decoded else "kept binary", *(["rest string"] if short else [])]
    return joined.mapInArrow(_remover(length, short, decoded, given), ", ".join(kinds))


def cleaned(docs: DataFrame, length: int = PASSAGE) -> DataFrame:
    """The documents without repeated bytes, with their columns: n_chars follows the text, a character of
    which a byte is gone is dropped, and documents without text left go."""
    out = remove_repeats(common.folded(docs, "doc_id", "text"), length, decoded=True)
    out = common.unfolded(out.withColumnRenamed("kept", "text").where(F.length("text") > 0), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes; what is left of a document as `text` (a character of which a byte is gone is U+FFFD); and, as
    `rest`, what is left of that without the strings of PASSAGE bytes that still occur more than once in it.

    Null texts have no bytes; null ids and repeated rows are documents like others; an empty table gives an empty one."""
    root = common.shared_dir(spark)
    out = remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"), root=root)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    own = [F.col("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]
    left = common.store(out.select("doc_id", F.struct(*own).alias("own"), text.alias("text")), "left", root)
    common.forget(spark, root, "found", "distinct", "several", "mixed", "runs")
    return remove_repeats(left, PASSAGE, decoded=True, given=True).select("doc_id", "own.*", "text", F.col("kept").alias("rest"))
