"""Substring dedup by level-wise doubling: remove the words of windows that an earlier document has.

The first level looks at short windows of BASE words. Of the short windows within a full one, the one with
the smallest hash (the leftmost of equal ones) stands for it, so a level row is a run of starts that share a
short window (its key); equal full windows always share theirs. A first pass over the texts emits keys and ids alone; keys
that lie in one document alone are done. A second pass emits the runs of the others: it skips those whose key a Bloom
filter doesn't hold, or, where the filter would outgrow its bound, all runs are joined with the keys. Runs that read alike from
end to end count as one with the smallest and largest id that has them, so a group of copies costs one run from then on,
and a key whose runs all read alike is done as well. What is left is extended to twice the length, level by level, up to the full
window: a start goes on only while its window of that length lies in two documents.

Windows are told apart by two 64-bit hashes, that of the key and that of the window.

Defined results: a null text has no words; a null id counts as larger than every other id; windows of rows
with the same id don't remove each other; equal rows get equal answers; an empty table gives an empty one;
other columns are kept, except those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing
from .suffixes import KEYS, keyed

WINDOW = 13
BASE = 7
CHUNK_BYTES = 1 << 18
#: Bytes that a Bloom filter of keys may have at most; BITS of them for each key.
FILTER_BYTES, BITS, PROBES = 32 << 20, 12, 4
SEGMENT = 1 << 13  # bytes of the filter in which a key's bits lie


def levels(window: int, base: int) -> list[int]:
    """Lengths after the first: twice the one before, up to the full window."""
    out = [min(base, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out[1:] or [window]


class Filter:
    """A Bloom filter whose keys each keep to one segment."""

    def __init__(self, segments: np.ndarray):
        self.segments = segments

    @staticmethod
    def bits(keys: np.ndarray) -> list[np.ndarray]:
        """Places of a key's bits in its segment."""
        spread, width = hashing.mix(keys.view(np.uint64), 11), SEGMENT.bit_length() + 2
        return [((spread >> np.uint64(width * k)) & np.uint64(8 * SEGMENT - 1)).astype(np.int64) for k in range(PROBES)]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        rows, found = np.mod(keys, len(self.segments)), np.ones(len(keys), dtype=bool)
        for at in self.bits(keys):
            found &= (self.segments[rows, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of bits for each segment; the keys come sorted by segment."""
    held, own = np.zeros(SEGMENT, dtype=np.uint8), None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["segment", "bits"])

    for batch in batches:
        segment, keys = (batch.column(k).to_numpy() for k in (0, 1))
        cuts = [0, *(np.flatnonzero(segment[1:] != segment[:-1]) + 1).tolist(), len(segment)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if own is not None and own != int(segment[lo]):
                yield row()
                held[:] = 0
            own = int(segment[lo])
            for at in Filter.bits(keys[lo:hi]):
                np.bitwise_or.at(held, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
    if own is not None:
        yield row()


def filter_of(keys: DataFrame, n: int) -> Filter:
    """Built in tasks by segment; the driver gets no more than the filter's bounded bytes."""
    n_segments = max(1, -(-n * BITS // (8 * SEGMENT)))
    dealt = keys.select(F.pmod("key", F.lit(n_segments).cast("long")).alias("segment"), "key").repartition("segment").sortWithinPartitions("segment")
    bits = np.zeros((n_segments, SEGMENT), dtype=np.uint8)
    for row in dealt.mapInArrow(_segments, "segment long, bits binary").collect():
        bits[row["segment"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return Filter(bits)


def _runs(window: int, base: int, data: np.ndarray, offsets: np.ndarray) -> tuple | None:
    """Of a run of rows: words, the sums of their hashes, and first, end, row and key of every run of starts."""
    words = hashing.Words(data, offsets)
    n = len(words.start)
    if n < window:
        return None
    sums = hashing.prefix_sums(words.hashes())
    short = hashing.windows(sums, np.arange(n - base + 1), np.arange(base, n + 1))
    chosen = hashing.leftmost_minima(short, window - base + 1)
    row = words.row[: len(chosen)]
    fits = np.arange(len(chosen)) + window <= words.row_word[row + 1]
    new = np.ones(len(chosen), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1]) | (fits[1:] != fits[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(chosen))
    first, end = first[fits[first]], end[fits[first]]
    return words, sums, first, end, row[first], chosen[first], hashing.signed(short[chosen[first]])


def _keys(window: int, base: int):
    """Keys and ids."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = hashing.text_bytes(batch.column(2))
            for lo, hi in hashing.row_runs(offsets, CHUNK_BYTES):
                if (found := _runs(window, base, data, offsets[lo : hi + 1])) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(found[6]), pa.array(ids[lo:hi][found[4]])], ["key", "_id"])

    return emit


def _emitter(window: int, base: int, lengths: list[int], wanted):
    """Runs with the hashes of their starts' windows of every length to come."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offsets = hashing.text_bytes(batch.column(2))
            for lo, hi in hashing.row_runs(offsets, CHUNK_BYTES):
                if (found := _runs(window, base, data, offsets[lo : hi + 1])) is None:
                    continue
                words, sums, first, end, own, chosen, key = found
                if wanted is not None:
                    keep = wanted.value(key)
                    first, end, own, chosen, key = (x[keep] for x in (first, end, own, chosen, key))
                around = hashing.windows(sums, first, end - 1 + window) ^ (chosen - first).astype(np.uint64)
                n = end - first
                cuts = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                at = np.repeat(first - cuts[:-1], n) + np.arange(int(cuts[-1]))
                columns = [key, hashing.signed(around), ids[lo:hi][own], hashes[lo:hi][own], (first - words.row_word[own]).astype(np.int32), n.astype(np.int32)]
                columns = [pa.array(c) for c in columns]
                columns += [pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashing.signed(hashing.windows(sums, at, at + x)))) for x in lengths]
                yield pa.RecordBatch.from_arrays(columns, ["key", "around", "_id", "_hash", "first", "n", *(f"w{x}" for x in lengths)])

    return emit


def copied(docs: DataFrame, window: int = WINDOW, base: int = BASE, root: str | None = None, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Starts of windows that a smaller id has too, by document: _id, _hash, starts."""
    spark = docs.sparkSession
    root = root or common.shared_dir(spark)
    texts = keyed(docs).select(*KEYS, "text")
    base, lengths = min(base, window), levels(window, base)
    keys = texts.mapInArrow(_keys(window, base), "key long, _id long").groupBy("key").agg(F.min("_id").alias("a"), F.max("_id").alias("b"))
    shared = common.store(keys.where("a < b").select("key"), "shared", root)
    n_shared = shared.count()
    fits = n_shared * BITS <= 8 * filter_bytes
    wanted = spark.sparkContext.broadcast(filter_of(shared, n_shared)) if fits else None
    kinds = "key long, around long, _id long, _hash long, first int, n int, " + ", ".join(f"w{x} array<long>" for x in lengths)
    found = texts.mapInArrow(_emitter(window, base, lengths, wanted), kinds)
    found = common.store(found if fits else found.join(shared, "key", "left_semi"), "found", root)
    arrays = [F.first(f"w{x}").alias(f"w{x}") for x in lengths]  # alike in all runs that read alike
    distinct = found.groupBy("key", "around").agg(F.min("_id").alias("least"), F.max("_id").alias("most"), F.first("n").alias("n"), *arrays)
    distinct = common.store(distinct, "distinct", root)
    by_key = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("least").alias("a"), F.max("most").alias("b")).where("a < b")
    # stored, so that Spark can split a key with very many runs
    by_key = common.store(by_key.select("key", (F.col("k") > 1).alias("several")), "by_key", root)
    told = distinct.join(by_key, "key")
    hit = lambda off, first_id: F.struct(off.cast("int").alias("off"), first_id.alias("first_id"))
    alike = told.where("not several").select("key", "around", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: hit(k, F.col("least"))).alias("hits"))
    starts = told.where("several").select("key", "around", "least", "most", F.posexplode(F.arrays_zip(*(f"w{x}" for x in lengths))).alias("off", "w"))
    for x in lengths:
        same = ["key", F.col(f"w.w{x}").alias("h")]
        level = starts.groupBy(*same).agg(F.min("least").alias("first_id"), F.max("most").alias("last_id")).where("first_id < last_id")
        level = common.store(level.select("key", "h", "first_id"), f"level{x}", root)
        starts = starts.drop("first_id").withColumn("h", F.col(f"w.w{x}")).join(level, ["key", "h"]).drop("h")
    extended = starts.groupBy("key", "around").agg(F.collect_list(hit(F.col("off"), F.col("first_id"))).alias("hits"))
    hits = common.store(alike.unionByName(extended), "hits", root)
    common.forget(spark, root, "shared", "distinct", "by_key", *(f"level{x}" for x in lengths))
    own = found.select("key", "around", *KEYS, "first").join(hits, ["key", "around"]).select(
        *KEYS,
        F.transform(F.filter("hits", lambda h: h["first_id"] < F.col("_id")), lambda h: F.col("first") + h["off"]).alias("s"),
    )
    return own.where(F.size("s") > 0).groupBy(*KEYS).agg(F.flatten(F.collect_list("s")).alias("starts"))


def _remover(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            text, starts = (batch.column(names.index(k)) for k in ("text", "starts"))
            n_words, n_removed, kept = [], [], []
            for t, s in zip(text, starts, strict=True):
                words = (t.as_py() or "").encode().split()  # splits at the six white-space characters alone
                n_words.append(len(words))
                if s.is_valid:
                    cover = np.zeros(len(words) + 1, dtype=np.int32)
                    at = np.unique(s.values.to_numpy(zero_copy_only=False))
                    cover[at] += 1
                    np.add.at(cover, at + window, -1)
                    words = [w for w, c in zip(words, np.cumsum(cover).tolist(), strict=False) if not c]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            made = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
            made["kept"] = pa.array(kept, pa.binary()).cast(pa.string())
            columns = {k: c for k, c in zip(names, batch.columns, strict=True) if k not in ("text", "starts")} | made
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return remove


def remove_copied(docs: DataFrame, window: int = WINDOW, base: int = BASE, root: str | None = None, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The documents' other columns with n_words, n_removed and kept (the remaining words, one space between)."""
    taken = ("n_words", "n_removed", "kept", "text", "starts", "_id", "_hash")
    names = [c for c in docs.columns if c.lower() not in taken]
    docs = docs.select(*names, "text")
    joined = keyed(docs).join(copied(docs, window, base, root, filter_bytes), KEYS, "left").select(*names, "text", "starts")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name in names]
    return joined.mapInArrow(_remover(window), ", ".join([*fields, "n_words long, n_removed long, kept string"]))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the words that are left as `text`.

    Null texts have no words; null ids come last; an empty table gives an empty one."""
    out = remove_copied(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.col("kept").alias("text"))
