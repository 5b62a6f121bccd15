"""Best-fit packing: documents into as few sequences of a fixed size as bin completion finds.

Tokenising runs once, in tasks, and stores one row per piece with its length and its place among the
pieces of that length in its task. What the search sees is the histogram of lengths, at most
``capacity`` rows whatever the corpus. Bin completion branch-and-bound works on the histogram: it takes
the largest length left, enumerates undominated fillings around it, uses a filling as often as the
histogram allows, prunes by wasted space, and keeps best-fit-decreasing completions as incumbents. Every
use of a filling uses up one length, so a solution is a bounded table of patterns; pieces find their
sequence by their rank among the pieces of their length.
"""

from __future__ import annotations

import base64
import json
import math
import os
import re
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
END_ID = 0
#: Texts of these characters alone have the same ids by a tokenizer file and by its ranks.
PLAIN = re.compile("[\t\n\r\x20-\x7e\u00a0-\u024f\u2010-\u2027]*")


@dataclass(frozen=True)
class Effort:
    """Bounds of the search (of effort, not of rows; whatever they are, every piece is packed): nodes; of each node the
    fillings kept, the steps taken, the lengths tried at one place, and the fillings that do once one is full."""

    nodes: float = 3000
    fillings: float = 24
    steps: float = 400
    tried: float = 12
    enough: float = 4


#: Searches until the number of sequences is proven to be the least.
EXACT = Effort(*[math.inf] * 5)
Pattern = tuple[tuple[int, ...], int]  # the lengths of one sequence, the number of such sequences


def fillings(lengths: list[int], counts: dict[int, int], room: int, effort: Effort = Effort()) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated fillings of a room as (waste, lengths), least waste first. An item as large as the
    room dominates every other filling; a filling to which some item could be added is dominated by the
    larger one; and a filling is dominated by one that replaces one of its items with a larger one."""
    if counts.get(room, 0) > 0 or room == 0:
        return [(0, (room,) if room else ())]
    found: dict[tuple[int, ...], int] = {}
    steps = 0

    def extend(left: int, chosen: tuple[int, ...], most: int) -> None:
        nonlocal steps
        steps += 1
        tried = 0
        k = bisect_right(lengths, min(left, most)) - 1
        while k >= 0 and steps < effort.steps and len(found) < effort.fillings:
            x = lengths[k]
            k -= 1
            if counts[x] - chosen.count(x) <= 0:
                continue
            tried += 1
            rest = left - x
            if rest == 0 or counts.get(rest, 0) - (chosen + (x,)).count(rest) > 0:
                found[tuple(sorted((*chosen, x, rest) if rest else (*chosen, x), reverse=True))] = 0
            else:
                extend(rest, (*chosen, x), x)
            if tried > effort.tried or 0 in found.values() and len(found) > effort.enough:
                break
        if not tried and chosen:
            found.setdefault(tuple(sorted(chosen, reverse=True)), left)

    extend(room, (), room)
    if not found:
        return [(room, ())]
    ranked = sorted((waste, tuple(-x for x in f)) for f, waste in found.items())
    kept: list[tuple[int, tuple[int, ...]]] = []
    for waste, negative in ranked:
        f = tuple(-x for x in negative)
        if not any(len(f) == len(g) and all(a <= b for a, b in zip(f, g, strict=True)) for _, g in kept):
            kept.append((waste, f))
    return kept


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, on equal sequences at once."""
    open_: dict[int, list[list]] = {}  # room left -> [lengths, number of sequences]
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append([lengths, n])

    for x in sorted((x for x, c in counts.items() if c > 0), reverse=True):
        left = counts[x]
        at = bisect_right(rooms, x - 1)
        while left and at < len(rooms):
            room = rooms[at]
            groups = open_.pop(room)
            rooms.pop(at)
            fit, back = room // x, []
            for lengths, n in groups:
                full = min(n, left // fit)
                put(room - fit * x, lengths + (x,) * fit, full)
                left -= full * fit
                part = left if full < n and left else 0
                if part:
                    put(room - part * x, lengths + (x,) * part, 1)
                    left = 0
                if n - full - bool(part):
                    back.append([lengths, n - full - bool(part)])
            for lengths, n in back:
                put(room, lengths, n)
            at = bisect_right(rooms, x - 1)
            if not left:
                break
        fit = capacity // x
        put(capacity - fit * x, (x,) * fit, left // fit)
        if left % fit:
            put(capacity - left % fit * x, (x,) * (left % fit), 1)
    return [(tuple(lengths), n) for groups in open_.values() for lengths, n in groups]


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, effort: Effort = Effort()) -> list[Pattern]:
    """Patterns that use up the histogram (length: number of pieces, none longer than the capacity).

    The search dives once along the fillings of least waste, whatever best-fit gave, and prefers what it finds there to a
    best-fit solution of as many sequences; it goes on while the incumbent is above the bound."""
    counts = {x: int(c) for x, c in histogram.items() if c > 0 and x < capacity}
    whole = [((capacity,), int(histogram[capacity]))] if histogram.get(capacity) else []
    total = sum(x * c for x, c in counts.items())
    if not total:
        return whole
    least = -(-total // capacity)
    best = best_fit(counts, capacity)
    best_n = sum(n for _, n in best)
    nodes, dived = 0, False
    # depth first: (counts left, patterns so far, sequences used, tokens left)
    stack = [(counts, None, 0, total)]
    while stack and nodes < effort.nodes and (best_n > least or not dived):
        left, path, used, tokens = stack.pop()
        if used - (-tokens // capacity) >= best_n + (not dived):  # the space wasted so far rules a better end out
            dived = True
            continue
        nodes += 1
        if not left:
            best, best_n, dived = _unrolled(path), used, True
            continue
        if nodes % 16 == 1 and best_n > least:
            rest = best_fit(left, capacity)
            if used + sum(n for _, n in rest) < best_n:
                best, best_n = _unrolled(path) + rest, used + sum(n for _, n in rest)
        lengths = sorted(left)
        top = lengths[-1]
        without = dict(left)
        without[top] -= 1
        branches = []
        for _, filling in fillings(lengths, without, capacity - top, effort):
            pattern = (top, *filling)
            uses = Counter(pattern)
            most = min(left[x] // k for x, k in uses.items())
            # as often as it goes; an exact search may also use it once and choose anew
            for times in {1, most} if effort is EXACT else {most}:
                after = dict(left)
                for x, k in uses.items():
                    after[x] -= k * times
                    if not after[x]:
                        del after[x]
                branches.append((after, (path, (pattern, times)), used + times, tokens - times * sum(pattern)))
        stack += branches[::-1]  # least waste on top
    return whole + best


def _unrolled(path) -> list[Pattern]:
    out = []
    while path is not None:
        path, pattern = path
        out.append(pattern)
    return out[::-1]


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, sequence, offset): the pieces of a length with ranks from that one on lie
    at that offset of as many consecutive sequences. Sorted by length and rank."""
    rows, rank, sequence = [], Counter(), 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, rank[x], sequence, offset))
            rank[x] += n
            offset += x
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


class Encoder:
    """Ids of a text by a file of the tokenizers library; strings of its special tokens get those tokens' ids.

    With a rank file of the same vocabulary, texts of Latin letters and common punctuation without such strings, where both
    libraries are tested to agree, go through tiktoken, which takes a quarter of the time."""

    def __init__(self, path: str, ranks_path: str | None = None):
        self.path, self.tokenizer, self.fast = path, None, None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(path, encoding="utf-8") as f:
                self.special = [x["content"] for x in json.load(f).get("added_tokens", [])]
            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            ).encode_ordinary

    def ids(self, text: str) -> list[int]:
        if self.fast and PLAIN.fullmatch(text) and not any(x in text for x in self.special):
            return self.fast(text)
        if self.tokenizer is None:  # only when a text needs it, for its size
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def _cutter(tokenizer_path: str | None, capacity: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path, ranks = tokenizer_path, None
        if path is None:
            import public_tokenizers

            path, ranks = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
        encoder, seen, shard = Encoder(path, ranks), Counter(), TaskContext.get().partitionId()
        schema = pa.schema(
            [("doc_id", pa.int64()), ("piece", pa.int32())]
            + [(k, pa.int64()) for k in ("start", "length", "ids_crc32", "shard", "local")]
            + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
        )
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encoder.ids(text.as_py() or ""), END_ID], dtype="<u4")
                for k, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    own = ids[start : start + length]
                    row = [doc_id, k, start, length, zlib.crc32(own.tobytes()), shard, seen[length]]
                    rows.append(row + [own] if with_ids else row)
                    seen[length] += 1
                    size += 1 + with_ids * length
                if size > 1_000_000:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            yield _batch(rows, schema)

    return cut


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _placer(table):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        keys = rows[:, 0] * (1 << 48) + rows[:, 1]
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(k)).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            at = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            sequence = rows[at, 2] + rank - rows[at, 1]
            out = [c for c, n in zip(batch.columns, names, strict=True) if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(sequence), pa.array(rows[at, 3])], [n for n in names if n != "rank"] + ["sequence_id", "offset"]
            )

    return place


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer_path: str | None = None,
    with_ids: bool = False,
    root: str | None = None,
    effort: Effort = Effort(),
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).

    tokenizer_path is a file of the tokenizers library that every executor can open; by default the
    byte-level BPE of the installed public_tokenizers. A null or empty text is the end id alone. Null
    doc_ids and repeated rows are pieces like any other. Other columns are ignored. An empty table packs
    to an empty one.
    """
    spark = docs.sparkSession
    root = root or common.shared_dir(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, shard long, local long"
    pieces = common.store(
        rows.mapInArrow(_cutter(tokenizer_path, capacity, with_ids), kinds + ", ids array<int>" * with_ids), "pieces", root
    )
    per_shard = pieces.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most `capacity` rows, whatever the corpus
    histogram = {r["length"]: r["n"] for r in per_shard.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(complete_bins(histogram, capacity, effort)))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = per_shard.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["shard", "length"]).withColumn("rank", F.col("first") + F.col("local"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids
    return ranked.select(*columns, "rank").mapInArrow(_placer(table), kinds + "sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are the end id alone; null ids and repeated rows are pieces like others."""
    return pack(common.table(spark, sf_dir, "documents"))
