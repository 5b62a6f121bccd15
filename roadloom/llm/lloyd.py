"""Codes for vectors: every part of a vector is named by the nearest of a few entries, which are fitted by Lloyd's rounds with
filtering.

Rows are held in blocks of a bounded size, each with one kd-tree for every part position, built once and stored: a node has the
box around its points, their sum and their number. A round sends the entries (a fixed number of numbers) down every tree. At a
node the entry nearest to the middle of the box is compared with the others; one that no point of the box can be nearer to is
eliminated. Where one entry is left the whole subtree is its own, by its cached sum and number; only leaves with several are
compared point by point. What leaves a task is a sum and a number for each entry. All numbers are whole, so the rounds are exact
and don't depend on how rows are dealt.

Defined results: rows with a null vector or a null or non-finite component take no part, nor do vectors of another length than
that of the smallest id, or of one that the number of parts doesn't divide; a null id counts as the largest and comes back as
null; rows that repeat an id are rows of their own (the smaller vector first); with fewer rows than entries there are as many
entries as rows; null labels are one label; an empty table gives an empty one; other columns are ignored. Whole components,
squared distances and their sums have to fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, metric

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK_BYTES = 4 << 20
LEAF = 16
FIELDS = {"start": np.int64, "size": np.int64, "left": np.int64, "lo": np.int64, "hi": np.int64, "sums": np.int64, "order": np.int64, "points": np.int64}


@dataclass
class KdTree:
    """Nodes level by level, the root first. The points of a node are points[start : start + size]; `order` tells which
    rows they were; `left` is the first of two children that follow each other, or -1."""

    start: np.ndarray
    size: np.ndarray
    left: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    sums: np.ndarray
    order: np.ndarray
    points: np.ndarray

    @staticmethod
    def build(points: np.ndarray, leaf: int = LEAF) -> KdTree:
        order = np.arange(len(points))
        start, size = np.array([0]), np.array([len(points)])
        levels: list[tuple[np.ndarray, ...]] = []
        n_nodes = 1
        while len(start):
            first = np.cumsum(size) - size
            segment = np.repeat(np.arange(len(size)), size)
            rows = np.arange(len(segment)) - first[segment] + start[segment]
            x = points[order[rows]]
            lo, hi, sums = (f.reduceat(x, first, axis=0) for f in (np.minimum, np.maximum, np.add))
            split = (size > leaf) & (hi > lo).any(1)
            left = np.full(len(size), -1)
            left[split] = n_nodes + 2 * np.arange(split.sum())
            n_nodes += 2 * int(split.sum())
            levels.append((start, size, left, lo, hi, sums))
            # rows of a node by its widest dimension, then halves
            key = x[np.arange(len(x)), (hi - lo).argmax(1)[segment]]
            order[rows] = order[rows][np.lexsort((key, segment))]
            half = size[split] // 2
            start, size = (np.stack(pair, axis=1).ravel() for pair in ((start[split], start[split] + half), (half, size[split] - half)))
        return KdTree(*(np.concatenate(c) for c in zip(*levels, strict=True)), order, points[order])

    def assigned(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(nodes, entry of each) for whole subtrees and (places, entry of each) for points compared one by one."""
        at, open_ = np.zeros(1, dtype=np.int64), np.ones((1, len(entries)), dtype=bool)
        far = np.iinfo(np.int64).max
        none = np.zeros(0, dtype=np.int64)
        while len(at):
            lo, hi = self.lo[at], self.hi[at]
            middle = ((2 * entries[None] - (lo + hi)[:, None]) ** 2).sum(2)
            best = np.where(open_, middle, far).argmin(1)
            # the corner of the box that lies farthest towards an entry, seen from the best one
            corner = np.where(entries[None] > entries[best][:, None], hi[:, None], lo[:, None])
            gap = ((entries[None] - corner) ** 2).sum(2) - ((entries[best][:, None] - corner) ** 2).sum(2)
            loses = (gap > 0) | ((gap == 0) & (best[:, None] < np.arange(len(entries))))
            open_ &= ~loses
            single = open_.sum(1) == 1
            yield at[single], open_[single].argmax(1), none, none
            leaf = ~single & (self.left[at] < 0)
            if leaf.any():
                size = self.size[at[leaf]]
                own = np.repeat(np.flatnonzero(leaf), size)
                places = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + self.start[at[own]]
                distance = ((self.points[places][:, None] - entries[None]) ** 2).sum(2)
                yield none, none, places, np.where(open_[own], distance, far).argmin(1)
            down = ~single & ~leaf
            at = np.stack((self.left[at[down]], self.left[at[down]] + 1), axis=1).ravel()
            open_ = np.repeat(open_[down], 2, axis=0)

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the points of each entry."""
        counts, sums = np.zeros(len(entries), dtype=np.int64), np.zeros_like(entries)
        for nodes, of_nodes, places, of_places in self.assigned(entries):
            np.add.at(counts, of_nodes, self.size[nodes])
            np.add.at(sums, of_nodes, self.sums[nodes])
            np.add.at(counts, of_places, 1)
            np.add.at(sums, of_places, self.points[places])
        return counts, sums

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every row, in the order in which they came."""
        code = np.empty(len(self.order), dtype=np.int64)
        for nodes, of_nodes, places, of_places in self.assigned(entries):
            for k, e in zip(nodes.tolist(), of_nodes.tolist(), strict=True):
                code[self.start[k] : self.start[k] + self.size[k]] = e
            code[places] = of_places
        error = ((self.points - entries[code]) ** 2).sum(1)
        back = np.empty_like(self.order)
        back[self.order] = np.arange(len(back))
        return code[back], error[back]


def _planter(parts: int, block_bytes: int):
    """Blocks of rows (id, label, v), with a tree for each part position."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n_rows = 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            vectors = rows.column(2).flatten().to_numpy().reshape(rows.num_rows, -1)
            width = vectors.shape[1] // parts
            trees = [KdTree.build(np.ascontiguousarray(vectors[:, k * width : (k + 1) * width])) for k in range(parts)]
            whole = pa.array([0, rows.num_rows], pa.int32())
            columns = [pa.ListArray.from_arrays(whole, rows.column(k)) for k in (0, 1)]
            columns += [pa.array([[getattr(t, f).astype(kind).tobytes() for t in trees]], pa.list_(pa.binary())) for f, kind in FIELDS.items()]
            return pa.RecordBatch.from_arrays(columns, ["ids", "labels", *FIELDS])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                width = len(batch.column(2)[at])
                most = max(1, block_bytes // (8 * width))
                part = batch.slice(at, most - n_rows)
                held.append(part)
                n_rows += part.num_rows
                at += part.num_rows
                if n_rows >= most:
                    yield block()
                    held, n_rows = [], 0
        if held:
            yield block()

    return plant


def _trees(batch: pa.RecordBatch, row: int, width: int) -> list[KdTree]:
    """The trees of a stored block."""
    names = batch.schema.names
    fields = {}
    for f, kind in FIELDS.items():
        flat = [np.frombuffer(b.as_buffer(), dtype=kind) for b in batch.column(names.index(f))[row].values]
        fields[f] = [x.reshape(-1, width) if f in ("lo", "hi", "sums", "points") else x for x in flat]
    return [KdTree(*(fields[f][k] for f in FIELDS)) for k in range(len(fields["start"]))]


def _summer(shared):
    """part, entry, place, count, total: what a task's trees say of a round's entries, a row a number."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, entries, width = books.shape
        counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros_like(books)
        for batch in batches:
            for row in range(batch.num_rows):
                for k, tree in enumerate(_trees(batch, row, width)):
                    n, s = tree.totals(books[k])
                    counts[k] += n
                    sums[k] += s
        at = np.indices(books.shape).reshape(3, -1)
        columns = [*at, np.repeat(counts.ravel(), width), sums.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "place", "count", "total"])

    return add


def _coder(shared):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                found = [t.codes(b) for t, b in zip(_trees(batch, row, books.shape[2]), books, strict=True)]
                digits = np.char.mod("%02x", np.stack([c for c, _ in found], axis=1))
                names = ["".join(d) for d in digits.tolist()]
                error = np.sum([e for _, e in found], axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row].values, batch.column(1)[row].values, pa.array(names), pa.array(error)], ["id", "label", "code", "error"])

    return code


@dataclass
class Codes:
    """rows: id, label, code, error; books: parts x entries x places."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def start(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the first rows by id: a bounded number of rows comes to the driver."""
    first = vectors.where(F.col("dim") % parts == 0).where("dim > 0").orderBy("id", "v").select("v").limit(entries).collect()
    width = len(first[0].v) if first else 0
    rows = [r.v for r in first]
    if any(len(v) != width for v in rows):
        rows = [r.v for r in vectors.where(F.col("dim") == width).orderBy("id", "v").select("v").limit(entries).collect()]
    return np.array(rows, dtype=np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2) if rows else np.zeros((parts, 0, 0), dtype=np.int64)


def compress(
    table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    scale: int = SCALE, block_bytes: int = BLOCK_BYTES, root: str | None = None,
) -> Codes:
    spark = table.sparkSession
    root = root or common.shared_dir(spark)
    kind = table.schema[label].dataType.simpleString()
    own = table.select(F.col(id_col).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    vectors = metric.whole_vectors(own, "id", "vector", scale, "label")
    books = start(vectors, parts, entries)
    out = f"id long, label {kind}, code string, error long"
    if not books.shape[1]:
        return Codes(spark.createDataFrame([], out), books)
    rows = vectors.where(F.col("dim") == parts * books.shape[2]).select("id", "label", "v")
    fields = f"ids array<long>, labels array<{kind}>, " + ", ".join(f"{f} array<binary>" for f in FIELDS)
    trees = common.store(rows.mapInArrow(_planter(parts, block_bytes), fields), "trees", root)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        found = trees.select(*FIELDS).mapInArrow(_summer(shared), "part long, entry long, place long, count long, total long")
        found = found.groupBy("part", "entry", "place").agg(F.sum("count").alias("n"), F.sum("total").alias("total")).where("n > 0").collect()
        shared.unpersist()
        books = books.copy()
        for r in found:  # a number for each of the entries' places
            books[r.part, r.entry, r.place] = r.total // r.n
    coded = trees.mapInArrow(_coder(spark.sparkContext.broadcast(books)), out)
    return Codes(common.store(coded, "codes", root), books)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of the table. Null vectors and those with null or non-finite components take no part; null ids come
    back as null, null labels are one label; an empty table gives an empty one."""
    codes = compress(common.table(spark, sf_dir, "embeddings"))
    by_label = codes.rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    number: Column = F.nullif(F.col("id"), F.lit(common.NULL_ID))
    each = codes.rows.join(by_label.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label")))
    return each.select(number.alias("vec_id"), "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    return f""", a{k} AS (SELECT id, p, x, unnest(min_by) AS hit FROM (SELECT i.id, i.p, any_value(i.x) AS x, [arg_min({{'e': e, 'd': d}}, {{'d': d, 'e': e}})] AS min_by
  FROM (SELECT y.id, y.p, y.x, e, CAST(list_sum(list_transform(list_zip(y.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM y JOIN b{k} b USING (p)) i GROUP BY i.id, i.p))"""


OP13_SQL = (
    f"""WITH e AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 y AS (SELECT id, p, v[1 + p * len(v) // {PARTS} : (p + 1) * len(v) // {PARTS}] AS x FROM e, (SELECT unnest(range({PARTS})) AS p)),
 b0 AS (SELECT p, id - 1 AS e, x AS c FROM y WHERE id <= {ENTRIES})"""
    + "".join(
        _round_sql(k)
        + f""", m{k} AS (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS c FROM (SELECT p, hit.e AS e, j, sum(x[j]) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(c)) FROM b0) + 1)) AS j) GROUP BY ALL) GROUP BY p, e),
 b{k + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (p, e))"""
        for k in range(ROUNDS)
    )
    + _round_sql(ROUNDS)
    + f""", r AS (SELECT id, string_agg(printf('%02x', hit.e), '' ORDER BY p) AS code, CAST(sum(hit.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  sha256((SELECT string_agg(array_to_string(c, ','), ',' ORDER BY p, e) FROM b{ROUNDS})) AS codebooks_sha256 FROM e JOIN r USING (id)"""
)
