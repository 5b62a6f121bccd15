"""MinHash near-dedup with SetSketch registers.

One pass turns every document into the size, a 128-bit hash and the registers (`sketches`) of its set of word
shingles. Documents of one set are a class from then on, so exact copies cost nothing more. Bands of registers
put classes into buckets. Within a bucket no table of all pairs is made: every class is first paired with the
bucket's most popular one (whose buckets hold the most classes), pairs are estimated jointly by likelihood,
those that may reach the threshold are verified on the full sets of whole texts, and links become components.
In buckets that still hold more than one component, the classes outside the largest one visit all of the bucket's classes, in
blocks of a bounded number of bytes. Blocks carry the full sets, so a task verifies there and then, and hands on only
links that join components: rows grow with the classes of a bucket, not with its pairs.

A component's node is the smallest (id, hash of text) of each class, so the least node of a component is its head.

Defined results: null and empty texts have empty sets and are linked with nothing; a null id counts as larger
than every other id and comes back as null; repeated rows are members of one class; an empty table gives an
empty one; other columns are ignored by `components_of` and kept by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing, sketches
from .suffixes import KEYS, keyed

BANDS, ROWS = 26, 5
M = BANDS * ROWS
#: A similarity as whole percents: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Standard deviations by which an estimate may fall short of the threshold and still be verified (a chance of 1e-9 to
#: miss a pair); None verifies every pair that meets in a bucket.
MARGIN = 6.0
#: Bytes of sets in a block of a bucket.
BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 1 << 18
SETS = "_id long, _hash long, n long, cls binary, registers binary"


def node_of(id_: Column, hash_: Column) -> Column:
    """16 bytes that sort as the two numbers do."""
    part = lambda c: F.lpad(F.hex(c.bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), 63))), 16, "0")
    return F.unhex(F.concat(part(id_), part(hash_)))


def number_in(node: Column, which: int) -> Column:
    """The id (0) or the hash (1) of a node."""
    value = F.conv(F.hex(F.substring(node, 8 * which + 1, 8)), 16, 10).cast("decimal(20,0)")
    return (value - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")


def _sketcher(shingle: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = hashing.text_bytes(batch.column(2))
            for lo, hi in hashing.row_runs(offsets, CHUNK_BYTES):
                hashes, bounds = sketches.shingle_sets(data, offsets[lo : hi + 1], shingle)
                n = np.diff(bounds)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)))
                again = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashing.mix(hashes, 3), dtype=np.uint64)))
                cls = np.stack([total[bounds[1:]] - total[bounds[:-1]], again[bounds[1:]] - again[bounds[:-1]]], axis=1)
                registers = sketches.registers(hashes, bounds, M)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(n.astype(np.int64)),
                        _binary(cls.astype(">u8").tobytes(), 16, n == 0),
                        _binary(registers.tobytes(), M, n == 0),
                    ],
                    ["_id", "_hash", "n", "cls", "registers"],
                )

    return sketch


def _binary(data: bytes, width: int, null: np.ndarray) -> pa.Array:
    values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(data) // width, [None, pa.py_buffer(data)])
    return pa.compute.if_else(pa.array(null), pa.scalar(None, pa.binary()), values.cast(pa.binary()))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int, margin: float | None = MARGIN) -> np.ndarray:
    """Whether sets with these registers and sizes may have the similarity."""
    j = percent / 100
    out = np.minimum(n_a, n_b) >= j * np.maximum(n_a, n_b) - 1e-9
    rows = np.flatnonzero(out)
    if len(rows) and margin is not None:
        a, b = np.broadcast_to(a, b.shape)[rows], b[rows]
        larger, smaller = (a > b).sum(1), (a < b).sum(1)
        found = sketches.similarity(larger, smaller, a.shape[1] - larger - smaller, n_a[rows].astype(float), n_b[rows].astype(float))
        out[rows] = found >= j - margin * np.sqrt(j * (1 - j) / a.shape[1])
    return out


def _estimator(percent: int, margin: float | None):
    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(k).to_numpy() for k in (2, 3))
                ok = may_reach(_matrix(batch.column(4)), _matrix(batch.column(5)), n_a, n_b, percent, margin)
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in (0, 1)], ["a", "b"])

    return estimate


def _hasher(shingle: int):
    """The full set of a text: its distinct shingles' hashes, sorted, as bytes."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            data, offsets = hashing.text_bytes(batch.column(names.index("text")))
            for lo, hi in hashing.row_runs(offsets, CHUNK_BYTES):
                hashes, bounds = sketches.shingle_sets(data, offsets[lo : hi + 1], shingle)
                part = batch.slice(lo, hi - lo)
                sets = pa.array([hashes[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(k)) for k in ("node", "n", "registers")), sets], ["node", "n", "registers", "hashes"])

    return full


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok, pa.bool_())) for k in (0, 1)], ["a", "b"])

    return verify


def _shared(own: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a sorted set with the sets of the rows."""
    size = bounds[rows + 1] - bounds[rows]
    begin = np.cumsum(size) - size
    part = hashes[np.repeat(bounds[rows] - begin, size) + np.arange(int(size.sum()))]
    hit = own[np.minimum(np.searchsorted(own, part), len(own) - 1)] == part
    return np.add.reduceat(hit.astype(np.int64), begin)


class _Block:
    """Residents and visitors of one pair of blocks of a bucket."""

    def __init__(self, band: int, rows: list[dict]):
        self.band, self.node = band, [r["node"] for r in rows]
        names: dict[bytes, int] = {}
        self.label = np.array([names.setdefault(r["label"], len(names)) for r in rows])
        self.parent = list(range(len(names)))
        self.outside = np.array([r["outside"] for r in rows])
        self.visits = np.array([r["visits"] for r in rows])
        self.n = np.array([r["n"] for r in rows])
        self.order = np.argsort(np.argsort(np.array(self.node, dtype=object)))  # places of the nodes in order
        self.registers = np.frombuffer(b"".join(r["registers"] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
        self.hashes = np.frombuffer(b"".join(r["hashes"] for r in rows), dtype=np.uint64)
        self.bounds = np.concatenate(([0], np.cumsum([len(r["hashes"]) // 8 for r in rows])))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def links(self, percent: int, margin: float | None) -> Iterator[tuple[bytes, bytes]]:
        """Links that join components, each pair being seen in the first band that it shares."""
        residents = np.flatnonzero(~self.visits)
        for x in np.flatnonzero(self.visits).tolist():
            roots = np.array([self.root(k) for k in range(len(self.parent))])
            own = roots[self.label[x]]
            # two classes outside the largest component visit each other: once is enough
            rows = residents[(roots[self.label[residents]] != own) & (~self.outside[residents] | (self.order[residents] > self.order[x]))]
            if not len(rows):
                continue
            same = (self.registers[rows] == self.registers[x]).reshape(len(rows), BANDS, ROWS).all(2)
            rows = rows[same.argmax(1) == self.band]
            if len(rows):
                rows = rows[may_reach(self.registers[x], self.registers[rows], np.full(len(rows), self.n[x]), self.n[rows], percent, margin)]
            if not len(rows):
                continue
            mine = self.hashes[self.bounds[x] : self.bounds[x + 1]]
            both = _shared(mine, self.hashes, self.bounds, rows)
            for y in rows[100 * both >= percent * (self.n[x] + self.n[rows] - both)].tolist():
                a, b = self.root(self.label[x]), self.root(self.label[y])
                if a != b:
                    self.parent[a] = b
                    yield self.node[x], self.node[y]


def _comparer(percent: int, margin: float | None):
    """Links within (band, bucket, i, j) groups; the rows come sorted by group."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        key = None

        def flush() -> pa.RecordBatch:
            found = list(_Block(key[0], held).links(percent, margin))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                own = (row["band"], row["bucket"], row["i"], row["j"])
                if own != key and held:
                    yield flush()
                    held = []
                key = own
                held.append(row)
        if held:
            yield flush()

    return compare


def connected(links: DataFrame, root: str) -> DataFrame:
    """(u, label): the smallest node of every linked node's component, by alternating large and small stars.

    Rounds end when the edges are stars: every node has one edge up, and no centre has any."""
    spark = links.sparkSession
    edges = common.store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges0", root)
    step = 0
    while True:
        end = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
        ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).select("e.*")
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            return edges.select("u", F.col("v").alias("label"))
        step += 1
        way = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
        near = edges.select(F.explode(F.array(way("u", "v"), way("v", "u"))).alias("e")).select("e.*")
        # stored, so that Spark can split a node with very many neighbours in the joins
        least = common.store(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"least{step}", root)
        down = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = common.store(down, f"down{step}", root)
        least_down = common.store(down.groupBy("u").agg(F.min("v").alias("m")), f"small{step}", root)
        small = down.join(least_down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.store(small.unionByName(least_down.select("u", F.col("m").alias("v"))).distinct(), f"edges{step}", root)
        common.forget(spark, root, f"edges{step - 1}", f"least{step}", f"down{step}", f"small{step}")


def _buckets(classes: DataFrame) -> DataFrame:
    """A row per class and band: node, n, band, bucket."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("registers", k * ROWS + 1, F.lit(ROWS))))
    return classes.select("node", "n", F.posexplode(keys).alias("band", "bucket"))


def _visits(told: DataFrame, full: DataFrame, block_bytes: int, root: str) -> DataFrame:
    """Rows of the buckets with several components, dealt to pairs of blocks (i of residents, j of visitors)."""
    bucket = ["band", "bucket"]
    by_label = told.groupBy(*bucket, "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    mixed = by_label.groupBy(*bucket).agg(F.max(F.struct("c", "label", "n")).alias("main"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    blocks = lambda n: F.greatest(F.ceil(8 * n / F.lit(block_bytes)), F.lit(1)).cast("long")
    mixed = mixed.select(*bucket, F.col("main.label").alias("main"), blocks(F.col("all")).alias("n_i"), blocks(F.col("all") - F.col("main.n")).alias("n_j"))
    rows = told.join(common.store(mixed, "mixed", root), bucket).withColumn("outside", F.col("label") != F.col("main"))
    i, j = F.pmod(F.xxhash64("node"), F.col("n_i")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_j"))
    zero = F.lit(0).cast("long")
    at_home = F.transform(F.sequence(zero, F.col("n_j") - 1), lambda k: F.struct(i.alias("i"), k.alias("j"), F.lit(False).alias("visits")))
    away = F.when(F.col("outside"), F.transform(F.sequence(zero, F.col("n_i") - 1), lambda k: F.struct(k.alias("i"), j.alias("j"), F.lit(True).alias("visits"))))
    rows = rows.select(*bucket, "node", "label", "outside", F.explode(F.concat(at_home, F.coalesce(away, F.slice(at_home, 1, 0)))).alias("e"))
    return rows.select(*bucket, "e.*", "node", "label", "outside").join(full, "node")


def components_of(
    docs: DataFrame,
    percent: int = PERCENT,
    shingle: int = sketches.SHINGLE,
    root: str | None = None,
    margin: float | None = MARGIN,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A row per document: _id, _hash, n (size of its set), head_id, head_hash (its component's smallest key)."""
    spark = docs.sparkSession
    root = root or common.shared_dir(spark)
    texts = keyed(docs.select("doc_id", "text")).select(*KEYS, "text")
    sets = common.store(texts.mapInArrow(_sketcher(shingle), SETS), "sets", root)
    classes = sets.where("n > 0").groupBy("cls").agg(F.min(F.struct(*KEYS, "n", "registers")).alias("at")).select("cls", "at.*")
    classes = common.store(classes.withColumn("node", node_of(F.col("_id"), F.col("_hash"))), "classes", root)
    bucket = ["band", "bucket"]
    bands = _buckets(classes)
    sizes = bands.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = common.store(bands.join(sizes, bucket), "members", root)
    popular = members.groupBy("node").agg(F.sum("size").alias("pop"))
    some = classes.join(popular.select("node"), "node", "left_semi").select(*KEYS, "node", "n", "registers")
    full = texts.join(some, KEYS).dropDuplicates(KEYS).select("node", "n", "registers", "text")
    full = common.store(full.mapInArrow(_hasher(shingle), "node binary, n long, registers binary, hashes binary"), "full", root)

    centre = members.join(popular, "node").groupBy(*bucket).agg(F.max(F.struct("pop", "node")).alias("c"))
    centre = common.store(centre.select(*bucket, F.col("c.node").alias("c")), "centre", root)
    star = members.join(centre, bucket).where("node != c")
    star = star.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
    side = lambda k: full.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("registers").alias(f"r_{k}"))
    rows = star.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    likely = rows.mapInArrow(_estimator(percent, margin), "a binary, b binary")
    side = lambda k: full.select(F.col("node").alias(k), F.col("hashes").alias(f"h_{k}"))
    rows = likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "h_a", "h_b")
    links = common.store(rows.mapInArrow(_verifier(percent), "a binary, b binary"), "links_star", root)
    labels = connected(links, f"{root}/star")

    # the rest: buckets that still hold different components
    told = members.where("size > 2").join(labels.withColumnRenamed("u", "node"), "node", "left")
    told = common.store(told.select(*bucket, "node", "n", F.coalesce("label", "node").alias("label")), "told", root)
    group = [*bucket, "i", "j"]
    rows = _visits(told, full, block_bytes, root).select(*group, "visits", "node", "label", "outside", "n", "registers", "hashes")
    more = rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(_comparer(percent, margin), "a binary, b binary")
    more = common.store(more.distinct(), "links_rest", root)
    common.forget(spark, root, "members", "full", "centre", "told", "mixed")
    # a component of the first round is a star already
    labels = connected(labels.select(F.col("u").alias("a"), F.col("label").alias("b")).unionByName(more), f"{root}/all")
    head = classes.select("cls", "node").join(labels.withColumnRenamed("u", "node"), "node", "left")
    head = common.store(head.select("cls", F.coalesce("label", "node").alias("head")), "heads", root)
    every = sets.join(head, "cls", "left")
    return every.select(
        *KEYS, "n", F.coalesce(number_in(F.col("head"), 0), "_id").alias("head_id"), F.coalesce(number_in(F.col("head"), 1), "_hash").alias("head_hash")
    )


def deduplicated(docs: DataFrame, percent: int = PERCENT, root: str | None = None) -> DataFrame:
    """One document of every component, the one with the smallest id; documents without words all stay, and
    of repeated rows with words one stays."""
    found = components_of(docs, percent, root=root)
    keep = found.where("n = 0 or (_id = head_id and _hash = head_hash)").select(*KEYS, "n").distinct()
    joined = keyed(common.folded(docs, "doc_id", "text")).join(keep, KEYS)
    out = joined.where("n > 0").dropDuplicates(KEYS).unionByName(joined.where("n = 0"))
    return common.unfolded(out, docs)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component. Texts without words are alone; a null id comes last among equals and back as
    null; repeated rows share a component; an empty table gives an empty one."""
    found = components_of(common.table(spark, sf_dir, "documents"))
    number = lambda c: F.nullif(F.col(c), F.lit(common.NULL_ID))
    return found.select(
        number("_id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        number("head_id").alias("component_id"),
        (F.col("_id") == F.col("head_id")).alias("kept"),
    )
