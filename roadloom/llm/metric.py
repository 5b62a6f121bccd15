"""Exact top-k search by inner product with M-trees.

Rows are dealt to metric shards: each goes to the nearest of at most PIVOTS pivots, which are rows of a random
sample (fitted on that many rows; every row is dealt and searched). Shards of a pivot have a bounded size, so one with
many rows, or with many copies of one vector, has several. A shard is loaded into an M-tree whose nodes are stored as
pages: an inner page holds pivots with the covering radius of each, its distance to the page's own pivot, its child
page; a leaf page holds vectors with their distances to the page's pivot.

A query is first asked of the shard whose centre has the highest product with it. Its k-th score there is a floor, and
the query is then asked of those shards alone whose covering radius lets a row reach the floor. Within a shard
pages are opened best first, the one with the highest bound next. An inner product is bounded by the triangle inequality,
q.x <= q.p + |q| d(p, x); with the stored distance to the parent's pivot, q.p is bounded likewise before it is computed, and
not computed if it can't matter. A search ends when no bound reaches the k-th score; bounds carry a slack above the
rounding of their sums, scores are exact whole numbers.

Defined results: rows with a null vector or a null or non-finite component take no part; candidates of another
length than the query's are not compared (empty vectors score 0 with each other); rows with the query's own id are not its candidates; an id that
repeats among the queries is asked once; a null id counts as the largest in ties and comes back as null; an
empty table gives an empty one; other columns are ignored. Whole components, and their products and sums, have to
fit 64 bits.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARD_ROWS = 4096
BLOCK_QUERIES = 4096
PIVOTS, PIVOT_BYTES = 256, 16 << 20
ROLL_SHARDS = 64
LEAF, FAN = 256, 16
SCALE = 1024
PAGES = "dim int, shard long, page int, leaf boolean, points binary, radii binary, distances binary, children binary, centre binary, radius double"


def whole_vectors(rows: DataFrame, id_col: str, vector: str, scale: int = SCALE, *carried: str) -> DataFrame:
    """id (a null as the largest number), v (whole components), carried columns, dim."""
    x = F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    # a NaN compares as larger than infinity
    sound = F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    kept = rows.where(sound).select(F.coalesce(F.col(id_col).cast("long"), F.lit(common.NULL_ID)).alias("id"), x.alias("v"), *carried)
    return kept.withColumn("dim", F.size("v"))


def _vectors(column: pa.Array, n: int) -> np.ndarray:
    """n vectors of one length, which may be 0."""
    numbers = column.flatten().to_numpy()
    return numbers.reshape(n, len(numbers) // max(n, 1))


def _distances(x: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - pivot) ** 2).sum(1))


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> list[dict]:
    """Pages of a tree over the vectors, the root first."""
    pages: list[dict] = []
    x = vectors.astype(np.float64)

    def page(rows: np.ndarray, pivot: np.ndarray) -> int:
        number = len(pages)
        pages.append({"page": number})
        if len(rows) <= leaf or len(groups := split(rows)) == 1:
            pages[number] |= {"leaf": True, "points": vectors[rows], "radii": np.zeros(0), "distances": _distances(x[rows], pivot), "children": ids[rows]}
            return number
        centres = np.stack([x[rows[g]].mean(0).round() for g in groups])
        radii = np.array([_distances(x[rows[g]], c).max() for g, c in zip(groups, centres, strict=True)])
        children = [page(rows[g], c) for g, c in zip(groups, centres, strict=True)]
        pages[number] |= {"leaf": False, "points": centres.astype(np.int64), "radii": radii, "distances": _distances(centres, pivot), "children": np.array(children)}
        return number

    def split(rows: np.ndarray) -> list[np.ndarray]:
        """Groups around pivots that lie far from each other; rows go to the nearest."""
        k = min(fan, -(-len(rows) // leaf) * 2)
        near = _distances(x[rows], x[rows].mean(0))
        owner = np.zeros(len(rows), dtype=np.int64)
        near[:] = _distances(x[rows], x[rows[int(near.argmax())]])
        for g in range(1, k):
            d = _distances(x[rows], x[rows[int(near.argmax())]])
            owner[d < near] = g
            near = np.minimum(near, d)
        return [g for g in (np.flatnonzero(owner == k) for k in range(k)) if len(g)]

    if len(ids):
        page(np.arange(len(ids)), x.mean(0).round())
    return pages


def _slack(norm, size):
    """Above the rounding of a bound on products of vectors of these lengths."""
    return 1.0 + 1e-9 * norm * (norm + size)


def search(pages: dict[int, dict], q: np.ndarray, q_id: int, k: int, floor: float, size: float) -> list[tuple[int, int]]:
    """The k best (score, id) of at least floor, ties to smaller ids; pages by number, each opened only if it may
    matter. No row is longer than size."""
    qf = q.astype(np.float64)
    norm = float(np.sqrt(qf @ qf))
    slack = _slack(norm, size)
    best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst on top
    # highest bound first; with it the product with the page's pivot, unknown for the root
    queue: list[tuple[float, int, float]] = [(-np.inf, 0, np.nan)]
    while queue:
        bound, number, product = heapq.heappop(queue)
        worst = best[0][0] if len(best) == k else floor
        if -bound < worst:
            break
        node = pages[number]
        reach = node["distances"] if node["leaf"] else node["distances"] + node["radii"]
        rows = np.arange(len(reach)) if np.isnan(product) else np.flatnonzero(product + norm * reach + slack >= worst)
        if not len(rows):
            continue
        if node["leaf"]:
            scores, ids = node["points"][rows] @ q, node["children"][rows]
            ok = (ids != q_id) & (scores >= worst)
            scores, ids = scores[ok], ids[ok]
            order = np.lexsort((ids, -scores))[:k]
            for s, i in zip(scores[order].tolist(), ids[order].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        else:
            products = node["float"][rows] @ qf
            upper = products + norm * node["radii"][rows] + slack
            for u, p, c in zip(upper.tolist(), products.tolist(), node["children"][rows].tolist(), strict=True):
                if u >= worst:
                    heapq.heappush(queue, (-u, c, p))
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def _builder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by dim and shard."""
    held: list[pa.RecordBatch] = []
    key = None

    def flush() -> pa.RecordBatch:
        ids = np.concatenate([b.column(2).to_numpy() for b in held])
        vectors = np.concatenate([_vectors(b.column(3), b.num_rows) for b in held])
        pages = build(ids, vectors)
        n = len(pages)
        columns = [pa.array([key[0]] * n, pa.int32()), pa.array([key[1]] * n, pa.int64())]
        columns += [pa.array([p["page"] for p in pages], pa.int32()), pa.array([p["leaf"] for p in pages])]
        columns += [pa.array([p[c].tobytes() for p in pages], pa.binary()) for c in ("points", "radii", "distances", "children")]
        x = vectors.astype(np.float64)
        centre = x.mean(0).round()
        # the root's page tells the ball around all of the shard
        columns.append(pa.array([centre.tobytes()] + [None] * (n - 1), pa.binary()))
        columns.append(pa.array([float(_distances(x, centre).max())] + [None] * (n - 1), pa.float64()))
        return pa.RecordBatch.from_arrays(columns, ["dim", "shard", "page", "leaf", "points", "radii", "distances", "children", "centre", "radius"])

    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in (0, 1)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            own = (int(keys[lo, 0]), int(keys[lo, 1]))
            if own != key and held:
                yield flush()
                held = []
            key = own
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield flush()


def _nearest(pivots: dict[int, np.ndarray]):
    """Add to dim, id, v the number of the nearest pivot of the same length, -1 if there is none."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            near = np.full(batch.num_rows, -1, dtype=np.int64)
            for dim in np.unique(dims).tolist():
                if dim in pivots and dim:
                    rows = np.flatnonzero(dims == dim)
                    x = _vectors(batch.column(2).take(pa.array(rows)), len(rows)).astype(np.float64)
                    p = pivots[dim]
                    near[rows] = ((p**2).sum(1) - 2.0 * (x @ p.T)).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], ["dim", "id", "v", "pivot"])

    return deal


def build_trees(vectors: DataFrame, shard_rows: int, root: str) -> DataFrame:
    """Stored pages of the trees of all shards."""
    rows, widest = vectors.agg(F.count("*"), F.max("dim")).head()
    n_pivots = min(PIVOTS, -(-rows // shard_rows), PIVOT_BYTES // (8 * max(widest or 1, 1)))
    pivots: dict[int, np.ndarray] = {}
    if n_pivots > 1:
        # at most PIVOTS vectors and PIVOT_BYTES bytes, whatever the table's size
        for r in vectors.orderBy(F.xxhash64("id", "v"), "id").limit(n_pivots).collect():
            pivots.setdefault(r["dim"], []).append(r["v"])
        pivots = {dim: np.unique(np.array(v, dtype=np.float64), axis=0) for dim, v in pivots.items()}
    dealt = vectors.select("dim", "id", "v").mapInArrow(_nearest(pivots), "dim int, id long, v array<long>, pivot long")
    # a row a pivot and length
    parts = dealt.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / F.lit(shard_rows)).alias("parts"))
    parts = common.store(parts, "parts", root)
    part = F.pmod(F.xxhash64("id", "v"), F.col("parts"))
    dealt = dealt.join(parts, ["dim", "pivot"]).select("dim", (F.col("pivot") * F.lit(1 << 32) + part).alias("shard"), "id", "v")
    dealt = dealt.repartition(max(1, -(-rows // shard_rows)), "dim", "shard").sortWithinPartitions("dim", "shard")
    return common.store(dealt.mapInArrow(_builder, PAGES), "pages", root)


def _router(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row is a block of queries and a roll of shards. A query without a floor names the shard whose centre has the
    highest product with it; one with a floor all shards where a row can reach it, but that it was asked of."""
    for batch in batches:
        out: list[tuple[np.ndarray, ...]] = []
        for row in range(batch.num_rows):
            queries, shards = batch.column(1)[row].values, batch.column(2)[row].values
            dim, number = batch.column(0)[row].as_py(), shards.field("shard").to_numpy()
            ids, floors, asked = (queries.field(c).to_numpy(zero_copy_only=False) for c in ("id", "floor", "first"))
            q = _vectors(queries.field("v"), len(ids)).astype(np.float64)
            centres = np.array([np.frombuffer(c, np.float64) for c in shards.field("centre").to_pylist()])
            radii, lengths, norms = shards.field("radius").to_numpy(), np.sqrt((centres**2).sum(1)), np.sqrt((q**2).sum(1))
            products = q @ centres.T
            bounds = products + norms[:, None] * radii + _slack(norms[:, None], lengths + radii)
            opened = (bounds >= floors[:, None]) & (number != asked[:, None])
            new = np.isnan(floors)
            opened[new, products[new].argmax(1)] = True
            at, s = np.nonzero(opened)
            out.append((np.full(len(at), dim, np.int32), ids[at], number[s], products[at, s]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["dim", "id", "shard", "product"])


def _routed(asked: DataFrame, rolls: DataFrame, n_rolls: int) -> DataFrame:
    """dim, id, shard, product: the shards that each query is to be asked of. Blocks of queries meet rolls of shards, both of a
    bounded size; a block goes to every roll, and rolls are dealt to tasks."""
    blocks = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v", "floor", "first")).alias("queries"))
    blocks = blocks.withColumn("roll", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rolls - 1).cast("long"))))
    pairs = blocks.join(rolls, ["dim", "roll"]).select("dim", "queries", "shards")
    return pairs.mapInArrow(_router, "dim int, id long, shard long, product double")


def _answer(k: int):
    def answer(_, trees: pa.Table, asks: pa.Table) -> pa.Table:
        pages, out, size = {}, [], 0.0
        for p in trees.to_pylist() if asks.num_rows else []:
            node = {"leaf": p["leaf"], "points": np.frombuffer(p["points"], np.int64).reshape(len(p["children"]) // 8, p["dim"])}
            node |= {c: np.frombuffer(p[c], np.float64) for c in ("radii", "distances")}
            node["children"] = np.frombuffer(p["children"], np.int64)
            node["float"] = None if p["leaf"] else node["points"].astype(np.float64)
            pages[p["page"]] = node
            if p["centre"] is not None:
                size = float(np.sqrt((np.frombuffer(p["centre"], np.float64) ** 2).sum())) + p["radius"]
        for row in asks.to_pylist() if pages else []:
            floor = -np.inf if math.isnan(row["floor"]) else row["floor"]
            out += [(row["id"], i, s) for s, i in search(pages, np.array(row["v"], dtype=np.int64), row["id"], k, floor, size)]
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return answer


def _answered(pages: DataFrame, asked: DataFrame, routed: DataFrame, k: int, root: str, name: str) -> DataFrame:
    """query_id, vec_id, score: the best rows of each shard that a query is asked of."""
    asks = common.store(routed.select("id", "dim", "shard").join(asked.select("id", "block", "v", "floor"), "id"), name, root)
    group = ["dim", "shard", "block"]
    # the pages of a shard go to every block that asks it, and a block has a bounded size
    opened = pages.join(asks.select(*(F.col(c).alias(c) for c in group)).distinct(), ["dim", "shard"])
    found = opened.groupBy(*group).cogroup(asks.groupBy(*group)).applyInArrow(_answer(k), "query_id long, vec_id long, score long")
    return common.store(found, f"{name}_found", root)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, root: str | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows."""
    root = root or common.shared_dir(rows.sparkSession)
    pages = build_trees(whole_vectors(rows, id_col, vector), shard_rows, root)
    asked = whole_vectors(queries, id_col, vector).dropDuplicates(["id"])
    n_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    balls = pages.where("centre IS NOT NULL").select("dim", "shard", "centre", "radius")
    n_rolls = max(1, -(-balls.count() // ROLL_SHARDS))
    rolls = balls.groupBy("dim", F.pmod(F.xxhash64("shard"), F.lit(n_rolls)).cast("long").alias("roll"))
    rolls = rolls.agg(F.collect_list(F.struct("shard", "centre", "radius")).alias("shards"))

    new = asked.withColumns({"floor": F.lit(float("nan")), "first": F.lit(None).cast("double")})
    best = F.max_by("shard", F.struct("product", "shard"))
    first = common.store(_routed(new, rolls, n_rolls).groupBy("dim", "id").agg(best.alias("shard")), "first", root)
    near = _answered(pages, new, first, k, root, "near")

    reached = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("_floor"))
    known = first.select("id", F.col("shard").cast("double").alias("first")).join(reached, F.col("id") == F.col("query_id"), "left")
    floored = known.select("id", "first", F.coalesce("_floor", F.lit(float("-inf"))).alias("floor"))
    floored = asked.join(floored, "id")
    far = _answered(pages, floored, _routed(floored, rolls, n_rolls), k, root, "far")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.union(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    number: Column = F.nullif(F.col("vec_id"), F.lit(common.NULL_ID))
    return ranked.select("query_id", "rank", number.alias("vec_id"), "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all. Null vectors and those with a null or non-finite component take no part; null
    ids are candidates that lose every tie; an empty table gives an empty one."""
    rows = common.table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 100 = 0"))


OP9_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
