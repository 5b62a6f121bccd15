"""Filtered Lloyd rounds against plain Python: the trees alone, the query, odd rows."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from roadloom.llm import lloyd

from .test_operators import DATA


def nearest(points, entries):
    d = ((points[:, None] - entries[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("seed", range(40))
def test_trees_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, width = int(rng.integers(1, 900)), int(rng.integers(1, 6))
    # few values: many ties, copies, boxes without extent
    points = rng.integers(-4, 5, (n, width)) if seed % 2 else rng.integers(-(10**6), 10**6, (n, width))
    if seed % 3 == 0:
        points[: n // 2] = points[0]
    entries = points[rng.integers(0, n, 16)] if seed % 4 else rng.integers(-5, 6, (16, width))
    tree = lloyd.KdTree.build(points, leaf=(1, 4, 16)[seed % 3])
    code, error = tree.codes(entries)
    wanted, distance = nearest(points, entries)
    assert (code == wanted).all() and (error == distance).all()
    counts, sums = tree.totals(entries)
    assert (counts == np.bincount(wanted, minlength=16)).all()
    assert all((sums[e] == points[wanted == e].sum(0)).all() for e in range(16))


def test_subtrees_are_assigned_at_once():
    rng = np.random.default_rng(5)
    centres = rng.integers(-1000, 1000, (16, 4)) * 1000
    points = centres[rng.integers(0, 16, 4000)] + rng.integers(-50, 50, (4000, 4))
    tree = lloyd.KdTree.build(points)
    compared = sum(len(places) for _, _, places, _ in tree.assigned(centres))
    assert compared < 400
    copies = lloyd.KdTree.build(np.repeat(points[:1], 5000, axis=0))
    assert len(copies.start) == 1


def by_brute_force(rows, parts=8, k=16, rounds=6):
    """rows: (vec_id, embedding, label)."""
    kept = []
    for i, e, label in rows:
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            kept.append((2**63 - 1 if i is None else i, [math.floor(4096 * float(np.float32(x))) for x in e], i, label))
    kept.sort(key=lambda r: r[:2])
    good = [r for r in kept if len(r[1]) and len(r[1]) % parts == 0]
    if not good:
        return []
    kept = [r for r in good if len(r[1]) == len(good[0][1])]
    x = np.array([r[1] for r in kept]).reshape(len(kept), parts, -1)
    books = x[:k].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for p in range(parts):
            code, _ = nearest(x[:, p], books[p])
            for e in set(code.tolist()):
                own = x[code == e, p]
                books[p, e] = [int(s) // len(own) for s in own.sum(0)]
    found = [nearest(x[:, p], books[p]) for p in range(parts)]
    error = sum(d for _, d in found)
    by_label = Counter()
    for r, e in zip(kept, error.tolist(), strict=True):
        by_label[r[3]] += e
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(((r[2], "".join(f"{int(found[p][0][n]):02x}" for p in range(parts)), int(error[n]), by_label[r[3]], sha) for n, r in enumerate(kept)), key=str)


def result(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((tuple(r) for r in lloyd.op13_vector_codes(spark, str(tmp_path)).collect()), key=str)


def test_query_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((tuple(r) for r in lloyd.op13_vector_codes(spark, DATA).collect()), key=str) == by_brute_force(rows)


KIND = "vec_id long, embedding array<float>, label int"
ROWS = [(k, [float((k * 7 + j * j) % 13) / 3 for j in range(16)], k % 3) for k in range(40)]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None, 1), (2, [None] * 16, 1), (3, [float("nan")] * 16, 1), (4, [float("inf")] + [0.0] * 15, None), (5, [], 1), (6, [1.0] * 12, 1)],
        ROWS[:5],
        ROWS + ROWS[:7] + [(None, [0.5] * 16, None), (None, [-0.5] * 16, None), (50, [1.0] * 8, 1), (51, [1.0] * 9, 1), (52, None, 2)],
        [(k, [1.5] * 16, 1) for k in range(300)],
    ],
)
def test_odd_rows(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS id", "1 AS v", "1 AS code", "1 AS error")
    assert result(spark, df.repartition(3), tmp_path) == by_brute_force(rows)


def test_blocks_and_partitions_do_not_matter(spark):
    df = spark.createDataFrame(ROWS * 20, KIND)
    one = lloyd.compress(df.coalesce(1), block_bytes=1 << 20)
    many = lloyd.compress(df.repartition(7), block_bytes=2000)
    assert (one.books == many.books).all()
    key = lambda rows: sorted(tuple(r) for r in rows.collect())
    assert key(one.rows) == key(many.rows)
