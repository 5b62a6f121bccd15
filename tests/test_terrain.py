"""Terrain from contours against brute force: crossings, copies, null levels, codes, fallbacks, nothing."""

import math
import random

import pytest

from roadloom.operators import terrain as T

BREAKS = {"low": (0.0, 100.0), "mid": (100.0, 200.0), "high": (200.0, 300.0)}
EDGE, CONTOUR = "id long, pts array<struct<x: double, y: double>>, source_code string, how_far int", "id long, pts array<struct<x: double, y: double>>, level double"


def gap(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / size)) if size else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def apart(a, b, c, d):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
        return 0.0
    return min(gap(a, c, d), gap(b, c, d), gap(c, a, b), gap(d, a, b))


def pairs(pts):
    return list(zip(pts, pts[1:], strict=False))


def centre(pts):
    sizes = [math.dist(a, b) for a, b in pairs(pts)]
    if not sum(sizes):
        return pts[0]
    return tuple(sum(s * (a[c] + b[c]) / 2 for s, (a, b) in zip(sizes, pairs(pts), strict=True)) / sum(sizes) for c in (0, 1))


def halfway(pts):
    left = sum(math.dist(a, b) for a, b in pairs(pts)) / 2
    for a, b in pairs(pts):
        size = math.dist(a, b)
        if left <= size and size:
            return tuple(a[c] + left / size * (b[c] - a[c]) for c in (0, 1))
        left -= size
    return pts[-1]


def plain(edges, contours, reach):
    contours = [c for c in contours if c[1] and len(c[1]) > 1]
    for key, pts, code, _ in edges:
        known = T.SOURCE_CODES.get((code or "").strip().upper())
        if known:
            yield key, None, known, "source"
        elif not contours or not pts or len(pts) < 2:
            yield key, None, "none", "default"
        else:
            near = [c[2] for c in contours if c[2] is not None and min(apart(*p, *q) for p in pairs(pts) for q in pairs(c[1])) <= reach]
            level = sum(near) / len(near) if near else min(contours, key=lambda c: (round(math.dist(halfway(pts), centre(c[1])), 9), c[0]))[2]
            name = next((k for k, (lo, hi) in BREAKS.items() if level is not None and lo <= level < hi), "high")
            yield key, level, name, "direct" if near else "nearest"


def line(rnd, x, y, step, n):
    out = [(x, y)]
    for _ in range(n - 1):
        out.append((out[-1][0] + rnd.uniform(-step, step), out[-1][1] + rnd.uniform(-step, step)))
    return out


def case(seed):
    """A third of the contours in one heap, a third copies of one line; short, long, upright, still and missing lines."""
    rnd = random.Random(seed)
    copy = line(rnd, 40.0, 40.0, 2, 3)
    contours = [(k, [line(rnd, rnd.gauss(20, 0.5), rnd.gauss(20, 0.5), 0.3, 3), copy, line(rnd, rnd.uniform(0, 80), rnd.uniform(0, 80), 3, 4)][k % 3], None if k % 11 == 0 else float(rnd.randrange(-20, 340))) for k in range(240)]
    contours += [(900, None, 5.0), (901, [(1.0, 1.0)], 5.0), (902, [(60.0, 5.0), (60.0, 5.0)], 250.0)]
    edges = [(k, line(rnd, rnd.uniform(0, 80), rnd.uniform(0, 80), 30 if k % 9 == 0 else 2, 2 + k % 3), [None, "", " p", "S", "xx", "q", "?", "-"][k % 8], k) for k in range(100)]
    edges += [(200, edges[0][1], None, 0), (200, edges[0][1], None, 0), (201, [(20.0, 0.0), (20.0, 60.0)], None, 0), (202, [(20.0, 20.0), (20.0, 20.0)], "", 0), (203, None, None, 0), (204, [(2.0, 2.0)], "m", 0), (205, [], "", 0)]
    return edges, contours


@pytest.mark.parametrize(("seed", "reach"), [(1, 0.5), (2, 3.0), (3, 0.01)])
def test_by_brute_force(spark, seed, reach):
    edges, contours = case(seed)
    found = T.assigned(spark.createDataFrame(edges, EDGE), spark.createDataFrame(contours, CONTOUR), reach, BREAKS, "none").collect()
    wanted = sorted(plain(edges, contours, reach), key=lambda r: r[0])
    found = sorted(found, key=lambda r: r.id)
    assert {r.how for r in found} == {"source", "direct", "nearest", "default"}
    assert [(r.id, r.terrain, r.how) for r in found] == [(w[0], w[2], w[3]) for w in wanted]
    assert [r.elevation_m for r in found] == [w[1] if w[1] is None else pytest.approx(w[1]) for w in wanted]
    assert {r.how_far for r in found} == {e[3] for e in edges}


def test_without_contours(spark):
    edges, _ = case(4)
    found = T.assigned(spark.createDataFrame(edges, EDGE), spark.createDataFrame([], CONTOUR), 1.0, BREAKS, "none").collect()
    assert sorted((r.id, r.elevation_m, r.terrain, r.how) for r in found) == sorted(plain(edges, [], 1.0))
    assert T.assigned(spark.createDataFrame([], EDGE), spark.createDataFrame([], CONTOUR), 1.0, BREAKS, "none").collect() == []


def test_a_long_line_has_few_cells(spark):
    """A diagonal has cells along it, not those of its box."""
    df = spark.createDataFrame([(0.0, 0.0, 100.0, 100.0), (5.0, 0.0, 5.0, 100.0), (3.0, 3.0, 3.0, 3.0)], "ax double, ay double, bx double, by double")
    n = [len(r[0]) for r in df.select(T.cells(("ax", "ay", "bx", "by"), 1.0, 0.5)).collect()]
    assert n[0] < 600 and n[1] < 400 and n[2] < 10
