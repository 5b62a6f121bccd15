"""The nearest sites against brute force: crowds, copies, segments, few sites."""

import math
import random

import pytest

from roadloom.operators import nearest as NN


def gap(p, s):
    (x, y), (ax, ay, bx, by) = p, s
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / size)) if size else 0.0
    return round(math.hypot(x - ax - t * dx, y - ay - t * dy), 9)


def crowd(rnd, n, grid=None):
    """A third of all in one spot, a third in a dense heap, the rest far apart."""
    out = []
    for k in range(n):
        x, y = [(3.5, 3.5), (rnd.gauss(10, 0.01), rnd.gauss(10, 0.01)), (rnd.uniform(-100, 100), rnd.uniform(-100, 100))][k % 3]
        out.append((round(x, grid), round(y, grid)) if grid is not None else (x, y))
    return out


@pytest.mark.parametrize(("seed", "n", "k", "grid"), [(1, 700, 1, None), (2, 900, 5, None), (3, 600, 24, 0), (4, 9, 3, None), (5, 1, 4, None)])
def test_points_by_brute_force(spark, seed, n, k, grid):
    rnd = random.Random(seed)
    sites = {i: (x, y, x, y) for i, (x, y) in enumerate(crowd(rnd, n, grid))}
    points = list(enumerate(crowd(rnd, 150, grid)))
    found = {}
    df = NN.nearest(spark.createDataFrame([(i, *p) for i, p in points], "id long, x double, y double"), spark.createDataFrame([(i, s[0], s[1]) for i, s in sites.items()], "site long, x double, y double"), k)
    for r in df.collect():
        found.setdefault(r.id, []).append((r.place, r.distance, r.site))
    for i, p in points:
        wanted = sorted((gap(p, s), j) for j, s in sites.items())[:k]
        assert sorted(found[i]) == [(m + 1, *w) for m, w in enumerate(wanted)]


def test_segments_by_brute_force(spark):
    rnd = random.Random(7)
    sites = []
    for k in range(800):
        x, y = rnd.uniform(0, 50), rnd.uniform(0, 50)
        reach = 40 if k % 50 == 0 else 1
        sites.append((f"s{k:03d}", x, y, x + rnd.uniform(-reach, reach), y + rnd.uniform(-reach, reach)))
    points = [(k, rnd.uniform(-20, 70), rnd.uniform(-20, 70)) for k in range(200)] + [(999, None, 1.0)]
    found = NN.nearest(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(sites, "site string, ax double, ay double, bx double, by double")).collect()
    assert {r.id: (r.distance, r.site) for r in found} == {i: min((gap((x, y), s[1:]), s[0]) for s in sites) for i, x, y in points if x is not None}


def test_nothing(spark):
    points, sites = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double"), spark.createDataFrame([], "site long, x double, y double")
    assert NN.nearest(points, sites).collect() == [] and NN.nearest(points.limit(0), points.withColumnRenamed("id", "site")).collect() == []


def test_a_point_meets_few_sites(spark):
    """Keys join boxes and sites; no plan pairs all points with all sites."""
    rnd = random.Random(9)
    sites = spark.createDataFrame([(i, rnd.uniform(0, 1), rnd.uniform(0, 1)) for i in range(6000)], "site long, x double, y double")
    points = spark.createDataFrame([(i, rnd.uniform(0, 1), rnd.uniform(0, 1)) for i in range(300)], "id long, x double, y double")
    df = NN.nearest(points, sites)
    assert df.count() == 300
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
