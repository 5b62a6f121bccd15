"""A network from layers against going through lines and places one by one."""

import math
import random

import pytest

from roadloom.operators import multimodal as M
from roadloom.operators.nearest import nearest_km

LINE, PLACE = "id long, pts array<struct<x: double, y: double>>, km double", "id long, x double, y double, name_of string"


def km(p, q):
    return 111.0 * math.hypot((p[0] - q[0]) * math.cos(math.radians((p[1] + q[1]) / 2)), p[1] - q[1])


def plain(lines, places, digits):
    key = lambda p: (round(p[0], digits), round(p[1], digits))
    lines = sorted(r for r in lines if r[0] is not None and r[1] and len(r[1]) > 1 and r[2] is not None)
    held = {}
    for i, pts, _ in lines:
        for p in pts:
            held.setdefault(key(p), set()).add(i)
    number, where, edges = {}, {}, {}

    def node(p):
        if key(p) not in number:
            number[key(p)] = len(number)
            where[number[key(p)]] = p
        return number[key(p)]

    for i, pts, official in lines:
        whole = max(sum(km(a, b) for a, b in zip(pts, pts[1:], strict=False)), 1e-9)
        stops = [j for j in range(len(pts)) if j in (0, len(pts) - 1) or len(held[key(pts[j])]) > 1]
        for s, (j, k) in enumerate(zip(stops, stops[1:], strict=False)):
            size = sum(km(a, b) for a, b in zip(pts[j:k], pts[j + 1 : k + 1], strict=True)) / whole * official
            if size > 0:
                u, v = node(pts[j]), node(pts[k])
                if u != v and size > edges.get((min(u, v), max(u, v)), (0,))[0]:
                    edges[min(u, v), max(u, v)] = (size, i, s)
    names = {n: f"J{i:03d}" for i, n in enumerate(sorted(where, key=lambda n: (*where[n], n)), 1)}
    ties = {}
    for i, (x, y, p) in enumerate(sorted((x, y, p) for p, x, y, _ in places if x is not None and y is not None), 1):
        near = min((round(km((x, y), q), 9), n) for n, q in where.items())
        ties[f"AP{i:03d}"] = (p, near[1], near[0])
    return where, names, edges, ties


def case(seed):
    """Lines over a small grid, so that vertices are shared; copies, loops, still lines, missing parts."""
    rnd = random.Random(seed)
    spot = lambda: (80 + rnd.randrange(9) * 0.25, 26 + rnd.randrange(9) * 0.5)
    lines = [(k, [spot() for _ in range(2 + k % 4)], float(rnd.randrange(1, 40))) for k in range(60)]
    lines += [(60, lines[5][1], 99.0), (61, lines[5][1], 99.0), (62, [(80.0, 26.0), (80.0, 26.0)], 3.0), (63, None, 1.0), (64, [(1.0, 1.0)], 1.0), (65, lines[3][1], None), (66, [(85.0, 27.0), (86.0, 27.0), (85.0, 27.0)], 8.0), (None, lines[2][1], 5.0), (67, [], 2.0)]
    places = [(k, rnd.uniform(79, 87), rnd.uniform(20, 34), "p") for k in range(40)] + [(50, None, 27.0, "q"), (51, 80.1, 26.1, "r"), (52, 80.1, 26.1, "s")]
    return lines, places


@pytest.mark.parametrize("seed", [1, 2])
def test_going_one_by_one(spark, seed):
    lines, places = case(seed)
    where, names, edges, ties = plain(lines, places, 5)
    nodes, roads = M.network(spark.createDataFrame(lines, LINE))
    assert {r.node: (r.x, r.y, r.name) for r in nodes.collect()} == {n: (*p, names[n]) for n, p in where.items()}
    assert {(r.u, r.v): (pytest.approx(r.km), r.id, r.segment) for r in roads.collect()} == edges
    found = M.tied(spark.createDataFrame(places, PLACE), nodes).collect()
    assert {r.name: (r.id, r.node, pytest.approx(r.km, abs=1e-6)) for r in found} == ties
    every = M.multimodal(spark.createDataFrame(lines, LINE), spark.createDataFrame(places, PLACE)).collect()
    assert sum(r.kind == M.ROAD for r in every) == len(edges) and len(every) == len(edges) + len(ties)


def test_nearest_by_km_far_north(spark):
    """Where degrees of longitude are short the nearest in degrees isn't the nearest in km."""
    rnd = random.Random(3)
    sites = [(k, rnd.uniform(0, 60), rnd.uniform(-20, 75)) for k in range(500)] + [(k, 30.0, 70.0) for k in range(500, 600)]
    points = [(k, rnd.uniform(0, 60), rnd.uniform(55, 80)) for k in range(120)]
    found = nearest_km(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(sites, "site long, x double, y double"), first=2).collect()
    assert {r.id: (pytest.approx(r.km, abs=1e-6), r.site) for r in found} == {i: min((round(km((x, y), s[1:]), 9), s[0]) for s in sites) for i, x, y in points}


def test_nothing(spark):
    lines, places = spark.createDataFrame([], LINE), spark.createDataFrame([(1, 80.0, 27.0, "p")], PLACE)
    assert M.multimodal(lines, places).collect() == [] and M.multimodal(lines, places.limit(0)).collect() == []
