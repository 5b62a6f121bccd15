"""Labels attached to areas, by brute force."""

import math
import random

import pytest

from roadloom.plans import catalog
from roadloom.operators.matching import attached

DATA = "/root/testdata/sf0.001"


def by_hand(labels, areas):
    near = {k: sorted((round(math.hypot(x - a, y - b), 9), j) for j, a, b in areas) for k, x, y in labels}
    taken, out = set(), set()
    for k in sorted(near, key=lambda k: (near[k][0][0], k)):
        free = [c for c in near[k] if c[1] not in taken]
        gap, area = (free or near[k])[0]
        taken.add(area)
        out.add((k, area, gap, not free))
    return out


@pytest.mark.parametrize("n,m", [(12, 12), (9, 20), (15, 6)])
def test_each_label_gets_its_own_area(spark, n, m):
    rnd = random.Random(n)
    labels, areas = ([(k, float(rnd.randrange(9)), float(rnd.randrange(9))) for k in range(size)] for size in (n, m))
    frames = spark.createDataFrame([*labels, (99, None, 1.0)], "label long, x double, y double"), spark.createDataFrame(areas, "area long, x double, y double")
    assert {tuple(r) for r in attached(*frames).collect()} == by_hand(labels, areas)
    assert attached(frames[0], frames[1].limit(0)).collect() == attached(frames[0].limit(0), frames[1]).collect() == []


def test_a_thousand_labels(spark):
    """More than a thousand on both sides, a third of them in one spot."""
    rnd = random.Random(3)
    at = lambda k: (5.0, 5.0) if k % 3 == 0 and k < 60 else (rnd.uniform(0, 100), rnd.uniform(0, 100))
    labels, areas = ([(k, *at(k)) for k in range(size)] for size in (1150, 1050))
    frames = spark.createDataFrame(labels, "label long, x double, y double"), spark.createDataFrame(areas, "area long, x double, y double")
    assert {tuple(r) for r in attached(*frames).collect()} == by_hand(labels, areas)


def test_registered_labels(spark):
    rows = catalog.QUERIES["GE10_labels_attached"](spark, DATA).collect()
    assert sorted(r.area for r in rows) == sorted(r.label for r in rows) == list(range(25)) and not any(r.shared for r in rows)
