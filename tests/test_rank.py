"""Ranks of random matrices against dense ones."""

import numpy as np
import pytest

from roadloom.operators.rank import rank
from roadloom.plans import calibration, routing


@pytest.mark.parametrize(("seed", "n", "m", "inner"), [(1, 12, 30, 30), (2, 25, 10, 10), (3, 20, 20, 6), (4, 1, 1, 1)])
def test_rank_by_dense_matrices(spark, seed, n, m, inner):
    rng = np.random.default_rng(seed)
    a = rng.integers(-2, 3, (n, m)) * (rng.random((n, m)) < 0.3) if inner == m else rng.integers(-2, 3, (n, inner)) @ rng.integers(-2, 3, (inner, m))
    cells = [(f"r{i}", int(j), int(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    cells += [(r, j, 3) for r, j, _ in cells[:2]] + [(r, j, -3) for r, j, _ in cells[:2]]  # of one place: summed
    assert rank(spark.createDataFrame(cells, "row string, col long, value long")) == np.linalg.matrix_rank(a)


def test_rank_of_the_incidence(spark):
    data = "/root/testdata/sf0.001"
    inc = routing.gr10_incidence(spark, data).collect()
    rows, cols = sorted({r.code for r in inc}), sorted({(r.a, r.b) for r in inc})
    a = np.zeros((len(rows), len(cols)))
    for r in inc:
        a[rows.index(r.code), cols.index((r.a, r.b))] = r.p
    found = calibration.QUERIES["M12_incidence_rank"](spark, data).head()
    assert (found.targets, found.pairs, found.rank) == (*a.shape, np.linalg.matrix_rank(a))
