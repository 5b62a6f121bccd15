"""Entropy-prior least squares against a dense Newton method, free and at the bounds."""

import warnings

import numpy as np
import pytest

from roadloom.operators import demand
from roadloom.plans import calibration


def problem(seed, n=40, m=12):
    rng = np.random.default_rng(seed)
    p = (rng.random((m, n)) < 0.3) * rng.choice([0.5, 1.0, 2.0], (m, n))
    x0 = rng.lognormal(3, 1, n)
    y = p @ (x0 * rng.lognormal(0, 0.7, n)) + 1
    return p, x0, y, np.maximum(5.0, 0.2 * y)


def by_newton(p, x0, y, sigma, lo=-np.inf, hi=np.inf):
    z, w = np.zeros(len(x0)), 1 / sigma**2

    def value(z):
        x = x0 * np.exp(z)
        return (x * (z - 1) + x0).sum() + 0.5 * (w * (p @ x - y) ** 2).sum()

    for _ in range(500):
        x = x0 * np.exp(z)
        gx = z + p.T @ (w * (p @ x - y))
        g = x * gx
        held = ((z <= lo) & (g > 0)) | ((z >= hi) & (g < 0))
        # in x the problem is convex: the steps of z = log(x / x0) by its positive part
        h = np.diag(x) + (x[:, None] * (p.T * w) @ p * x)
        step = np.zeros_like(z)
        step[~held] = -np.linalg.solve(h[np.ix_(~held, ~held)], g[~held])
        t = 1.0
        while value(np.clip(z + t * step, lo, hi)) > value(z) and t > 1e-12:
            t /= 2
        z = np.clip(z + t * step, lo, hi)
    return x0 * np.exp(z), value(z)


def frames(spark, p, x0, y, sigma):
    prior = spark.createDataFrame([(f"p{k}", float(q)) for k, q in enumerate(x0)], "pair string, q double")
    rows = [(f"p{j}", f"t{i}", float(p[i, j])) for i, j in zip(*np.nonzero(p), strict=True)]
    goals = spark.createDataFrame([(f"t{i}", float(y[i]), float(sigma[i])) for i in range(len(y))], "target string, y double, sigma double")
    return prior, spark.createDataFrame(rows, "pair string, target string, p double"), goals


@pytest.mark.parametrize(("seed", "least", "most"), [(1, 1e-4, 1e4), (2, 0.7, 1.3)])
def test_fit_by_dense_newton(spark, seed, least, most):
    p, x0, y, sigma = problem(seed)
    fit = demand.entropy_least_squares(*frames(spark, p, x0, y, sigma), least, most)
    wanted, value = by_newton(p, x0, y, sigma, np.log(least), np.log(most))
    found = {r.pair: r.estimate for r in fit.rows.collect()}
    assert fit.converged and fit.gradient <= 1e-7
    assert fit.objective == pytest.approx(value, rel=1e-9)
    assert np.allclose([found[f"p{k}"] for k in range(len(x0))], wanted, rtol=1e-6)


def test_what_is_not_converged_is_told(spark):
    with pytest.warns(UserWarning, match="not converged after 1"):
        assert not demand.entropy_least_squares(*frames(spark, *problem(3)), steps=1).converged


def test_counts_of_the_network(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        fit = calibration.estimated(spark, "/root/testdata/sf0.001")
    assert fit.converged and fit.rows.where("estimate > 0").count() == fit.rows.count() > 0


def test_no_goals(spark):
    prior, rows, goals = frames(spark, *problem(4))
    fit = demand.entropy_least_squares(prior, rows.limit(0), goals)
    assert fit.converged and all(r.prior == r.estimate for r in fit.rows.collect())
