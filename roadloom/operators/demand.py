"""Demand-model operators: gravity, proportional fitting, entropy-prior least squares on counts."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from roadloom.sources.stored import Rounds, cut


def gravity(skim: DataFrame, zones: DataFrame, beta: float, scale: float = 1e6) -> DataFrame:
    """o, d, q: products of both activities times exp(-beta c). skim: o, d, c; zones: zone, activity."""
    a, b = zones.toDF("o", "a"), zones.toDF("d", "b")
    return skim.join(a, "o").join(b, "d").select("o", "d", (F.col("a") * F.col("b") / scale * F.exp(-beta * F.col("c"))).alias("q"))


def balanced(matrix: DataFrame, rows: DataFrame, columns: DataFrame, rounds: int = 200, tolerance: float = 1e-8) -> DataFrame:
    """Proportional fitting of (o, d, q) to row and column totals (zone, p).

    A round is one sum by row and one by column, each joined back; sums are combined before the shuffle, so
    a hot row is no hot task. Rounds end when both relative errors are within the tolerance."""
    matrix = cut(matrix)
    for _ in range(rounds):
        for key, goal in (("o", rows.toDF("o", "p")), ("d", columns.toDF("d", "p"))):
            factor = matrix.groupBy(key).agg(F.sum("q").alias("s")).join(goal, key).select(key, (F.col("p") / F.greatest("s", F.lit(1e-12))).alias("f"))
            matrix = matrix.join(factor, key).select("o", "d", (F.col("q") * F.col("f")).alias("q"))
        matrix = cut(matrix)
        if tolerance > 0:
            off = matrix.groupBy("o").agg(F.sum("q").alias("s")).join(rows.toDF("o", "p").where("p > 0"), "o")
            if (off.agg(F.max(F.abs(F.col("s") / F.col("p") - 1))).head()[0] or 0.0) <= tolerance:
                break
    return matrix


#: Lengths of steps that are tried at once.
LENGTHS = [2.0**-k for k in range(10)]


def _two_loops(gram: np.ndarray, memory: int) -> np.ndarray:
    """Coefficients of the quasi-Newton direction on (s_1 .. s_m, y_1 .. y_m, g), newest last, from their products alone."""
    out = np.zeros(2 * memory + 1)
    out[-1] = -1.0
    used = [k for k in range(memory) if gram[k, memory + k] > 1e-12 * max(gram[memory + k, memory + k], 1e-300)]
    alpha = {}
    for k in reversed(used):
        alpha[k] = out @ gram[:, k] / gram[k, memory + k]
        out[memory + k] -= alpha[k]
    if used:
        last = used[-1]
        out *= gram[last, memory + last] / gram[memory + last, memory + last]
    for k in used:
        out[k] += alpha[k] - out @ gram[:, memory + k] / gram[k, memory + k]
    return out


@dataclass
class Fit:
    """rows: pair, prior, estimate. gradient: the largest change that a unit step down the gradient makes within the bounds."""

    rows: DataFrame
    objective: float
    gradient: float
    iterations: int
    converged: bool


def entropy_least_squares(
    prior: DataFrame, incidence: DataFrame, goals: DataFrame, least: float = 1e-4, most: float = 1e4, steps: int = 200, tolerance: float = 1e-7, memory: int = 6
) -> Fit:
    """Minimises sum x (log(x / x0) - 1) + x0 + 1/2 sum ((P x - y) / sigma)^2 over x within least * x0 and most * x0.

    prior: pair, q (above 0); incidence: pair, target, p; goals: target, y, sigma. A limited-memory quasi-Newton method on
    z = log(x / x0), scaled by the curvature at the prior, with projection on the bounds: variables that the gradient presses
    against a bound are held, and steps are cut off at the bounds. Vectors are columns of a stored table of pairs; the two
    loops run on their products, which are summed while the table is written, so an iteration is two writes: the
    flows of the targets for several lengths of the step at once, then the vectors at the one that was taken. Only numbers of a fixed
    count reach the driver. A warning tells where `steps` iterations weren't enough."""
    lo, hi = float(np.log(least)), float(np.log(most))
    spark = prior.sparkSession
    rows = cut(incidence.join(goals, "target").select("pair", "target", "p", "y", (1 / F.pow("sigma", F.lit(2))).alias("w")))
    if rows.isEmpty():  # the prior is the optimum
        return Fit(prior.select("pair", F.col("q").alias("prior"), F.col("q").alias("estimate")), 0.0, 0.0, 0, True)
    curve = rows.groupBy("pair").agg(F.sum(F.col("p") * F.col("p") * F.col("w")).alias("c"))
    vectors = [f"s{k}" for k in range(memory)] + [f"y{k}" for k in range(memory)] + ["g"]
    held = F.when(((F.col("z") <= lo) & (F.col("g") > 0)) | ((F.col("z") >= hi) & (F.col("g") < 0)), F.lit(0.0))
    free = {v: held.otherwise(F.col(v)) for v in vectors}
    pairs = [(a, b) for i, a in enumerate(vectors) for b in vectors[i:]]
    slope = F.abs(F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("z") - F.col("gx"))) - F.col("z"))
    tables, flows = Rounds(spark), Rounds(spark)
    clipped = lambda c: F.greatest(F.lit(lo), F.least(F.lit(hi), c))

    def evaluated(state: DataFrame, lengths: list[float]) -> tuple[DataFrame, list[float], list[float]]:
        """Flows of the targets at each length of the step `dir`; the objective there, and what the gradient promises."""
        at = [clipped(F.col("z") + t * F.col("dir") / F.col("scale")) for t in lengths]
        x = [F.col("x0") * F.exp(z) for z in at]
        of_pairs, of_targets = Observation(), Observation()
        sums = [F.sum(x[j] * (z - 1) + F.col("x0")).alias(f"e{j}") for j, z in enumerate(at)] + [F.sum(F.col("g") * (z - F.col("z")) * F.col("scale")).alias(f"d{j}") for j, z in enumerate(at)]
        tried = state.observe(of_pairs, *sums).select("pair", *(c.alias(f"x{j}") for j, c in enumerate(x)))
        fits = rows.join(tried, "pair").groupBy("target", "y", "w").agg(*(F.sum(F.col("p") * F.col(f"x{j}")).alias(f"f{j}") for j in range(len(x))))
        fits = flows.keep(fits.observe(of_targets, *(F.sum(0.5 * F.col("w") * F.pow(F.col(f"f{j}") - F.col("y"), F.lit(2))).alias(f"c{j}") for j in range(len(x)))))
        e, c = of_pairs.get, of_targets.get
        return fits, [e[f"e{j}"] + (c[f"c{j}"] or 0.0) for j in range(len(x))], [e[f"d{j}"] for j in range(len(x))]

    def advanced(state: DataFrame, fits: DataFrame, j: int, length: float, first: bool) -> tuple[DataFrame, np.ndarray, float]:
        """The vectors after the step, their products over the free variables, and the size of the projected gradient."""
        pull = rows.join(fits.select("target", F.col(f"f{j}").alias("f")), "target").groupBy("pair").agg(F.sum(F.col("p") * F.col("w") * (F.col("f") - F.col("y"))).alias("pull"))
        new = state.join(pull, "pair", "left").withColumn("to", clipped(F.col("z") + length * F.col("dir") / F.col("scale")))
        new = new.withColumn("gx", F.col("to") + F.coalesce("pull", F.lit(0.0))).withColumn("to_g", F.col("x0") * F.exp("to") * F.col("gx") / F.col("scale"))
        shifted = {f"{v}{k}": (F.col(f"{v}{k + 1}") if k + 1 < memory else delta) for v, delta in (("s", (F.col("to") - F.col("z")) * F.col("scale")), ("y", F.col("to_g") - F.col("g"))) for k in range(memory)}
        kept = {} if first else shifted
        new = new.select("pair", "x0", "scale", "gx", F.col("to").alias("z"), F.col("to_g").alias("g"), *(kept.get(v, F.col(v)).alias(v) for v in vectors[:-1]))
        seen = Observation()
        new = tables.keep(new.observe(seen, F.max(slope).alias("slope"), *(F.sum(free[a] * free[b]).alias(f"{a}_{b}") for a, b in pairs)))
        got, gram = seen.get, np.zeros((len(vectors), len(vectors)))
        for a, b in pairs:
            i, k = vectors.index(a), vectors.index(b)
            gram[i, k] = gram[k, i] = got[f"{a}_{b}"] or 0.0
        return new, gram, got["slope"] or 0.0

    zero = F.lit(0.0)
    state = prior.join(curve, "pair", "left").select("pair", F.col("q").alias("x0"), F.sqrt(F.col("q") * (1 + F.col("q") * F.coalesce("c", zero))).alias("scale"), *(zero.alias(v) for v in ("z", "dir", *vectors)))
    fits, values, _ = evaluated(state, [0.0])
    value = values[0]
    state, gram, size = advanced(state, fits, 0, 0.0, True)
    done, fresh = 0, True
    while size > tolerance and done < steps and value is not None:
        weights = _two_loops(gram, memory)
        # products of nothing but the gradient: start with a step of length one
        if fresh:
            weights = weights / max(np.sqrt(gram[-1, -1]), 1.0)
        direction = sum((float(c) * free[v] for c, v in zip(weights, vectors, strict=True) if c), F.lit(0.0))
        moving = state.withColumn("dir", direction)
        fits, values, promised = evaluated(moving, LENGTHS)
        good = [j for j in range(len(LENGTHS)) if values[j] <= value + 1e-4 * min(promised[j], 0.0) and values[j] < value]
        if not good:
            if fresh:
                break  # the sums are not finer than this
            gram[: 2 * memory, :] = gram[:, : 2 * memory] = 0.0
            fresh = True
            continue
        j = min(good, key=lambda i: values[i])
        value = values[j]
        state, gram, size = advanced(moving, fits, j, LENGTHS[j], False)
        done, fresh = done + 1, False
    if size > tolerance:
        warnings.warn(f"not converged after {done} iterations: a projected gradient of {size:.3g}", stacklevel=2)
    return Fit(state.select("pair", F.col("x0").alias("prior"), (F.col("x0") * F.exp("z")).alias("estimate")), value or 0.0, size, done, size <= tolerance)
