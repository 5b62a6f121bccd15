"""User equilibrium: flows at which no trip is faster by another path, with times that grow with the flow of a link.

Conjugate and bi-conjugate Frank-Wolfe steps over a stored table of links. A step loads all demand on the fastest paths at the
present times (searches are dealt to tasks, what leaves them is a sum for each link), mixes that with the last two aims by
products of the link table's columns, and looks for the length at which total time along the step is least.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from roadloom.sources.stored import Rounds, cut

from . import paths as P

#: Times grow as t0 (1 + ALPHA (flow / capacity) ** POWER).
ALPHA, POWER = 0.15, 4.0
#: Lengths of a step that are tried at once; a second pass looks between two of them.
GRID = 64


def link_time(flow: Column, alpha: float = ALPHA, power: float = POWER) -> Column:
    return F.col("t0") * (1 + alpha * F.pow(F.greatest(flow, F.lit(0.0)) / F.col("cap"), F.lit(power)))


@dataclass
class Equilibrium:
    """links: code, flow, time; gap: the share of total time that fastest paths would save; lost: demand without a path."""

    links: DataFrame
    gap: float
    iterations: int
    converged: bool
    lost: float


def _loaded(links: DataFrame, demand: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flows by code when all demand takes the fastest paths at the times of links, and (o, d, c, q) of what has a path."""
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("w")
    edges = links.select(ways, F.col("time").alias("w_time"), "code").select("w.u", "w.v", F.col("w_time").alias("w"), "code")
    found = P.searched(edges, cases, with_codes=True)
    trips = found.select(F.col("case").cast("long").alias("o"), F.col("node").alias("d"), "c", "codes").join(demand, ["o", "d"])
    return trips.select("q", F.explode("codes").alias("code")).groupBy("code").agg(F.sum("q").alias("aim")), trips


def _mixed(products: dict, first: bool, second: bool, step: float) -> tuple[float, float, float]:
    """Shares of the new load and of the last two aims in the next aim."""
    if first:
        return 1.0, 0.0, 0.0
    if not second:
        share = products["z_y"] / products["z_gap"] if abs(products["z_gap"]) > 1e-12 else 0.0
        share = float(np.clip(share if np.isfinite(share) else 0.0, 0.0, 0.99999))
        return 1.0 - share, share, 0.0
    step = float(np.clip(step, 1e-6, 0.99999))
    # x: what is left of the last two aims; w: from the last to the one before
    x_w = step * products["z_w"] + (1 - step) * products["v_w"]
    x_y = step * products["z_y"] + (1 - step) * products["v_y"]
    mu = max(0.0, -x_y / x_w) if abs(x_w) > 1e-12 else 0.0
    nu = max(0.0, -products["z_y"] / products["z_z"] + mu * step / (1 - step)) if abs(products["z_z"]) > 1e-12 else 0.0
    whole = 1.0 + mu + nu
    return 1.0 / whole, nu / whole, mu / whole


def user_equilibrium(links: DataFrame, demand: DataFrame, alpha: float = ALPHA, power: float = POWER, gap: float = 1e-4, steps: int = 100) -> Equilibrium:
    """links: u, v, code, t0, cap (both directions share a link's flow); demand: o, d, q.

    Ends when the relative gap is at most `gap`; a warning tells where `steps` weren't enough. Demand without a path is no flow."""
    demand = cut(demand.where("q > 0 and o <> d").groupBy("o", "d").agg(F.sum("q").alias("q")))
    none = F.lit(None)
    cases = cut(demand.groupBy("o").agg(F.collect_set("d").alias("targets")).select(F.col("o").cast("string").alias("case"), F.array(F.col("o").cast("long")).alias("seeds"), none.cast("array<string>").alias("banned"), "targets"))
    zero = F.lit(0.0)
    state = links.select("u", "v", "code", "t0", F.greatest("cap", F.lit(1.0)).alias("cap"), zero.alias("flow"), zero.alias("s1"), zero.alias("s2"), F.col("t0").alias("time"))
    rounds, tried = Rounds(links.sparkSession), Rounds(links.sparkSession)
    state = rounds.keep(state)
    load, trips = _loaded(state, demand, cases)
    lost = (demand.agg(F.sum("q")).head()[0] or 0.0) - (trips.agg(F.sum("q")).head()[0] or 0.0)
    state = rounds.keep(state.drop("flow", "time").join(load, "code", "left").select("u", "v", "code", "t0", "cap", F.coalesce("aim", zero).alias("flow"), "s1", "s2").withColumn("time", link_time(F.col("flow"), alpha, power)))
    size, done, length = np.inf, 0, 1.0
    for done in range(steps + 1):
        load, _ = _loaded(state, demand, cases)
        full = state.join(load, "code", "left").withColumn("aim", F.coalesce("aim", zero))
        curve = F.col("t0") * alpha * power * F.pow(F.greatest("flow", zero), F.lit(power - 1)) / F.pow("cap", F.lit(power))
        y, z, v = F.col("aim") - F.col("flow"), F.col("s1") - F.col("flow"), F.col("s2") - F.col("flow")
        w = F.col("s2") - F.col("s1")
        seen = Observation()
        named = {"z_y": z * y, "z_gap": z * (F.col("aim") - F.col("s1")), "z_z": z * z, "z_w": z * w, "v_w": v * w, "v_y": v * y}
        sums = [F.sum(c * curve).alias(n) for n, c in named.items()] + [F.sum(F.col("flow") * F.col("time")).alias("now"), F.sum(F.col("aim") * F.col("time")).alias("best")]
        full = tried.keep(full.observe(seen, *sums))
        got = {k: x or 0.0 for k, x in seen.get.items()}
        size = max(0.0, (got["now"] - got["best"]) / got["now"]) if got["now"] > 1e-12 else 0.0
        if size <= gap or done == steps:
            break
        shares = _mixed(got, done == 0, done > 1, length)
        for shares in (shares, (1.0, 0.0, 0.0)):
            target = shares[0] * F.col("aim") + shares[1] * F.col("s1") + shares[2] * F.col("s2")
            aimed = full.withColumn("target", target)
            length = _length(aimed, alpha, power)
            if length > 1e-10:
                break
        if length <= 1e-10:
            break
        flow = F.greatest(zero, F.col("flow") + length * (F.col("target") - F.col("flow")))
        state = rounds.keep(aimed.select("u", "v", "code", "t0", "cap", flow.alias("flow"), F.col("target").alias("s1"), F.col("s1").alias("s2")).withColumn("time", link_time(F.col("flow"), alpha, power)))
    if size > gap:
        warnings.warn(f"no equilibrium after {done} steps: a relative gap of {size:.3g}", stacklevel=2)
    return Equilibrium(state.select("code", "flow", "time"), float(size), done, size <= gap, float(lost))


def _length(aimed: DataFrame, alpha: float, power: float) -> float:
    """Where the derivative of total time along the step changes its sign, within 0 and 1: GRID values at once, and again
    between the two around the change; the line between those gives the rest."""
    lo, hi = 0.0, 1.0
    way = F.col("target") - F.col("flow")
    for _ in range(2):
        at = np.linspace(lo, hi, GRID + 1)
        slopes = np.array(aimed.agg(*(F.sum(link_time(F.col("flow") + float(a) * way, alpha, power) * way).alias(f"a{k}") for k, a in enumerate(at))).head(), dtype=float)
        if slopes[0] >= 0:
            return lo
        if slopes[-1] <= 0:
            return hi
        k = int(np.argmax(slopes > 0))
        lo, hi = float(at[k - 1]), float(at[k])
    return lo + (hi - lo) * float(-slopes[k - 1] / (slopes[k] - slopes[k - 1]))
