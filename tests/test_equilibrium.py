"""User equilibrium: a case with a known answer, Wardrop's condition on the network, demand without a path."""

import heapq

import pytest

from roadloom.operators import equilibrium as EQ
from roadloom.plans import routing
from roadloom.sources import network as N

DATA = "/root/testdata/sf0.001"


def fastest(edges, o):
    """Least times from o over (u, v, time) in both directions."""
    out, done, queue = {}, {}, [(0.0, o)]
    for u, v, t in edges:
        out.setdefault(u, []).append((v, t))
        out.setdefault(v, []).append((u, t))
    while queue:
        c, x = heapq.heappop(queue)
        if x not in done:
            done[x] = c
            for v, t in out.get(x, ()):
                heapq.heappush(queue, (c + t, v))
    return done


def test_two_routes_share_by_their_times(spark):
    """Between 1 and 2 one road of time 1 and a way of two halves: with linear times both take as long."""
    links = spark.createDataFrame([(1, 2, "a", 1.0, 10.0), (1, 3, "b", 0.6, 20.0), (3, 2, "c", 0.6, 20.0), (8, 9, "d", 1.0, 1.0)], "u long, v long, code string, t0 double, cap double")
    demand = spark.createDataFrame([(1, 2, 20.0), (2, 2, 5.0), (1, 9, 7.0)], "o long, d long, q double")
    found = EQ.user_equilibrium(links, demand, alpha=1.0, power=1.0, gap=1e-9)
    flow = {r.code: r.flow for r in found.links.collect()}
    # 1 + x / 10 = 1.2 (1 + (20 - x) / 20)
    x = 1.4 / 0.16
    assert found.converged and flow["a"] == pytest.approx(x, rel=1e-6) and flow["b"] == flow["c"] == pytest.approx(20 - x, rel=1e-6) and flow["d"] == 0
    assert found.lost == 7.0


def test_no_trip_has_a_faster_way(spark):
    roads, demand = routing.congested(spark, DATA).collect(), [r for r in N.demand(spark, DATA).collect() if r.q > 0]
    found = EQ.user_equilibrium(routing.congested(spark, DATA), N.demand(spark, DATA))
    at = {r.code: r for r in found.links.collect()}
    for r in roads:
        assert at[r.code].time == pytest.approx(r.t0 * (1 + EQ.ALPHA * (at[r.code].flow / r.cap) ** EQ.POWER))
    edges = [(r.u, r.v, at[r.code].time) for r in roads]
    best = {o: fastest(edges, o) for o in {r.o for r in demand}}
    spent, least = sum(r.flow * r.time for r in at.values()), sum(r.q * best[r.o][r.d] for r in demand if r.d in best[r.o])
    # all trips together lose less than the gap against their fastest ways, so none of weight does
    assert found.converged and found.gap <= 1e-4 and 0 <= (spent - least) / spent < 1.01e-4
    assert max(r.flow for r in at.values()) > 0 and any(r.time > 1.05 * x.t0 for x in roads for r in [at[x.code]])
