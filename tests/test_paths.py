"""Searches, alternatives and contracts by brute force and by the errors they must raise."""

import itertools
import math
import random

import pytest

from roadloom.operators import contracts as C
from roadloom.operators import paths as P
from roadloom.plans import catalog, routing
from roadloom.sources import network as N
from roadloom.sources.stored import shared_base

DATA = "/root/testdata/sf0.001"


def test_rounds_find_what_the_heap_finds(spark):
    e = routing.weighted(spark, DATA)
    cases = spark.createDataFrame(
        [("a", [0], None, None), ("b", [0, 6, 12], None, None), ("c", [3], ["NH03-004", "NH02-003"], None), ("d", [25], ["NH03-025"], [0, 26]), ("e", [99], None, None)],
        "case string, seeds array<long>, banned array<string>, targets array<long>",
    )
    rows = lambda df: sorted((r.case, r.node, round(r.c, 9), r.label, tuple(r.codes)) for r in df.collect())
    heap = rows(P.searched(e, cases, with_codes=True))
    assert heap == rows(P.searched(e, cases, with_codes=True, most=0)) and len(heap) > 80
    assert ("d", 26, 26) in [(c, n, n) for c, n, *_ in heap] and not [r for r in heap if r[0] == "d" and r[1] == 0]


def test_weights_by_halves_are_those_of_squaring():
    """On a chain, to the last digit; the same there and back; longer chains than squaring reaches are summed exactly."""
    rng = random.Random(2)
    for n in (1, 2, 5, 13, 31, 32):
        w = [rng.uniform(0.1, 3) for _ in range(n)]
        at = {(k, k): 0.0 for k in range(n + 1)} | {e: x for k, x in enumerate(w) for e in ((k, k + 1), (k + 1, k))}
        for _ in range(5):
            new = {}
            for (a, m), (b, c) in ((p, q) for p in at for q in at if p[1] == q[0]):
                new[a, c] = min(new.get((a, c), math.inf), at[a, m] + at[b, c])
            at = new
        assert P.by_halves(w) == at[0, n] == P.by_halves(w[::-1])
    assert P.by_halves([0.1] * 50) == math.fsum([0.1] * 50)


def test_alternatives_by_brute_force(spark):
    rng = random.Random(3)
    for trial in range(25):
        n = 6
        edges = [(u, v, round(rng.uniform(1, 3), 6), f"{u}-{v}") for u, v in itertools.permutations(range(n), 2) if rng.random() < 0.5]
        weight = {(u, v): w for u, v, w, _ in edges}
        every = []
        for m in range(n - 1):
            for inner in itertools.permutations([x for x in range(n) if x not in (0, n - 1)], m):
                path = [0, *inner, n - 1]
                if all(s in weight for s in zip(path, path[1:])):
                    every.append((sum(weight[s] for s in zip(path, path[1:])), [f"{a}-{b}" for a, b in zip(path, path[1:])]))
        every.sort()
        wanted = [p for p in every[:3] if p[0] <= 1.25 * every[0][0]] if every else []
        found = P.Compact(edges).alternatives(0, n - 1, 3, 1.25)
        assert [p for _, p in found] == [p for _, p in wanted], trial
        assert [c for c, _ in found] == pytest.approx([c for c, _ in wanted])


def test_route_shares_add_up(spark):
    rows = catalog.QUERIES["GR9_alternatives"](spark, DATA).collect()
    sums = {}
    for r in rows:
        sums[r.o, r.d] = sums.get((r.o, r.d), 0) + r.share
    assert all(abs(s - 1) < 1e-5 for s in sums.values())


def test_flows_pass_every_node_of_a_path(spark):
    hours = {(r.o, r.d): r.hours for r in catalog.QUERIES["GR6_paths"](spark, DATA).collect()}
    skim = {(r.o, r.d): r.hours for r in catalog.QUERIES["GR6_skim"](spark, DATA).collect() if r.o != r.d}
    assert hours.keys() == skim.keys() and all(abs(hours[k] - skim[k]) < 1e-3 for k in skim)


def test_contracts_fail_loudly(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "b")], "zone_id string, name string")
    with pytest.raises(ValueError, match="repeat"):
        C.zones(df, [])
    with pytest.raises(ValueError, match="no column"):
        C.renamed(df, {"count": ("aadt",)}, required=["count"])
    with pytest.raises(ValueError, match="no partner"):
        C.joined_whole(df, df.where("name = 'a'"), ["name"], "labels")
    with pytest.raises(ValueError, match="not a number"):
        C.clean_matrix(spark.createDataFrame([("a", "a", "0"), ("a", "b", "x"), ("b", "a", "1"), ("b", "b", "0")], "o string, d string, value string"))
    assert C.unique_names(["a", "A", "a" * 60, "a" * 60]) == ["a", "A_2", "a" * 55, "a" * 53 + "_2"]
    assert C.weights({"a": -1, "b": 0}) == {"a": -1, "b": 0}


def test_the_shared_folder_is_taken_as_it_is_named():
    class Session:
        def __init__(self, folder, master):
            self.conf, self.sparkContext = self, self
            self.folder, self.master = folder, master

        def get(self, _, default):
            return self.folder or default

    assert shared_base(Session("/data/shared/", "yarn")) == "/data/shared"
    assert shared_base(Session("store://bucket/x", "yarn")) == "store://bucket/x"
    assert shared_base(Session(None, "local[8]")).startswith("file:///tmp/")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="not set"):
            shared_base(Session(None, master))


def test_spread_samples_by_brute_force(spark):
    rows = catalog.QUERIES["T6_spread_sample"](spark, DATA).collect()
    zones = {r.zone: (r.lon, r.lat) for r in N.zones(spark, DATA).collect()}
    members = {}
    for r in spark.read.parquet(f"{DATA}/customer.parquet").collect():
        members.setdefault(r.c_nationkey, []).append((r.c_custkey, 80 + (r.c_custkey * 37 % 1000) / 120, 26 + (r.c_custkey * 91 % 1000) / 250))
    gap = lambda p, q: round(math.hypot(p[1] - q[1], p[2] - q[2]), 9)
    for zone, own in members.items():
        taken = [min(own, key=lambda p: (gap(p, (0, *zones[zone])), p[0]))]
        while len(taken) < 8:
            rest = [(min(gap(p, t) for t in taken), -p[0], p) for p in own]
            rest = [x for x in rest if x[0] > 0]
            if not rest:
                break
            taken.append(max(rest)[2])
        assert [r.id for r in sorted(rows, key=lambda r: r.place) if r.zone == zone] == [t[0] for t in taken]


def test_distinct_top_lines(spark):
    rows = sorted(catalog.QUERIES["T4_distinct_top"](spark, DATA).collect(), key=lambda r: r.place)
    assert [r.len for r in rows] == sorted((r.len for r in rows), reverse=True) and len(rows) <= 10
    regions = [r.region for r in rows]
    assert max(regions.count(x) for x in regions) <= 5
