"""Forests, chains and bridges against plain Python on random graphs of several components."""

import random

import pytest

from roadloom.operators import forest
from roadloom.operators.prefix import numbered, running


def parts_of(nodes, edges):
    name = {n: n for n in nodes}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for u, v, _ in edges:
        a, b = find(u), find(v)
        name[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def graph(seed, n, m):
    rnd = random.Random(seed)
    nodes = [3 * k - 20 for k in range(n)]
    edges = [(rnd.choice(nodes), rnd.choice(nodes), f"e{k}") for k in range(m)]
    chain = nodes[: n // 3]
    edges += [(a, b, f"c{a}") for a, b in zip(chain, chain[1:], strict=False)]
    edges += [(edges[0][0], edges[0][1], "twin"), (nodes[-1], nodes[-1], "loop")]
    return nodes, edges


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 12, 6), (2, 40, 22), (3, 90, 60), (4, 60, 120), (5, 150, 20)])
def test_bridges_by_brute_force(spark, seed, n, m):
    nodes, edges = graph(seed, n, m)
    weight = {x: random.Random(x).randint(0, 9) for x in nodes}
    found = forest.bridges(spark.createDataFrame(edges, "u long, v long, id string"), spark.createDataFrame([*weight.items()], "node long, weight long")).collect()
    whole = parts_of(nodes, edges)
    wanted = {}
    for e in edges:
        after = parts_of(nodes, [x for x in edges if x is not e])
        if len(set(after.values())) > len(set(whole.values())):
            sides = {after[e[0]], after[e[1]]}
            wanted[e[2]] = sorted(sum(weight[x] for x in nodes if after[x] == s) for s in sides)
    assert {r.id: sorted((r.inside, r.outside)) for r in found} == wanted


def test_forest_spans(spark):
    nodes, edges = graph(7, 80, 70)
    tree, parts = forest.spanning(spark.createDataFrame(edges, "u long, v long, id string"), spark.createDataFrame([(x,) for x in nodes], "node long"))
    kept = [(r.u, r.v, r.id) for r in tree.collect()]
    wanted = parts_of(nodes, edges)
    assert len(kept) == len(nodes) - len(set(wanted.values())) and parts_of(nodes, kept) == wanted and set(kept) <= set(edges)
    found = {r.node: r.part for r in parts.collect()}
    assert len({(found[x], wanted[x]) for x in nodes}) == len(set(wanted.values()))


def test_tours_are_walks(spark):
    nodes, edges = graph(8, 50, 30)
    df = spark.createDataFrame(edges, "u long, v long, id string")
    tree, parts = forest.spanning(df, spark.createDataFrame([(x,) for x in nodes], "node long"))
    by_part = {}
    for r in forest.tours(tree, parts).orderBy("part", "place").collect():
        by_part.setdefault(r.part, []).append(r)
    for walk in by_part.values():
        assert [r.place for r in walk] == list(range(len(walk)))
        assert all(a.v == b.u for a, b in zip(walk, walk[1:], strict=False)) and walk[-1].v == walk[0].u


def test_ranks_of_chains(spark):
    rnd = random.Random(3)
    items = rnd.sample(range(10_000), 700)
    chains = [items[:1], items[1:3], items[3:300], items[300:]]
    rows = [(a, b, a % 7) for c in chains for a, b in zip(c, [*c[1:], None], strict=True)]
    out = {r.item: r for r in forest.list_ranks(spark.createDataFrame(rows, "item long, next long, w long"), "w").collect()}
    for c in chains:
        for k, x in enumerate(c):
            assert (out[x].last, out[x].steps, out[x].w) == (c[-1], len(c) - 1 - k, sum(y % 7 for y in c[k:]))


def test_empty_graphs(spark):
    no_edges = spark.createDataFrame([], "u long, v long, id string")
    assert forest.bridges(no_edges, spark.createDataFrame([(1, 2)], "node long, weight long")).collect() == []
    assert forest.list_ranks(spark.createDataFrame([], "item long, next long")).collect() == []


def test_row_numbers_and_running_sums(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, "a", "a", "a", "b"]), k, rnd.randint(-5, 5)) for k in rnd.sample(range(900), 500)]
    df = spark.createDataFrame(rows, "g string, k long, w long").repartition(7)
    out = running(numbered(df, ["k"], ["g"], total="n"), "place", {"sum": "w"}, ["g"], block=16).collect()
    assert len(out) == 500
    for r in out:
        before = [x for x in rows if x[0] == r.g and x[1] <= r.k]
        assert (r.place, r.n, r.sum) == (len(before) - 1, sum(x[0] == r.g for x in rows), sum(x[2] for x in before))
    alone = numbered(df, ["k"]).collect()
    assert sorted((r.k, r.place) for r in alone) == list(zip(sorted(x[1] for x in rows), range(500), strict=True))


def links_by_walks(edges):
    """Walks from junctions, in order: the reference of `contracted`, one at a time."""
    at = {}
    for u, v, i in edges:
        if u != v:
            at.setdefault(u, []).append((v, i))
            at.setdefault(v, []).append((u, i))
    ends = {n for n in at if len(at[n]) != 2}
    parts = parts_of(at, [e for e in edges if e[0] != e[1]])
    for p in set(parts.values()):
        own = [n for n in at if parts[n] == p]
        if not ends & set(own):
            ends.add(min(own))
    seen, walks = set(), []
    for s in sorted(ends):
        for v, i in sorted(at[s]):
            if i in seen:
                continue
            walk, here = [(s, v, i)], v
            seen.add(i)
            while here not in ends:
                nxt, j = next(x for x in at[here] if x[1] != walk[-1][2])
                walk.append((here, nxt, j))
                seen.add(j)
                here = nxt
            walks.append(walk)
    return walks


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_between_junctions(spark, seed):
    rnd = random.Random(seed)
    chain = lambda nodes, name: [(a, b, f"{name}{k:03d}") if rnd.random() < 0.5 else (b, a, f"{name}{k:03d}") for k, (a, b) in enumerate(zip(nodes, nodes[1:], strict=False))]
    ids = rnd.sample(range(1000), 300)
    edges = chain(ids[:90], "a") + chain([ids[10], *ids[90:130], ids[60]], "b") + chain([ids[20], *ids[130:150], ids[20]], "c")  # a loop at a junction
    edges += chain([*ids[150:220], ids[150]], "r") + chain([*ids[220:223], ids[220]], "s") + chain(ids[223:225], "t")  # rings, a road alone
    edges += [(ids[5], ids[5], "loop"), (ids[230], ids[231], "p1"), (ids[231], ids[230], "p2"), (ids[230], ids[232], "p3")]
    found = {}
    for r in forest.contracted(spark.createDataFrame(edges, "u long, v long, id string")).orderBy("link", "place").collect():
        found.setdefault(r.link, []).append((r.u, r.v, r.id))
    walks = sorted(links_by_walks(edges), key=lambda w: (w[0][0], w[0][1], w[0][2]))
    assert list(found.values()) == walks
