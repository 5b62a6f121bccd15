"""Shares of shortest paths against a list of all of them, with many ties."""

import random
from collections import Counter

import pytest

from roadloom.operators.betweenness import betweenness


def paths(edges, s):
    """All shortest paths from s as lists of codes, by node."""
    best = {s: (0, [[]])}
    changed = True
    while changed:
        changed = False
        for u, v, w, code in edges:
            if u not in best:
                continue
            c = best[u][0] + w
            ways = [p + [code] for p in best[u][1]]
            if v not in best or c < best[v][0]:
                best[v], changed = (c, ways), True
            elif c == best[v][0] and v != s:
                more = [p for p in ways if p not in best[v][1]]
                if more:
                    best[v], changed = (c, best[v][1] + more), True
        # ways that were extended from longer ones are gone with them
        best = {v: (c, [p for p in ways if sum(cost[x] for x in p) == c]) for cost in [{e[3]: e[2] for e in edges}] for v, (c, ways) in best.items()}
    return best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shares_by_all_paths(spark, seed):
    rnd = random.Random(seed)
    edges = []
    for k in range(26):
        u, v = rnd.sample(range(14), 2)
        w = rnd.randint(1, 2)
        edges += [(u, v, w, f"e{k}"), (v, u, w, f"e{k}")]
    edges.append((90, 91, 1, "x"))
    sources, targets = [0, 1, 2, 90], [2, 3, 4, 5]
    wanted = Counter()
    for s in sources:
        best = paths(edges, s)
        for t in targets:
            if t != s and t in best:
                for p in best[t][1]:
                    for code in p:
                        wanted[code] += 1 / len(best[t][1])
    nodes = lambda x: spark.createDataFrame([(k,) for k in x], "node long")
    found = {r.code: r.share for r in betweenness(spark.createDataFrame([(u, v, float(w), c) for u, v, w, c in edges], "u long, v long, t double, code string"), nodes(sources), nodes(targets)).collect()}
    assert found == pytest.approx(dict(wanted))
