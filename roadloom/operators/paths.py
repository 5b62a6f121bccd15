"""Searches with paths: from labelled seeds, without some links, to chosen targets; and alternatives of a path.

A case is a row: case, seeds (array of node), banned (array of codes, or null), targets (array of node, or null for all). Cases are
independent, so they are dealt to tasks. A network of at most MAX_EDGES edges is broadcast, and a task searches its cases with a
heap; a larger one is never gathered: all cases advance together, a join a round, from the nodes that the last round
improved. Both give the same rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.sources.stored import Rounds

#: Edges of a network that is broadcast (some 100 bytes each).
MAX_EDGES = 1_000_000
FOUND = "case string, node long, c double, label long, codes array<string>"


def by_halves(weights: list[float], rounds: int = 5) -> float:
    """A path's weight to the last digit as `rounds` of min-plus squaring give it: the least sum over all ways to halve the path, its
    halves, and so on. It is the same there and back; a sum from one end is not, so equal paths would differ by rounding.

    Paths of more links than squaring reaches get the exact sum, rounded once."""
    n, reach = len(weights), 1
    if n > 2**rounds:
        return math.fsum(weights)
    best = {(i, i): 0.0 for i in range(n + 1)} | {(i, i + 1): w for i, w in enumerate(weights)}
    for _ in range(rounds):
        spans = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 2 * reach) + 1)]
        halves = {(i, j): min(best[i, m] + best[m, j] for m in range(max(i, j - reach), min(j, i + reach) + 1)) for i, j in spans}
        best, reach = best | halves, 2 * reach
    return best[0, n]


def halved(paths: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys and c: the weight of every path (keys, codes) by halves. A code names one road, of one weight both ways."""
    size = edges.groupBy("code").agg(F.min("w").alias("w"))
    steps = paths.select(*keys, F.posexplode("codes").alias("k", "code")).join(size, "code")
    own = steps.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "w"))), lambda s: s["w"]).alias("w"))
    return own.select(*keys, F.udf(lambda w: by_halves(w), "double")("w").alias("c"))


class Compact:
    """A directed network in memory: per node its edges (next, weight, code)."""

    def __init__(self, edges: list[tuple[int, int, float, str]]):
        self.out: dict[int, list[tuple[int, float, str]]] = {}
        for u, v, w, code in sorted(edges):
            self.out.setdefault(u, []).append((v, w, code))

    def search(self, seeds: list[int], banned=frozenset(), targets=None, closed=frozenset()) -> dict[int, tuple]:
        """node: (weight, label, node before, code); ties go to the smaller label, then the smaller node before."""
        done: dict[int, tuple] = {}
        wanted = None if targets is None else set(targets)
        queue = [(0.0, s, -1, "", s) for s in sorted(seeds)]
        while queue and (wanted is None or wanted):
            c, label, before, code, x = heapq.heappop(queue)
            if x in done:
                continue
            done[x] = (c, label, before, code)
            if wanted is not None:
                wanted.discard(x)
            for v, w, by in self.out.get(x, ()):
                if v not in done and by not in banned and v not in closed:
                    heapq.heappush(queue, (c + w, label, x, by, v))
        return done

    @staticmethod
    def codes(done: dict[int, tuple], node: int) -> list[str]:
        out = []
        while done[node][3]:
            out.append(done[node][3])
            node = done[node][2]
        return out[::-1]

    def alternatives(self, o: int, d: int, k: int, most: float) -> list[tuple[float, list[str]]]:
        """The k lightest loop-free paths as (weight, codes), none above `most` times the lightest (Yen)."""
        done = self.search([o], targets=[d])
        if d not in done or o == d:
            return []
        weight = {(u, by): (v, w) for u, edges in self.out.items() for v, w, by in edges}
        found, spare, seen = [(done[d][0], self.codes(done, d))], [], set()
        while len(found) < k:
            codes, at, passed, spent = found[-1][1], o, {o}, 0.0
            for j in range(len(codes)):
                shared = codes[:j]
                banned = {p[j] for _, p in found if p[:j] == shared and len(p) > j}
                rest = self._from(at, d, banned, passed)
                if rest is not None and (tuple(path := shared + rest[1])) not in seen:
                    seen.add(tuple(path))
                    heapq.heappush(spare, (spent + rest[0], path))
                at, w = weight[at, codes[j]]
                spent += w
                passed.add(at)
            if not spare or spare[0][0] > most * found[0][0]:
                break
            found.append(heapq.heappop(spare))
        return found

    def _from(self, at: int, d: int, banned: set[str], passed: set[int]) -> tuple[float, list[str]] | None:
        """The lightest way on from a node of a path: not by the banned codes at first, nor through nodes passed."""
        best = None
        first = [(v, w, code) for v, w, code in self.out.get(at, ()) if code not in banned and v not in passed]
        for v, w, code in first:
            done = self.search([v], targets=[d], closed=passed)
            if d in done and (best is None or (w + done[d][0], [code]) < (best[0], best[1][:1])):
                best = (w + done[d][0], [code, *self.codes(done, d)])
        return best


def compact(edges: DataFrame, weight: str = "w", most: int = MAX_EDGES):
    """A broadcast network, or None where it has more edges than the bound."""
    rows = edges.where(F.col(weight) > 0).select("u", "v", F.col(weight).alias("w"), "code")
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        return None
    return edges.sparkSession.sparkContext.broadcast(Compact([tuple(r) for r in found]))


def _by_heap(network, with_codes: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for case, seeds, banned, targets in frame[["case", "seeds", "banned", "targets"]].itertuples(index=False):
                wanted = None if targets is None else [int(x) for x in targets]
                done = network.value.search([int(s) for s in seeds], frozenset(banned if banned is not None else ()), wanted)
                for node in done if wanted is None else [x for x in wanted if x in done]:
                    rows.append((case, node, done[node][0], done[node][1], Compact.codes(done, node) if with_codes else None))
            yield pd.DataFrame(rows, columns=["case", "node", "c", "label", "codes"])

    return run


def _by_rounds(edges: DataFrame, cases: DataFrame, weight: str, with_codes: bool) -> DataFrame:
    steps = edges.where(F.col(weight) > 0).select(F.col("u").alias("at"), F.col("v").alias("next"), F.col(weight).alias("w"), "code")
    rounds = Rounds(edges.sparkSession)
    none = F.array().cast("array<string>")
    first = cases.select("case", F.explode("seeds").alias("node")).select(
        "case", "node", F.lit(0.0).alias("c"), F.col("node").alias("label"), F.lit(-1).cast("long").alias("before"), none.alias("codes"), F.lit(True).alias("new")
    )
    state = rounds.keep(first.distinct())
    bans = cases.select("case", F.coalesce("banned", none).alias("banned"))
    while not state.where("new").isEmpty():
        reached = state.where("new").join(steps, F.col("node") == F.col("at")).join(bans, "case").where(~F.array_contains("banned", F.col("code")))
        codes = F.concat("codes", F.array("code")) if with_codes else F.col("codes")
        reached = reached.select("case", F.col("next").alias("node"), (F.col("c") + F.col("w")).alias("c"), "label", F.col("node").alias("before"), codes.alias("codes"), F.lit(True).alias("new"))
        every = state.select("case", "node", "c", "label", "before", "codes", F.lit(False).alias("new")).unionByName(reached)
        best = every.groupBy("case", "node").agg(F.min(F.struct("c", "label", "before", "new", "codes")).alias("b"))
        state = rounds.keep(best.select("case", "node", "b.c", "b.label", "b.before", "b.codes", "b.new"))
    found = state.select("case", "node", "c", "label", F.col("codes") if with_codes else F.lit(None).cast("array<string>").alias("codes"))
    wanted = cases.select("case", F.col("targets").isNull().alias("every"), F.coalesce("targets", F.array().cast("array<long>")).alias("targets"))
    return found.join(wanted, "case").where(F.col("every") | F.array_contains("targets", F.col("node"))).drop("every", "targets")


def searched(edges: DataFrame, cases: DataFrame, weight: str = "w", with_codes: bool = False, most: int = MAX_EDGES) -> DataFrame:
    """case, node, c, label, codes: for each case the targets that are reached, with weight, nearest seed and path."""
    cases = cases.select("case", "seeds", "banned", "targets")
    network = compact(edges, weight, most)
    if network is None:
        return _by_rounds(edges, cases, weight, with_codes)
    return cases.repartition(F.col("case")).mapInPandas(_by_heap(network, with_codes), FOUND)


def alternatives(edges: DataFrame, pairs: DataFrame, k: int = 3, theta: float = 2.0, most: float = 1.25, weight: str = "w") -> DataFrame:
    """o, d, rank, cost, share, codes: up to k loop-free paths of each pair, none above `most` times the lightest,
    with logit shares exp(-theta (cost - least)). The network must be within MAX_EDGES."""
    network = compact(edges, weight)
    if network is None:
        raise ValueError(f"alternatives need a network of at most {MAX_EDGES} edges")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (int(o), int(d), rank, cost, codes)
                for o, d in frame[["o", "d"]].itertuples(index=False)
                for rank, (cost, codes) in enumerate(network.value.alternatives(int(o), int(d), k, most), start=1)
            ]
            yield pd.DataFrame(rows, columns=["o", "d", "rank", "cost", "codes"])

    found = pairs.select("o", "d").repartition(F.col("o"), F.col("d")).mapInPandas(run, "o long, d long, rank int, cost double, codes array<string>")
    least = found.groupBy("o", "d").agg(F.min("cost").alias("least"))
    pull = found.join(least, ["o", "d"]).withColumn("pull", F.exp(F.greatest(F.lit(-700.0), -theta * (F.col("cost") - F.col("least")))))
    total = pull.groupBy("o", "d").agg(F.sum("pull").alias("total"))
    return pull.join(total, ["o", "d"]).select("o", "d", "rank", "cost", (F.col("pull") / F.col("total")).alias("share"), "codes")
