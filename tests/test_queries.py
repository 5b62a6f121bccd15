"""Every query with SQL against DuckDB on the smallest tables; the rest by their properties."""

import heapq
import math
import os
import random
import re

import duckdb
import pytest

from roadloom.plans import catalog, network, relational
from roadloom.sources import network as N

DATA = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


def rows_of(rows, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE_SQL])
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    wanted = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    assert rows_of(df.collect(), columns) == rows_of(wanted, columns)


def test_links_follow_junctions(spark):
    rows = catalog.QUERIES["GR11_links"](spark, DATA).collect()
    assert len({r.code for r in rows}) == len(rows) == 37
    link = {r.code: r.link for r in rows}
    assert link["NH03-025"] == link["NH25-026"]  # node 25 has two roads


def test_least_squares_pulls_towards_the_goals(spark):
    rows = catalog.QUERIES["M11_gls"](spark, DATA).collect()
    assert all(r.estimate > 0 and math.isfinite(r.estimate) for r in rows)
    assert sum(r.estimate for r in rows) > sum(r.prior for r in rows)


def test_skim_obeys_the_triangle_inequality(spark):
    skim = {(r.o, r.d): r.hours for r in catalog.QUERIES["GR6_skim"](spark, DATA).collect()}
    nodes = {o for o, _ in skim}
    assert all(skim[n, n] == 0 for n in nodes)
    for a, b in skim:
        for c in nodes:
            if (b, c) in skim:
                assert skim[a, c] <= skim[a, b] + skim[b, c] + 1e-5


@pytest.fixture(scope="module")
def removals(duck):
    """The facts of the network, and for every road the hours between all nodes without it, by Dijkstra."""
    edges = duck.sql(N.with_sql("edges") + " SELECT u, v, t, code FROM edges").fetchall()
    zones = {z: (p, a) for z, p, a in duck.sql(N.with_sql("zones") + " SELECT zone, population, activity FROM zones").fetchall()}
    demand = {(o, d): q for o, d, q in duck.sql(N.with_sql("demand") + " SELECT o, d, q FROM demand").fetchall()}

    def hours(banned):
        out = {}
        for o in {e[0] for e in edges}:
            queue = [(0.0, o)]
            while queue:
                c, x = heapq.heappop(queue)
                if (o, x) not in out:
                    out[o, x] = c
                    for u, v, t, code in edges:
                        if u == x and code != banned:
                            heapq.heappush(queue, (c + t, v))
        return out

    return zones, demand, hours(None), {link: hours(link) for link in {e[3] for e in edges}}


def scored(removals):
    """C1 to C4 and A5 by link."""
    zones, demand, before, without = removals
    people, worth = sum(p for p, _ in zones.values()), sum(a for _, a in zones.values())
    out = {}
    for link, after in without.items():
        def least(o, every, h):
            return min((h[o, d] for d in range(0, 25, every) if (o, d) in h), default=None)

        def added(every):
            gaps = {o: (least(o, every, before), least(o, every, after)) for o in zones}
            return {o: (b + 24 if a is None else a) - b for o, (b, a) in gaps.items()}, [o for o, (_, a) in gaps.items() if a is None]

        reach = lambda o, h: sum(math.exp(-h[o, d] / 2) for d in range(0, 25, 5) if (o, d) in h)  # noqa: B023, E731
        (health, _), (air, lost) = added(4), added(6)
        out[link] = {
            "C1": sum(q * (after.get(k, before[k] + max(24, 5 * before[k])) - before[k]) for k, q in demand.items()),
            "C2": sum(zones[o][0] * health[o] for o in zones) / people,
            "C3": sum(zones[o][1] * max(0.0, reach(o, before) - reach(o, after)) for o in zones) / worth,
            "C4": (sum(zones[o][0] for o in lost) / people, sum(zones[o][0] * air[o] for o in zones) / people),
            "A5": sum(zones[o][0] for o in zones if not any((o, d) in after for d in [*range(25), 25, 26, 27, 28] if d != o)),
        }
    return out


def test_every_link_is_removed(spark, removals):
    wanted = scored(removals)
    assert len(wanted) == 37
    for name, key in (("C1_physical_loss", "loss"), ("C2_social_loss", "loss"), ("C3_economic_loss", "loss"), ("A5_isolated_population", "isolated")):
        found = {r.link: r[key] for r in catalog.QUERIES[name](spark, DATA).collect()}
        assert found == pytest.approx({k: x[name[:2]] for k, x in wanted.items()}, abs=2e-4)
    for row in catalog.QUERIES["C4_airport_cutoff"](spark, DATA).collect():
        assert (row.cut_off, row.added) == pytest.approx(wanted[row.link]["C4"], abs=2e-6)


def test_links_are_ranked_over_four_dimensions(spark, removals):
    wanted = scored(removals)

    def scaled(values):
        lo, hi = min(values.values()), max(values.values())
        return {k: (x - lo) / (hi - lo) if hi - lo > 1e-12 else 0.0 for k, x in values.items()}

    c1, c2, c3, a5 = (scaled({k: x[m] for k, x in wanted.items()}) for m in ("C1", "C2", "C3", "A5"))
    cut_off, added = (scaled({k: x["C4"][i] for k, x in wanted.items()}) for i in (0, 1))
    parts = {k: (c1[k], 0.4 * a5[k] + 0.6 * c2[k], c3[k], 0.35 * added[k] + 0.65 * cut_off[k]) for k in wanted}
    rows = catalog.QUERIES["W1_link_rank"](spark, DATA).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 38))
    for row in rows:
        assert (row.physical, row.social, row.economic, row.interconnected) == pytest.approx(parts[row.link], abs=1e-4)
        assert row.score == pytest.approx(sum(w * x for w, x in zip((0.35, 0.25, 0.25, 0.15), parts[row.link], strict=True)), abs=1e-4)
    assert [r.score for r in sorted(rows, key=lambda r: r["rank"])] == sorted((r.score for r in rows), reverse=True)
    tops = catalog.QUERIES["T3_top_links_by_dimension"](spark, DATA).collect()
    for k in ("physical", "social", "economic", "interconnected"):
        own = sorted((-r[k], r.link) for r in rows)[:10]
        assert [(-r.value, r.link) for r in sorted(tops, key=lambda r: r.place) if r.dimension == k] == own


def test_snap_pairs_beyond_1500_customers(spark, tmp_path):
    spark.range(1, 4001).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    found = {(r.a, r.b) for r in catalog.QUERIES["GE6_snap_pairs"](spark, str(tmp_path)).collect()}
    x, y = (lambda k: 80 + (k * 37 % 1000) / 120), (lambda k: 26 + (k * 91 % 1000) / 250)
    near = [k for k in range(1, 4001) if k != 1700 and math.hypot(x(k) - x(1700), y(k) - y(1700)) <= 0.02]
    assert {sum(p) - 1700 for p in found if 1700 in p} == set(near) and max(near) > 1500


def test_close_pairs_are_not_broadcast(spark, tmp_path):
    """Nine rows a point outgrow what the scan's size tells, so no side may go through the driver; a full cell is met by blocks."""
    rnd = random.Random(5)
    spots = [(rnd.uniform(0, 0.2), rnd.uniform(-0.1, 0.1)) for _ in range(200)] + [(0.05, 0.05)] * 60
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(spots)], "id long, x double, y double")
    wanted = {(a, b) for a, p in enumerate(spots) for b, q in enumerate(spots) if a < b and math.dist(p, q) <= 0.02}
    for crowd in (7, 4096):
        found = [(r.a, r.b) for r in network.close_pairs(points, 0.02, crowd=crowd).collect()]
        assert len(found) == len(set(found)) and set(found) == wanted
    spark.range(1, 101).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    assert "Broadcast" not in catalog.QUERIES["GE6_snap_pairs"](spark, str(tmp_path))._jdf.queryExecution().toString()


def test_top_pairs_of_large_demand(spark, tmp_path):
    """Where demand shows the last digit of the hours, the pairs of both directions still tie, as in SQL."""
    con = duckdb.connect()
    for f in os.listdir(DATA):
        own = " REPLACE (l_quantity * 7919 AS l_quantity)" if f == "lineitem.parquet" else ""
        con.sql(f"COPY (SELECT *{own} FROM '{DATA}/{f}') TO '{tmp_path}/{f}'")
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{tmp_path}/{f}'")
    wanted = dict(con.sql(catalog.ORACLE_SQL["T2_top_pairs_text"]).fetchall())
    assert {r.link: r.top for r in catalog.QUERIES["T2_top_pairs_text"](spark, str(tmp_path)).collect()} == wanted


def test_overlaps_are_counted_where_their_set_is(spark):
    """An element of many sets is met by several lists, and no task gathers counts of sets that other tasks count too."""
    rnd = random.Random(6)
    sets = {k: {rnd.randrange(40) for _ in range(rnd.randrange(1, 9))} | ({99} if k % 4 else set()) for k in range(70)}
    rows = spark.createDataFrame([(k, p) for k, ps in sets.items() for p in ps] + [(None, 99), (3, None)], "s long, p long")
    sizes = {k: len(ps) + (k == 3) for k, ps in sets.items()}
    wanted = {(a, b, n, round(n / (sizes[a] + sizes[b] - n), 6)) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b]))}
    for listed in (5, 1024):
        found = [tuple(r) for r in relational._overlaps(rows, listed=listed).collect()]
        assert len(found) == len(wanted) and set(found) == wanted
    plan = catalog.QUERIES["ST2_set_overlap"](spark, DATA)._jdf.queryExecution().toString()
    assert re.search(r"hashpartitioning\(a#", plan) and not re.search(r"hashpartitioning\(a#\w+, b#", plan)


def test_fitting_converges(spark, duck):
    goal = dict(duck.sql(N.with_sql("zones") + " SELECT zone, activity FROM zones").fetchall())
    rows = catalog.QUERIES["M4_ipf_converged"](spark, DATA).collect()
    for key in ("o", "d"):
        sums = {z: sum(r.q for r in rows if r[key] == z) for z in goal}
        assert sums == pytest.approx(goal, rel=1e-7, abs=0.02)
