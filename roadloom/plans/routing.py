"""Routes, incidence and the four criticality dimensions over every link, and their composite."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import exprs as E
from roadloom.operators import equilibrium as EQ
from roadloom.operators import forest
from roadloom.operators import paths as P
from roadloom.operators.betweenness import betweenness
from roadloom.sources import network as N
from roadloom.sources.stored import cut

QUERIES, SQL = {}, {}

#: Parameters of the scores.
PENALTY_H, PENALTY_TIMES, FULL_CREDIT = 24.0, 5.0, 2.0
BETA, DETERRENCE_H = 1.5, 8.0
WITHIN = {"physical": {"p1": 0.70, "p2": 0.30}, "social": {"s1": 0.40, "s2": 0.60}, "economic": {"e1": 0.46, "e2": 0.54}, "interconnected": {"i1": 0.35, "i2": 0.65}}
DIMENSIONS = {"physical": 0.35, "social": 0.25, "economic": 0.25, "interconnected": 0.15}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r(c, n: int = 6):
    return F.round(c, n)


# the network with weights of which no two paths have the same sum: hours, and a ten-millionth of them by the link

TIE = "1e-7::DOUBLE * ((31 * least(u, v) + 17 * greatest(u, v)) % 101)"
WEIGHTED = N.with_sql("nodes", "demand", "zones", "counts") + f", wedges AS (SELECT u, v, len, t, code, t + {TIE} AS w FROM edges), " + N.skim_sql(weight="w", table="wedges")
ON_PATH = WEIGHTED + """, onp AS (SELECT s.o, s.d, s.c, e.code, e.len, e.w, least(e.u, e.v) AS a, greatest(e.u, e.v) AS b FROM skim s JOIN wedges e ON TRUE
 JOIN skim x ON x.o = s.o AND x.d = e.u JOIN skim y ON y.o = e.v AND y.d = s.d WHERE s.o <> s.d AND abs(x.c + e.w + y.c - s.c) < 1e-9::DOUBLE)"""


def weighted(spark, d) -> DataFrame:
    """Both directions of every road: u, v, len, t, code, w."""
    tie = 1e-7 * ((31 * F.least("u", "v") + 17 * F.greatest("u", "v")) % 101)
    return N.edges(spark, d).withColumn("w", F.col("t") + tie)


def _cases(origins: DataFrame, key: str = "o") -> DataFrame:
    none = F.lit(None)
    return origins.select(F.col(key).cast("string").alias("case"), F.array(F.col(key).cast("long")).alias("seeds"), none.cast("array<string>").alias("banned"), none.cast("array<long>").alias("targets"))


def routes(spark, d) -> DataFrame:
    """o, d, c, codes: the lightest path of every connected pair of nodes."""
    e = weighted(spark, d)
    found = P.searched(e, _cases(e.select(F.col("u").alias("o")).distinct()), with_codes=True)
    return found.where("case <> cast(node as string)").select(F.col("case").cast("long").alias("o"), F.col("node").alias("d"), "c", "codes")


@query("GR6_paths", ON_PATH + " SELECT o, d, round(max(c), 6) AS hours, sum(len) AS km, count(*) AS links FROM onp GROUP BY o, d")
def gr6_paths(spark, d):
    """Hours of the fastest path, its length, and its number of links."""
    size = N.roads(spark, d).select("code", "len")
    steps = routes(spark, d).select("o", "d", "c", F.explode("codes").alias("code")).join(size, "code")
    return steps.groupBy("o", "d").agg(r(F.max("c")).alias("hours"), F.sum("len").alias("km"), F.count(F.lit(1)).alias("links"))


@query("GR7_nearest_labelled", WEIGHTED + " SELECT o AS node, round(min(c), 6) AS hours, min_by(d, {'c': c, 'd': d}) AS facility FROM skim WHERE d % 6 = 0 AND d < 25 GROUP BY o")
def gr7_labelled(spark, d):
    """One search from all facilities at once; each node learns which it was reached from."""
    e = weighted(spark, d)
    found = P.searched(e, _kinds(spark, d).where("kind = 'airport'").select(F.col("kind").alias("case"), "seeds", F.lit(None).cast("array<string>").alias("banned"), F.lit(None).cast("array<long>").alias("targets")))
    return found.select("node", r("c").alias("hours"), F.col("label").alias("facility"))


def incidence(routes_: DataFrame) -> DataFrame:
    """o, d, c, code: a row for each link of each path."""
    return routes_.select("o", "d", "c", F.explode(F.array_distinct("codes")).alias("code"))


@query("GR16_link_flow", ON_PATH + ", f AS (SELECT code, sum(q) AS flow, count(*) AS pairs FROM onp JOIN demand USING (o, d) GROUP BY code) SELECT code, round(coalesce(flow, 0), 4) AS flow, coalesce(pairs, 0) AS pairs FROM roads LEFT JOIN f USING (code)")
def gr16(spark, d):
    """All-or-nothing loads: the demand of every path on each of its links."""
    f = incidence(routes(spark, d)).join(N.demand(spark, d), ["o", "d"]).groupBy("code").agg(F.sum("q").alias("flow"), F.count(F.lit(1)).alias("pairs"))
    return N.roads(spark, d).select("code").join(f, "code", "left").select("code", r(F.coalesce("flow", F.lit(0.0)), 4).alias("flow"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


@query("GR10_incidence", ON_PATH + " SELECT code, least(o, d) AS a, greatest(o, d) AS b, CAST(count(*) AS DOUBLE) AS p FROM onp GROUP BY 1, 2, 3")
def gr10_incidence(spark, d):
    """Links by unordered pairs, both directions summed."""
    return incidence(routes(spark, d)).groupBy("code", F.least("o", "d").alias("a"), F.greatest("o", "d").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("p"))


ROUTE_SETS = "(VALUES ('west', 'NH00-001'), ('west', 'NH01-002'), ('west', 'NH02-003'), ('middle', 'NH10-011'), ('middle', 'NH12-019'), ('east', 'NH20-021')) t(target, code)"


@query("J8_selector_overlap", ON_PATH + f", s AS (SELECT DISTINCT target, o, d FROM {ROUTE_SETS} JOIN onp USING (code)) SELECT target, count(*) AS pairs, round(sum(q), 4) AS flow FROM s JOIN demand USING (o, d) GROUP BY target")
def j8(spark, d):
    """Targets that select sets of links meet the paths that use any of them; a path counts once for a target."""
    sets = {"west": ("NH00-001", "NH01-002", "NH02-003"), "middle": ("NH10-011", "NH12-019"), "east": ("NH20-021",)}
    target = spark.createDataFrame([(k, c) for k, v in sets.items() for c in v], "target string, code string")
    hit = incidence(routes(spark, d)).join(target, "code").select("target", "o", "d").distinct()
    return hit.join(N.demand(spark, d), ["o", "d"]).groupBy("target").agg(F.count(F.lit(1)).alias("pairs"), r(F.sum("q"), 4).alias("flow"))


@query("J14_affected_pairs", ON_PATH + " SELECT code AS link, count(*) AS pairs, round(sum(q), 4) AS demand, round(sum(q * c), 4) AS hours FROM onp JOIN demand USING (o, d) GROUP BY code")
def j14(spark, d):
    """The pairs whose path uses a link are those that its removal can slow."""
    return _affected(spark, d).groupBy("link").agg(F.count(F.lit(1)).alias("pairs"), r(F.sum("q"), 4).alias("demand"), r(F.sum(F.col("q") * F.col("c")), 4).alias("hours"))


def _affected(spark, d, found: DataFrame | None = None) -> DataFrame:
    """link, o, d, c, q of every connected pair with demand whose path uses the link."""
    return incidence(found or routes(spark, d)).withColumnRenamed("code", "link").join(N.demand(spark, d).where("q > 0"), ["o", "d"])


@query("V3_major_flows_routed", ON_PATH + ", m AS (SELECT o, d, q FROM demand WHERE q > 0 ORDER BY q DESC, o, d LIMIT 50) SELECT code, count(*) AS cells, round(sum(q), 4) AS q FROM m JOIN onp USING (o, d) GROUP BY code")
def v3(spark, d):
    """The 50 largest cells, routed: links with what they carry of them."""
    major = N.demand(spark, d).where("q > 0").orderBy(F.desc("q"), "o", "d").limit(50)
    return incidence(routes(spark, d)).join(major, ["o", "d"]).groupBy("code").agg(F.count(F.lit(1)).alias("cells"), r(F.sum("q"), 4).alias("q"))


@query("V4_plot_widths", ON_PATH + ", f AS (SELECT code, sum(q) AS flow FROM onp JOIN demand USING (o, d) GROUP BY code) SELECT code, round(0.3::DOUBLE + 2.2::DOUBLE * sqrt(flow / (SELECT max(flow) FROM f)), 6) AS width FROM f")
def v4(spark, d):
    """Line widths by the square root of a flow's share of the largest."""
    f = cut(incidence(routes(spark, d)).join(N.demand(spark, d), ["o", "d"]).groupBy("code").agg(F.sum("q").alias("flow")))
    return f.crossJoin(F.broadcast(f.agg(F.max("flow").alias("most")))).select("code", r(0.3 + 2.2 * F.sqrt(F.col("flow") / F.col("most"))).alias("width"))


@query("GR9_alternatives")
def gr9(spark, d):
    """Up to three loop-free paths of every pair with demand, within 1.25 of the fastest, with logit shares."""
    found = P.alternatives(weighted(spark, d), N.demand(spark, d).where("q > 0"))
    return found.select("o", "d", "rank", r("cost").alias("cost"), r("share").alias("share"), F.array_join("codes", "|").alias("codes"))


def congested(spark, d) -> DataFrame:
    """Roads with free time and a capacity by their design speed: one of 80 carries an eighth of all demand."""
    total = N.demand(spark, d).agg((F.sum("q") / 8).alias("most"))
    return N.roads(spark, d).crossJoin(F.broadcast(total)).select("u", "v", "code", F.col("t").alias("t0"), (F.col("design") / 80 * F.col("most")).alias("cap"))


@query("GR17_equilibrium")
def gr17(spark, d):
    """Flows and times of roads in user equilibrium to a relative gap of 1e-3, and how near it is."""
    found = EQ.user_equilibrium(congested(spark, d), N.demand(spark, d), gap=1e-3)
    return found.links.select("code", r("flow", 2).alias("flow"), r("time").alias("time"), F.lit(found.gap).alias("gap"), F.lit(found.iterations).alias("iterations"), F.lit(found.converged).alias("converged"))


@query("GR15_efficiency", WEIGHTED + " SELECT round(sum(CASE WHEN o <> d THEN 1 / c END) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 6) AS efficiency FROM skim")
def gr15(spark, d):
    """The mean of one over the hours between nodes; a pair without path counts 0."""
    n = weighted(spark, d).select("u").distinct().agg(F.count(F.lit(1)).alias("n"))
    total = routes(spark, d).agg(F.sum(1 / F.col("c")).alias("s"))
    return total.crossJoin(n).select(r(F.col("s") / (F.col("n") * (F.col("n") - 1))).alias("efficiency"))


WAVES = 14  # steps of the longest shortest path, in the SQL
BETWEEN = N.with_sql("nodes", "zones") + ", " + N.skim_sql() + """, src AS (SELECT zone AS s FROM zones ORDER BY activity DESC, zone LIMIT 10), dst AS (SELECT zone AS node FROM zones WHERE zone % 4 = 0),
 tight AS (SELECT DISTINCT a.o AS s, e.u, e.v, e.code FROM src JOIN skim a ON a.o = s JOIN edges e ON e.u = a.d JOIN skim b ON b.o = a.o AND b.d = e.v WHERE abs(a.c + e.t - b.c) <= 1e-9::DOUBLE), f0 AS (SELECT s, s AS node, 1.0::DOUBLE AS n FROM src)"""
for _k in range(WAVES):
    BETWEEN += f", f{_k + 1} AS (SELECT f.s, v AS node, sum(n) AS n FROM f{_k} f JOIN tight t ON t.s = f.s AND t.u = f.node GROUP BY 1, 2)"
BETWEEN += ", ways AS (SELECT s, node, sum(n) AS n FROM (" + " UNION ALL ".join(f"SELECT * FROM f{_k}" for _k in range(WAVES + 1)) + ") GROUP BY 1, 2), g0 AS (SELECT s, node, 1 / n AS n FROM ways JOIN dst USING (node) WHERE node <> s)"
for _k in range(WAVES):
    BETWEEN += f", g{_k + 1} AS (SELECT g.s, u AS node, sum(n) AS n FROM g{_k} g JOIN tight t ON t.s = g.s AND t.v = g.node GROUP BY 1, 2)"
BETWEEN += ", asked AS (SELECT s, node, sum(n) AS n FROM (" + " UNION ALL ".join(f"SELECT * FROM g{_k}" for _k in range(WAVES + 1)) + ") GROUP BY 1, 2)"


@query("GR15_betweenness", BETWEEN + " SELECT code, round(sum(w.n * a.n) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 9) AS betweenness FROM tight t JOIN ways w ON w.s = t.s AND w.node = t.u JOIN asked a ON a.s = t.s AND a.node = t.v GROUP BY code")
def gr15_betweenness(spark, d):
    """Shares of the shortest paths from the ten most active zones to health facilities that a road carries, over all pairs of nodes."""
    z, e = N.zones(spark, d), N.edges(spark, d)
    sources = z.orderBy(F.desc("activity"), "zone").limit(10).select(F.col("zone").alias("node"))
    found = betweenness(e, sources, z.where("zone % 4 = 0").select(F.col("zone").alias("node")))
    n = e.select("u").distinct().agg(F.count(F.lit(1)).alias("n"))
    return found.crossJoin(F.broadcast(n)).select("code", r(F.col("share") / (F.col("n") * (F.col("n") - 1)), 9).alias("betweenness"))


@query("GR12_named_sections", ON_PATH + ", s(section, o, d) AS (VALUES ('A', 0, 4), ('A', 4, 9), ('B', 12, 20), ('C', 3, 26)), g AS (SELECT section, code, len FROM s JOIN onp USING (o, d) GROUP BY ALL) SELECT section, sum(len) AS km, count(*) AS links FROM g GROUP BY section HAVING sum(len) <= 300")
def gr12(spark, d):
    """Sections by places passed, chained from leg to leg; those above 300 km go."""
    legs = spark.createDataFrame([("A", 0, 4), ("A", 4, 9), ("B", 12, 20), ("C", 3, 26)], "section string, o long, d long")
    steps = incidence(routes(spark, d)).join(legs, ["o", "d"]).select("section", "code").distinct().join(N.roads(spark, d).select("code", "len"), "code")
    return steps.groupBy("section").agg(F.sum("len").alias("km"), F.count(F.lit(1)).alias("links")).where("km <= 300")


# every link removed

REMOVED = [", x0 AS (SELECT r.code AS link, u AS o, v AS d, min(w) AS c FROM wedges e JOIN (SELECT DISTINCT code FROM roads) r ON r.code <> e.code GROUP BY 1, 2, 3 UNION ALL SELECT code, node, node, 0 FROM roads, nodes)"]
for _k in range(1, 6):
    REMOVED.append(f", {'removed' if _k == 5 else f'x{_k}'} AS (SELECT a.link, a.o, b.d, min(a.c + b.c) AS c FROM x{_k - 1} a JOIN x{_k - 1} b ON a.link = b.link AND a.d = b.o GROUP BY 1, 2, 3)")
SCORED = ON_PATH + "".join(REMOVED)
AFFECTED = SCORED + f""", aff AS (SELECT p.code AS link, p.o, p.d, q, p.c AS t0, x.c IS NULL AS lost, coalesce(x.c, p.c + greatest({PENALTY_H}::DOUBLE, {PENALTY_TIMES}::DOUBLE * p.c)) AS t1
 FROM onp p JOIN demand USING (o, d) LEFT JOIN removed x ON x.link = p.code AND x.o = p.o AND x.d = p.d WHERE q > 0)"""
PHYSICAL = AFFECTED + f""", base AS (SELECT sum(q * c) AS tstt, sum(q) AS q FROM skim JOIN demand USING (o, d)),
 ph0 AS (SELECT link, sum(q * greatest(0, t1 - t0)) AS loss, sum(CASE WHEN lost THEN q ELSE 0 END) AS lost, sum(q * t1) / sum(q * t0) AS ratio, sum(q) AS flow, count(*) AS pairs FROM aff GROUP BY link),
 ph1 AS (SELECT code AS link, coalesce(loss, 0) AS loss, coalesce(lost, 0) / (SELECT q FROM base) AS lost, coalesce(ratio, 1) AS ratio, coalesce(flow, 0) AS flow, coalesce(pairs, 0) AS pairs, coalesce(loss, 0) / (SELECT tstt FROM base) AS p1,
   coalesce(flow, 0) * w * least(1, greatest(0, (coalesce(ratio, 1) - 1) / {FULL_CREDIT}::DOUBLE)) AS p2 FROM (SELECT code, min(w) AS w FROM wedges GROUP BY code) LEFT JOIN ph0 ON code = link)"""


def scaled_sql(value: str, table: str) -> str:
    lo, hi = f"(SELECT min({value}) FROM {table})", f"(SELECT max({value}) FROM {table})"
    return f"CASE WHEN {hi} - {lo} > 1e-12::DOUBLE THEN ({value} - {lo}) / ({hi} - {lo}) ELSE 0 END"


def _kinds(spark, d) -> DataFrame:
    """kind, seeds: every 4th zone has a health facility, every 6th an airport."""
    z = N.zones(spark, d)
    return z.select("zone", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n")) for k, n in (("health", 4), ("airport", 6))))).alias("x")).where("zone % x.n = 0").groupBy(F.col("x.kind").alias("kind")).agg(F.sort_array(F.collect_list("zone")).alias("seeds"))


def _gateways(spark, d) -> DataFrame:
    """node, share: every 5th zone is a gateway; its volume as a share of the largest."""
    g = N.zones(spark, d).where("zone % 5 = 0").select(F.col("zone").alias("node"), F.greatest("activity", F.lit(0.01)).alias("volume"))
    return g.crossJoin(F.broadcast(g.agg(F.max("volume").alias("most")))).select("node", (F.col("volume") / F.col("most")).alias("share"))


def _without(spark, d, cases: DataFrame) -> DataFrame:
    """Cases (kind, seeds, targets) searched as they are (link null) and without every link: link, kind, node, c, label."""
    links = N.roads(spark, d).select(F.col("code").alias("link")).distinct()
    every = links.select("link", F.array("link").alias("banned")).unionByName(spark.range(1).select(F.lit(None).cast("string").alias("link"), F.lit(None).cast("array<string>").alias("banned")))
    rows = every.crossJoin(F.broadcast(cases)).select(F.to_json(F.struct("link", "kind")).alias("case"), "seeds", "banned", "targets")
    found = P.searched(weighted(spark, d), rows)
    key = F.from_json("case", "link string, kind string")
    return found.select(key.alias("k"), "node", "c", "label").select("k.link", "k.kind", "node", "c", "label")


def physical(spark, d) -> DataFrame:
    """link, flow, pairs, loss, lost, ratio, p1, p2 of every road's removal. Only pairs whose path uses the road are searched again, all
    destinations of an origin at once."""
    known = cut(routes(spark, d))
    hit = cut(_affected(spark, d, known))
    cases = hit.groupBy("link", "o").agg(F.collect_set("d").alias("targets"))
    cases = cases.select(F.to_json(F.struct("link", "o")).alias("case"), F.array("o").alias("seeds"), F.array("link").alias("banned"), "targets")
    found = P.searched(weighted(spark, d), cases).select(F.from_json("case", "link string, o long").alias("k"), F.col("node").alias("d"), F.col("c").alias("after"))
    rows = hit.join(found.select("k.link", "k.o", "d", "after"), ["link", "o", "d"], "left")
    t1 = F.coalesce("after", F.col("c") + F.greatest(F.lit(PENALTY_H), PENALTY_TIMES * F.col("c")))
    rows = rows.select("link", "o", "d", "q", "c", F.col("after").isNull().alias("gone"), t1.alias("t1"))
    sums = rows.groupBy("link").agg(
        F.sum(F.col("q") * F.greatest(F.lit(0.0), F.col("t1") - F.col("c"))).alias("loss"), F.sum(F.when(F.col("gone"), F.col("q")).otherwise(0.0)).alias("lost"),
        (F.sum(F.col("q") * F.col("t1")) / F.sum(F.col("q") * F.col("c"))).alias("ratio"), F.sum("q").alias("flow"), F.count(F.lit(1)).alias("pairs"),
    )
    base = known.join(N.demand(spark, d), ["o", "d"]).agg(F.sum(F.col("q") * F.col("c")).alias("tstt"), F.sum("q").alias("total"))
    zero = lambda c, v=0.0: F.coalesce(c, F.lit(v))
    s = weighted(spark, d).groupBy(F.col("code").alias("link")).agg(F.min("w").alias("w")).join(sums, "link", "left").crossJoin(F.broadcast(base))
    credit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (zero("ratio", 1.0) - 1) / FULL_CREDIT))
    return s.select(
        "link", zero("flow").alias("flow"), F.coalesce("pairs", F.lit(0)).alias("pairs"), zero("loss").alias("loss"), (zero("lost") / F.col("total")).alias("lost"), zero("ratio", 1.0).alias("ratio"),
        (zero("loss") / F.col("tstt")).alias("p1"), (zero("flow") * F.col("w") * credit).alias("p2"),
    )


@query("C1_physical", PHYSICAL + " SELECT link, pairs, round(flow, 4) AS flow, round(loss, 4) AS loss, round(lost, 6) AS lost, round(ratio, 6) AS ratio, round(p1, 6) AS p1, round(p2, 4) AS p2 FROM ph1")
def c1(spark, d):
    """Added demand-hours of the affected pairs as a share of all, and what the link carries by the credit of its detour."""
    return physical(spark, d).select("link", "pairs", r("flow", 4).alias("flow"), r("loss", 4).alias("loss"), r("lost").alias("lost"), r("ratio").alias("ratio"), r("p1").alias("p1"), r("p2", 4).alias("p2"))


TOP = "printf('%d->%d q=%.2f, dt=%.3fh', CAST(o AS INT), CAST(d AS INT), q, t1 - t0)"


@query("T2_top_pairs_text", AFFECTED + f", k AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY round(q * (t1 - t0), 9) DESC, q DESC, o, d) AS n FROM aff) SELECT link, string_agg({TOP}, ' ; ' ORDER BY n) AS top FROM k WHERE n <= 5 GROUP BY link")
def t2_text(spark, d):
    """The five pairs that lose most by a link's removal, in one line.

    A pair loses the same both ways, and demand is large enough to show the last digit of its hours: weights are added by halves, as
    in the SQL, and the loss is the difference of the hours after and before, as there."""
    e, known = weighted(spark, d), cut(routes(spark, d))
    hit = cut(_affected(spark, d, P.halved(known, e, ["o", "d"]).join(known.select("o", "d", "codes"), ["o", "d"])))
    cases = hit.groupBy("link", "o").agg(F.collect_set("d").alias("targets")).select(F.to_json(F.struct("link", "o")).alias("case"), F.array("o").alias("seeds"), F.array("link").alias("banned"), "targets")
    found = P.halved(P.searched(e, cases, with_codes=True), e, ["case", "node"]).select(F.from_json("case", "link string, o long").alias("k"), F.col("node").alias("d"), F.col("c").alias("after"))
    rows = hit.join(found.select("k.link", "k.o", "d", "after"), ["link", "o", "d"], "left")
    gap = F.coalesce("after", F.col("c") + F.greatest(F.lit(PENALTY_H), PENALTY_TIMES * F.col("c"))) - F.col("c")
    w = Window.partitionBy("link").orderBy(F.desc(r(F.col("q") * gap, 9)), F.desc("q"), "o", "d")
    rows = rows.select("link", F.row_number().over(w).alias("n"), F.format_string("%d->%d q=%.2f, dt=%.3fh", "o", "d", "q", gap).alias("line")).where("n <= 5")
    return rows.groupBy("link").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ; ").alias("top"))


ISOLATED = SCORED + """, b0 AS (SELECT o AS node, min(d) AS part FROM skim GROUP BY o), a0 AS (SELECT link, o AS node, min(d) AS part FROM removed GROUP BY 1, 2),
 parts AS (SELECT link, b0.part AS whole, a0.part, sum(population) AS people FROM a0 JOIN b0 USING (node) JOIN zones ON zone = node GROUP BY 1, 2, 3),
 iso AS (SELECT link, CAST(sum(people - kept) AS BIGINT) AS isolated FROM (SELECT link, whole, sum(people) AS people, max(people) AS kept FROM parts GROUP BY 1, 2) GROUP BY link)"""


def isolated(spark, d) -> DataFrame:
    """link, isolated: people on the smaller side of what a road's removal parts; only bridges part anything. A code names one
    road."""
    roads = N.roads(spark, d).select("u", "v", F.col("code").alias("id"))
    people = N.zones(spark, d).select(F.col("zone").alias("node"), "population")
    nodes = roads.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(people, "node", "left").select("node", F.coalesce("population", F.lit(0)).alias("weight"))
    cut_off = forest.bridges(roads, nodes).select(F.col("id").alias("link"), F.least("inside", "outside").alias("off"))
    return roads.select(F.col("id").alias("link")).join(cut_off, "link", "left").select("link", F.coalesce("off", F.lit(0)).alias("isolated"))


@query("A5_isolated_people", ISOLATED + " SELECT link, isolated FROM iso")
def a5(spark, d):
    return isolated(spark, d)


SOCIAL = ISOLATED + f""", hb AS (SELECT o AS zone, min(c) AS t FROM skim WHERE d % 4 = 0 AND d < 25 GROUP BY o), ha AS (SELECT link, o AS zone, min(c) AS t FROM removed WHERE d % 4 = 0 AND d < 25 GROUP BY 1, 2),
 so AS (SELECT r.code AS link, (SELECT max(isolated) FROM iso WHERE iso.link = r.code) / CAST((SELECT sum(population) FROM zones) AS DOUBLE) AS s1,
  (SELECT sum(population * greatest(0, coalesce(ha.t, hb.t + {PENALTY_H}::DOUBLE) - hb.t)) FROM zones JOIN hb USING (zone) LEFT JOIN ha ON ha.zone = zones.zone AND ha.link = r.code) / (SELECT sum(population) FROM zones) AS s2 FROM roads r)"""


def _gaps(after: DataFrame, kind: str) -> DataFrame:
    """link, zone, before, after (null: cut off), label (the nearest before): for every zone that reached one."""
    own = cut(after.where(F.col("kind") == kind))
    base = own.where("link is null").select(F.col("node").alias("zone"), F.col("c").alias("before"), "label")
    links = after.where("link is not null").select("link").distinct()
    return base.crossJoin(F.broadcast(links)).join(own.where("link is not null").select("link", F.col("node").alias("zone"), F.col("c").alias("after")), ["link", "zone"], "left")


def _facilities(spark, d) -> DataFrame:
    return cut(_without(spark, d, _kinds(spark, d).withColumn("targets", F.lit(None).cast("array<long>"))))


def social(spark, d, found: DataFrame, off: DataFrame | None = None) -> DataFrame:
    people = N.zones(spark, d).select("zone", "population")
    total = people.agg(F.sum("population").alias("total"))
    gap = F.greatest(F.lit(0.0), F.coalesce("after", F.col("before") + PENALTY_H) - F.col("before"))
    s2 = _gaps(found, "health").join(people, "zone").groupBy("link").agg(F.sum(F.col("population") * gap).alias("s2"))
    return (off or isolated(spark, d)).join(s2, "link").crossJoin(F.broadcast(total)).select("link", (F.col("isolated") / F.col("total")).alias("s1"), (F.col("s2") / F.col("total")).alias("s2"))


@query("C2_social", SOCIAL + " SELECT link, round(s1, 6) AS s1, round(s2, 6) AS s2 FROM so")
def c2(spark, d):
    """People cut off from the rest of their component, and added hours to a health facility per head."""
    return social(spark, d, _facilities(spark, d)).select("link", r("s1").alias("s1"), r("s2").alias("s2"))


ACCESS = f"sum(share * exp(-{BETA}::DOUBLE * c / {DETERRENCE_H}::DOUBLE))"
ECONOMIC = PHYSICAL + f""", gw AS (SELECT zone AS g, greatest(activity, 0.01::DOUBLE) / (SELECT max(greatest(activity, 0.01::DOUBLE)) FROM zones WHERE zone % 5 = 0) AS share FROM zones WHERE zone % 5 = 0),
 ab AS (SELECT d AS zone, {ACCESS} AS x FROM skim JOIN gw ON o = g WHERE d < 25 GROUP BY d), aa AS (SELECT link, d AS zone, {ACCESS} AS x FROM removed JOIN gw ON o = g WHERE d < 25 GROUP BY 1, 2),
 gd AS (SELECT zone, activity / sum(activity) OVER (PARTITION BY CASE WHEN lon < 82.5 THEN 'west' WHEN lon < 85.7 THEN 'middle' ELSE 'east' END) / 3 AS g FROM zones),
 e2 AS (SELECT r.code AS link, (SELECT sum(g * greatest(0, ab.x - coalesce(aa.x, 0))) FROM gd JOIN ab USING (zone) LEFT JOIN aa ON aa.zone = gd.zone AND aa.link = r.code) / (SELECT sum(g) FROM gd) AS e2 FROM roads r),
 tr AS (SELECT r.code AS link, c.n / greatest((SELECT median(n) FROM counts), 1) * 0.5::DOUBLE * (coalesce(a.x, 0) + coalesce(b.x, 0)) / (SELECT max(x) FROM ab) AS exposure FROM roads r JOIN counts c USING (code) LEFT JOIN ab a ON a.zone = r.u LEFT JOIN ab b ON b.zone = r.v),
 ec AS (SELECT link, loss * exposure AS e1, e2, exposure FROM ph1 JOIN tr USING (link) JOIN e2 USING (link))"""


def access(found: DataFrame, share: DataFrame) -> DataFrame:
    """link, zone, x: exponential access to gateways by their shares of the largest volume."""
    near = F.exp(-BETA * F.col("c") / DETERRENCE_H)
    rows = found.join(share.select(F.col("node").cast("string").alias("kind"), "share"), "kind")
    return rows.where("node < 25").groupBy("link", F.col("node").alias("zone")).agg(F.sum(F.col("share") * near).alias("x"))


def economic(spark, d, phys: DataFrame) -> DataFrame:
    """link, exposure, e1 (loss by trade exposure), e2 (lost access, each macro-region counting alike)."""
    share = cut(_gateways(spark, d))
    cases = share.select(F.col("node").cast("string").alias("kind"), F.array("node").alias("seeds"), F.lit(None).cast("array<long>").alias("targets"))
    x = cut(access(_without(spark, d, cases), share))
    base = x.where("link is null").select("zone", F.col("x").alias("before"))
    z = N.zones(spark, d).select("zone", "activity", E.macro_region(F.col("lon")).alias("region"))
    region = z.where("activity > 0").groupBy("region").agg(F.sum("activity").alias("total"))
    n = region.agg(F.count(F.lit(1)).alias("regions"))
    g = z.join(region, "region").crossJoin(F.broadcast(n)).select("zone", (F.col("activity") / F.col("total") / F.col("regions")).alias("g"))
    all_g = g.agg(F.sum("g").alias("all_g"))
    links = N.roads(spark, d).select(F.col("code").alias("link"), "u", "v")
    rows = links.select("link").crossJoin(F.broadcast(base)).join(x.where("link is not null").select("link", "zone", F.col("x").alias("after")), ["link", "zone"], "left").join(g, "zone")
    e2 = rows.groupBy("link").agg(F.sum(F.col("g") * F.greatest(F.lit(0.0), F.col("before") - F.coalesce("after", F.lit(0.0)))).alias("e2"))
    counts = N.counts(spark, d).select(F.col("code").alias("link"), "n")
    ends = counts.agg(F.greatest(F.median("n"), F.lit(1.0)).alias("median")).crossJoin(base.agg(F.max("before").alias("most")))
    side = lambda k: base.select(F.col("zone").alias(k), F.col("before").alias(f"x_{k}"))
    trade = links.join(side("u"), "u", "left").join(side("v"), "v", "left").join(counts, "link").crossJoin(F.broadcast(ends))
    both = F.coalesce("x_u", F.lit(0.0)) + F.coalesce("x_v", F.lit(0.0))
    trade = trade.select("link", (F.col("n") / F.col("median") * 0.5 * both / F.col("most")).alias("exposure"))
    out = phys.select("link", "loss").join(trade, "link").join(e2, "link").crossJoin(F.broadcast(all_g))
    return out.select("link", "exposure", (F.col("loss") * F.col("exposure")).alias("e1"), (F.col("e2") / F.col("all_g")).alias("e2"))


@query("A10_gateway_access", ECONOMIC + " SELECT zone, round(x, 6) AS access FROM ab")
def a10(spark, d):
    share = cut(_gateways(spark, d))
    found = P.searched(weighted(spark, d), _cases(share, "node")).select(F.lit(None).cast("string").alias("link"), F.col("case").alias("kind"), "node", "c")
    return access(found, share).select("zone", r("x").alias("access"))


@query("A11_trade_exposure", ECONOMIC + " SELECT link, round(exposure, 6) AS exposure FROM tr")
def a11(spark, d):
    return economic(spark, d, N.roads(spark, d).select(F.col("code").alias("link"), F.lit(0.0).alias("loss"))).select("link", r("exposure").alias("exposure"))


@query("C3_economic", ECONOMIC + " SELECT link, round(e1, 4) AS e1, round(e2, 8) AS e2 FROM ec")
def c3(spark, d):
    return economic(spark, d, physical(spark, d)).select("link", r("e1", 4).alias("e1"), r("e2", 8).alias("e2"))


AIR = SCORED + f""", nb AS (SELECT o AS zone, min(c) AS t, min_by(d, {{'c': c, 'd': d}}) AS airport FROM skim WHERE d % 6 = 0 AND d < 25 AND o < 25 GROUP BY o), na AS (SELECT link, o AS zone, min(c) AS t FROM removed WHERE d % 6 = 0 AND d < 25 AND o < 25 GROUP BY 1, 2),
 air AS (SELECT r.code AS link, nb.zone, airport, population, na.t IS NULL AS cut_off, coalesce(na.t, nb.t + {PENALTY_H}::DOUBLE) - nb.t AS gap FROM roads r CROSS JOIN nb JOIN zones USING (zone) LEFT JOIN na ON na.link = r.code AND na.zone = nb.zone),
 top AS (SELECT link, airport, sum(population * gap) AS s FROM air WHERE gap > 1e-9::DOUBLE GROUP BY 1, 2),
 ic AS (SELECT link, sum(population * greatest(0, gap)) / sum(population) AS i1, CAST(sum(CASE WHEN cut_off THEN population ELSE 0 END) AS DOUBLE) / sum(population) AS i2 FROM air GROUP BY link)"""


def interconnected(spark, d, found: DataFrame) -> DataFrame:
    """link, i1 (added hours to the nearest airport per head), i2 (share cut off from all), airport (whose people lose most)."""
    rows = _gaps(found, "airport").join(N.zones(spark, d).select("zone", "population"), "zone")
    gap = F.greatest(F.lit(0.0), F.coalesce("after", F.col("before") + PENALTY_H) - F.col("before"))
    rows = cut(rows.select("link", "population", F.col("label").alias("airport"), F.col("after").isNull().alias("gone"), gap.alias("gap")))
    sums = rows.groupBy("link").agg((F.sum(F.col("population") * F.col("gap")) / F.sum("population")).alias("i1"), (F.sum(F.when(F.col("gone"), F.col("population")).otherwise(0)) / F.sum("population")).alias("i2"))
    top = rows.where("gap > 1e-9").groupBy("link", "airport").agg(F.sum(F.col("population") * F.col("gap")).alias("s")).groupBy("link").agg(F.max_by("airport", F.struct(r("s"), -F.col("airport"))).alias("airport"))
    return sums.join(top, "link", "left")


@query("C4_interconnected", AIR + " SELECT ic.link, round(i1, 6) AS i1, round(i2, 6) AS i2, (SELECT max_by(airport, {'s': round(s, 6), 'a': -airport}) FROM top WHERE top.link = ic.link) AS airport FROM ic")
def c4(spark, d):
    return interconnected(spark, d, _facilities(spark, d)).select("link", r("i1").alias("i1"), r("i2").alias("i2"), "airport")


def _dimension_sql(name: str, table: str) -> str:
    own = WITHIN[name]
    return f"SELECT link, ({' + '.join(f'{w}::DOUBLE * {scaled_sql(m, table)}' for m, w in own.items())}) / {sum(own.values())}::DOUBLE AS {name} FROM {table}"


_SOCIAL_TAIL, _ECONOMIC_TAIL, _AIR_TAIL = SOCIAL[len(SCORED) :], ECONOMIC[len(SCORED) :], AIR[len(SCORED) :]
COMPOSITE = SCORED + _ECONOMIC_TAIL + _SOCIAL_TAIL + _AIR_TAIL + ", " + ", ".join(f"d_{k} AS ({_dimension_sql(k, t)})" for k, t in zip(DIMENSIONS, ("ph1", "so", "ec", "ic"), strict=True))
COMPOSITE += ", total AS (SELECT link, physical, social, economic, interconnected, " + " + ".join(f"{w}::DOUBLE * {k}" for k, w in DIMENSIONS.items()) + " AS score FROM " + " JOIN ".join(f"d_{k}" + (" USING (link)" if i else "") for i, k in enumerate(DIMENSIONS)) + ")"


def measures(spark, d) -> DataFrame:
    """All measures of all dimensions by link. What doesn't need each other runs side by side."""
    with ThreadPoolExecutor(3) as side:
        phys, off = side.submit(lambda: cut(physical(spark, d))), side.submit(lambda: cut(isolated(spark, d)))
        found = side.submit(lambda: _facilities(spark, d))
        eco = side.submit(lambda: cut(economic(spark, d, phys.result())))
        phys, off, found, eco = (x.result() for x in (phys, off, found, eco))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    s = phys.select("link", "p1", "p2").join(social(spark, d, found, off), "link", "left").join(eco, "link", "left").join(interconnected(spark, d, found), "link", "left")
    return s.select("link", *(zero(m) for own in WITHIN.values() for m in own))


def composite(rows: DataFrame) -> DataFrame:
    """Measures by link scaled to 0..1 over all links, weighted within their dimension, the dimensions weighted and summed."""
    every = [m for own in WITHIN.values() for m in own]
    ends = rows.agg(*[f(m).alias(f"{n}_{m}") for m in every for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda m: E.min_max(F.col(m), F.col(f"lo_{m}"), F.col(f"hi_{m}"))
    part = {k: sum((w * scaled(m) for m, w in own.items()), F.lit(0.0)) / sum(own.values()) for k, own in WITHIN.items()}
    s = rows.crossJoin(F.broadcast(ends)).select("link", *(c.alias(k) for k, c in part.items()))
    return s.withColumn("score", sum((w * F.col(k) for k, w in DIMENSIONS.items()), F.lit(0.0)))


@query("C5_composite", COMPOSITE + " SELECT link, round(physical, 6) AS physical, round(social, 6) AS social, round(economic, 6) AS economic, round(interconnected, 6) AS interconnected, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, link) AS rank FROM total")
def c5(spark, d):
    """The ranked link criticality table."""
    s = cut(composite(cut(measures(spark, d))))
    # one row per link: the ranks of a list of links, whatever the demand behind it
    place = F.row_number().over(Window.orderBy(F.desc(r("score", 9)), "link")).cast("long")
    return s.select("link", *(r(k).alias(k) for k in DIMENSIONS), r("score").alias("score"), place.alias("rank"))


@query("W2_min_max", PHYSICAL + f" SELECT link, round({scaled_sql('p1', 'ph1')}, 6) AS p1, round({scaled_sql('p2', 'ph1')}, 6) AS p2 FROM ph1")
def w2(spark, d):
    s = cut(physical(spark, d).select("link", "p1", "p2"))
    ends = s.agg(*[f(m).alias(f"{n}_{m}") for m in ("p1", "p2") for n, f in (("lo", F.min), ("hi", F.max))])
    return s.crossJoin(F.broadcast(ends)).select("link", *(r(E.min_max(F.col(m), F.col(f"lo_{m}"), F.col(f"hi_{m}"))).alias(m) for m in ("p1", "p2")))


@query("J16_dimensions_joined", SCORED + _ECONOMIC_TAIL + _SOCIAL_TAIL + _AIR_TAIL + " SELECT ph1.link, round(coalesce(p1, 0), 6) AS p1, round(coalesce(s1, 0), 6) AS s1, round(coalesce(e2, 0), 6) AS e2, round(coalesce(i1, 0), 6) AS i1 FROM ph1 LEFT JOIN so USING (link) LEFT JOIN ec USING (link) LEFT JOIN ic USING (link)")
def j16(spark, d):
    return measures(spark, d).select("link", *(r(m).alias(m) for m in ("p1", "s1", "e2", "i1")))


@query("T3_top_by_dimension", COMPOSITE + ", lng AS (" + " UNION ALL ".join(f"SELECT '{k}' AS dimension, link, {k} AS value FROM total" for k in DIMENSIONS) + "), n AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY round(value, 9) DESC, link) AS place FROM lng) SELECT dimension, place, link, round(value, 6) AS value FROM n WHERE place <= 10")
def t3(spark, d):
    """The ten links that score highest in each dimension."""
    s = composite(cut(measures(spark, d)))
    rows = s.select("link", F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).alias("value")) for k in DIMENSIONS))).alias("x")).select("x.dimension", "link", "x.value")
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc(r("value", 9)), "link")).cast("long")
    return rows.withColumn("place", place).where("place <= 10").select("dimension", "place", "link", r("value").alias("value"))
