"""Geometry, network, demand-model and criticality queries over the derived network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import exprs as E
from roadloom.operators import demand as D
from roadloom.operators import forest
from roadloom.operators import graph as G
from roadloom.operators.nearest import nearest
from roadloom.sources import network as N
from roadloom.sources.stored import cut, table, tasks

QUERIES, SQL = {}, {}
FACILITY = 6  # every 6th zone has an airport, every 4th a health facility, every 5th is a gateway


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r(c, n: int = 6):
    return F.round(c, n)


# geometry

KM = "111.0::DOUBLE * sqrt(pow(({0}) * cos(radians(({2}) / 2)), 2) + pow({1}, 2))"


@query("GE4_distance_km", N.with_sql("zones", "roads") + f" SELECT code, round({KM.format('a.lon - b.lon', 'a.lat - b.lat', 'a.lat + b.lat')}, 6) AS km FROM roads JOIN zones a ON u = a.zone JOIN zones b ON v = b.zone")
def ge4(spark, d):
    z = N.zones(spark, d)
    a, b = z.select(F.col("zone").alias("u"), F.col("lon").alias("x"), F.col("lat").alias("y")), z.select(F.col("zone").alias("v"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    return N.roads(spark, d).join(a, "u").join(b, "v").select("code", r(E.distance_km(*map(F.col, ("x", "y", "x2", "y2")))).alias("km"))


@query("GE5_point_segment", "SELECT event_id, round(sqrt(pow(x - 2 - t * 6, 2) + pow(y - 1 - t * 3, 2)), 6) AS distance FROM (SELECT event_id, x, y, greatest(0, least(1, ((x - 2) * 6 + (y - 1) * 3) / 45)) AS t FROM (SELECT event_id, CAST(user_id % 11 AS DOUBLE) AS x, CAST(event_id % 7 AS DOUBLE) AS y FROM events))")
def ge5(spark, d):
    x, y = (F.col("user_id") % 11).cast("double"), (F.col("event_id") % 7).cast("double")
    line = [F.lit(float(k)) for k in (2, 1, 8, 4)]
    return table(spark, d, "events").select("event_id", r(E.segment_distance(x, y, *line)).alias("distance"))


POINTS = "p AS (SELECT c_custkey AS id, 80 + (c_custkey * 37 % 1000) / 120 AS x, 26 + (c_custkey * 91 % 1000) / 250 AS y FROM customer)"


def _points(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (80 + (k * 37 % 1000) / 120).alias("x"), (26 + (k * 91 % 1000) / 250).alias("y"))


def near_cells(x, y, size: float, reach: int = 1):
    """The grid cells within reach of a point."""
    span = lambda c: F.sequence(F.floor(c / size) - reach, F.floor(c / size) + reach)
    return F.flatten(F.transform(span(x), lambda a: F.transform(span(y), lambda b: F.struct(a.alias("i"), b.alias("j")))))


#: Points of a cell that a task holds at once; the points around a fuller cell meet it a block at a time.
CROWD = 4096


def close_pairs(p, size: float, crowd: int = CROWD):
    """a, b, gap: the pairs of points (id, x, y) with a < b that are at most size apart, by an equi-join on grid cells: a point's own
    cell against the neighbours' cells.

    The join is never a broadcast: the neighbours' cells are nine rows a point, which no estimate of the scan shows. Its tasks
    follow the number of pairs within a cell."""
    cell = [F.floor(F.col(c) / size).alias(k) for c, k in (("x", "i"), ("y", "j"))]
    own = p.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), *cell)
    near = p.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(near_cells(F.col("x"), F.col("y"), size)).alias("cell"))
    near = near.select("b", "bx", "by", "cell.i", "cell.j")
    counts = own.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    dealt = [tasks(p.sparkSession, counts.agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).head().pairs), "i", "j", "block"]
    crowds = counts.select("i", "j", F.ceil(F.col("n") / crowd).alias("blocks"))
    own = own.join(crowds.hint("merge"), ["i", "j"]).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks"))).drop("blocks")
    near = near.join(crowds.hint("merge"), ["i", "j"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    gap = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return near.repartition(*dealt).join(own.repartition(*dealt).hint("merge"), ["i", "j", "block"]).where((F.col("a") < F.col("b")) & (gap <= size)).select("a", "b", gap.alias("gap"))


@query("GE6_snap_pairs", f"WITH {POINTS} SELECT a.id AS a, b.id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM p a JOIN p b ON a.id < b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.02::DOUBLE")
def ge6(spark, d):
    return close_pairs(_points(spark, d), 0.02).select("a", "b", r("gap").alias("distance"))


@query("J9_nearest_zone", f"{N.with_sql('zones')}, {POINTS} SELECT id, min_by(zone, {{'d': round(sqrt(pow(x - lon, 2) + pow(y - lat, 2)), 9), 'z': zone}}) AS zone FROM p, zones GROUP BY id")
def j9(spark, d):
    """Each point's nearest zone, ties to the smaller one."""
    z = N.zones(spark, d).select(F.col("zone").alias("site"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return nearest(_points(spark, d), z).select("id", F.col("site").alias("zone"))


@query("J10_radius_count", f"{N.with_sql('zones')}, {POINTS} SELECT zone, count(id) AS n FROM zones LEFT JOIN p ON sqrt(pow(x - lon, 2) + pow(y - lat, 2)) <= 0.5::DOUBLE GROUP BY zone")
def j10(spark, d):
    size = 0.5
    z = N.zones(spark, d).select("zone", "lon", "lat", F.explode(near_cells(F.col("lon"), F.col("lat"), size)).alias("cell"))
    p = _points(spark, d).select("x", "y", F.struct(F.floor(F.col("x") / size).alias("i"), F.floor(F.col("y") / size).alias("j")).alias("cell"))
    inside = F.sqrt(F.pow(F.col("x") - F.col("lon"), 2) + F.pow(F.col("y") - F.col("lat"), 2)) <= size
    return z.join(p, "cell", "left").groupBy("zone").agg(F.count_if(F.coalesce(inside, F.lit(False))).alias("n"))


@query("GE12_point_in_box", f"WITH {POINTS} SELECT id, CASE WHEN x < 82 AND y < 28 THEN 1 WHEN x >= 84 AND y BETWEEN 27 AND 29 THEN 2 ELSE 0 END AS area FROM p")
def ge12(spark, d):
    """Ray casting over polygon rings; the first polygon that holds the point counts."""
    rings = {1: [(0, 0), (82, 0), (82, 28), (0, 28)], 2: [(84, 27), (200, 27), (200, 29.0000001), (84, 29.0000001)]}

    def inside(ring):
        crossings = F.lit(0)
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if ay != by:
                cross = ((F.col("y") >= min(ay, by)) & (F.col("y") < max(ay, by))) & (F.col("x") < (bx - ax) * (F.col("y") - ay) / (by - ay) + ax)
                crossings = crossings + cross.cast("int")
        return crossings % 2 == 1

    return _points(spark, d).select("id", F.when(inside(rings[1]), 1).when(inside(rings[2]), 2).otherwise(0).alias("area"))


@query("GE13_corridor_score", f"WITH {POINTS} SELECT id, round(CASE WHEN d <= 0.5 THEN 1 WHEN d >= 1.5 THEN 0 ELSE 1.5 - d END, 6) AS score FROM (SELECT id, abs(y - 28) AS d FROM p)")
def ge13(spark, d):
    """1 within the core of a corridor, falling to 0 at its shoulder."""
    gap = F.abs(F.col("y") - 28)
    return _points(spark, d).select("id", r(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - gap))).alias("score"))


@query("GE14_density", f"WITH {POINTS}, g AS (SELECT CAST(floor(x) AS BIGINT) AS i, CAST(floor(y) AS BIGINT) AS j, count(DISTINCT id) AS n FROM p GROUP BY 1, 2) SELECT i, j, n, round((n - (SELECT min(n) FROM g)) / CAST((SELECT max(n) - min(n) FROM g) AS DOUBLE), 6) AS share FROM g")
def ge14(spark, d):
    g = _points(spark, d).groupBy(F.floor("x").alias("i"), F.floor("y").alias("j")).agg(F.countDistinct("id").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.min("n").alias("lo"), F.max("n").alias("hi")))).select("i", "j", "n", r(E.min_max(F.col("n"), F.col("lo"), F.col("hi"))).alias("share"))


# networks


@query("GR3_speeds", N.with_sql("roads") + " SELECT code, 0.4::DOUBLE * design AS speed, round(t, 9) AS hours, round(60 * t, 6) AS minutes FROM roads")
def gr3(spark, d):
    return N.roads(spark, d).select("code", (N.SPEED_SHARE * F.col("design")).alias("speed"), r("t", 9).alias("hours"), r(60 * F.col("t")).alias("minutes"))


@query("GR8_lightest_edge", N.with_sql("edges") + " SELECT u, v, round(min(t), 9) AS t, min_by(code, {'t': t, 'c': code}) AS code FROM edges GROUP BY u, v")
def gr8(spark, d):
    return G.lightest(N.edges(spark, d)).select("u", "v", r("t", 9).alias("t"), "code")


@query("GR5_components", N.with_sql("nodes") + ", " + N.skim_sql() + " SELECT o AS node, min(d) AS component FROM skim GROUP BY o")
def gr5(spark, d):
    e = N.edges(spark, d)
    return G.components(e, e.select(F.col("u").alias("node")).distinct()).select("node", F.col("label").alias("component"))


@query("GR1_largest_component", N.with_sql("nodes") + ", " + N.skim_sql() + ", c AS (SELECT o AS node, min(d) AS k FROM skim GROUP BY o), b AS (SELECT k FROM c GROUP BY k ORDER BY count(*) DESC, k LIMIT 1) SELECT code, u, v FROM roads JOIN c ON u = node JOIN b USING (k)")
def gr1(spark, d):
    roads = N.roads(spark, d)
    label = gr5(spark, d)
    best = label.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return roads.join(label.join(F.broadcast(best), "component"), F.col("u") == F.col("node")).select("code", "u", "v")


def _skim(spark, d, weight: str = "t") -> DataFrame:
    e = N.edges(spark, d)
    return G.shortest(e, e.select(F.col("u").alias("o"), F.col("u").alias("node"), F.lit(0.0).alias("c")).distinct(), weight)


@query("GR6_skim", N.with_sql("nodes") + ", " + N.skim_sql() + " SELECT o, d, round(c, 6) AS hours FROM skim")
def gr6(spark, d):
    return _skim(spark, d).select("o", F.col("node").alias("d"), r("c").alias("hours"))


@query("GR6_distance", N.with_sql("nodes") + ", " + N.skim_sql(weight="len") + " SELECT o, d, round(c, 6) AS km FROM skim")
def gr6d(spark, d):
    return _skim(spark, d, "len").select("o", F.col("node").alias("d"), r("c").alias("km"))


@query("GR7_nearest_facility", N.with_sql("nodes") + ", " + N.skim_sql() + f" SELECT o AS node, round(min(c), 6) AS hours FROM skim WHERE d % {FACILITY} = 0 AND d < 25 GROUP BY o")
def gr7(spark, d):
    """Every facility is a seed of one and the same search."""
    e = N.edges(spark, d)
    seeds = e.select(F.lit("airport").alias("o"), F.col("u").alias("node"), F.lit(0.0).alias("c")).where(f"node % {FACILITY} = 0 and node < 25").distinct()
    return G.shortest(e, seeds).select("node", r("c").alias("hours"))


@query("A16_unreachable", N.with_sql("nodes") + ", " + N.skim_sql() + " SELECT o AS node, min(CASE WHEN o <> d THEN round(c, 6) END) AS nearest, (SELECT count(*) FROM nodes) - count(*) AS unreachable FROM skim GROUP BY o")
def a16(spark, d):
    skim = _skim(spark, d)
    total = skim.select("o").distinct().agg(F.count(F.lit(1)).alias("n"))
    own = skim.groupBy(F.col("o").alias("node")).agg(F.min(F.when(F.col("o") != F.col("node"), r("c"))).alias("nearest"), F.count(F.lit(1)).alias("m"))
    return own.crossJoin(F.broadcast(total)).select("node", "nearest", (F.col("n") - F.col("m")).alias("unreachable"))


@query("GR10_collapse_pairs", N.with_sql("od") + " SELECT least(o, d) AS a, greatest(o, d) AS b, sum(q) AS q FROM od WHERE o <> d GROUP BY 1, 2")
def gr10(spark, d):
    return N.od(spark, d).where("o <> d").groupBy(F.least("o", "d").alias("a"), F.greatest("o", "d").alias("b")).agg(F.sum("q").alias("q"))


@query("GR11_junctions", N.with_sql("edges") + " SELECT u AS node, count(*) AS degree, count(*) <> 2 AS junction FROM edges GROUP BY u")
def gr11(spark, d):
    return N.edges(spark, d).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree")).withColumn("junction", F.col("degree") != 2)


@query("GR11_links")
def gr11b(spark, d):
    """Roads that meet at nodes of degree 2 form one link: components of the roads' own graph."""
    roads, e = N.roads(spark, d), N.edges(spark, d)
    plain = gr11(spark, d).where("not junction").select("node")
    ends = e.select(F.col("u").alias("node"), "code").join(plain, "node")
    pair = ends.groupBy("node").agg(F.min("code").alias("u"), F.max("code").alias("v")).select("u", "v").where("u <> v")
    both = cut(pair.union(pair.select("v", "u")))
    label = G.components(both, roads.select(F.col("code").alias("node")))
    return label.select(F.col("node").alias("code"), F.col("label").alias("link"))


CHAINS = N.with_sql("edges", "zones", "roads").replace("WITH ", "WITH RECURSIVE ", 1) + """, deg AS (SELECT u AS node, count(*) AS k FROM edges GROUP BY u),
 w(s, f, u, v, code, len, place) AS (SELECT u, v, u, v, code, len, 0 FROM edges JOIN deg ON node = u AND k <> 2
  UNION ALL SELECT s, f, w.v, e.v, e.code, e.len, place + 1 FROM w JOIN deg ON node = w.v AND k = 2 JOIN edges e ON e.u = w.v AND e.code <> w.code),
 t AS (SELECT s, f, max_by(v, place) AS e, max_by(u, place) AS l FROM w GROUP BY s, f),
 ln AS (SELECT s, f, e, row_number() OVER (ORDER BY s, f) AS link FROM t WHERE s < e OR (s = e AND f < l))"""


@query("GR11_link_edges", CHAINS + " SELECT link, CAST(place AS INT) AS place, u, v, code FROM w JOIN ln USING (s, f)")
def gr11_edges(spark, d):
    """Roads between junctions in their order: link, place on it, and the road in the link's direction."""
    return forest.contracted(N.roads(spark, d).select("u", "v", F.col("code").alias("id"))).withColumnRenamed("id", "code")


@query("GR11_link_table", CHAINS + """, a AS (SELECT ln.link, any_value(s) AS u, any_value(e) AS v, sum(w.len) AS km, count(*) AS roads, sum(r.design * w.len) / sum(w.len) AS speed FROM w JOIN ln USING (s, f) JOIN roads r USING (code) GROUP BY ln.link),
 dm AS (SELECT link, arg_max(design, {'k': km, 'd': design}) AS design FROM (SELECT link, design, sum(w.len) AS km FROM w JOIN ln USING (s, f) JOIN roads r USING (code) GROUP BY 1, 2) GROUP BY link)
 SELECT printf('LNK%04d', a.link) AS code, a.u, a.v, coalesce(x.name, 'J' || a.u) || '-' || coalesce(y.name, 'J' || a.v) AS name, km, roads, round(speed, 6) AS speed, design FROM a JOIN dm USING (link) LEFT JOIN zones x ON x.zone = a.u LEFT JOIN zones y ON y.zone = a.v""")
def gr11_table(spark, d):
    """Links with their ends, names, length, mean design speed by length, and the design speed of the most of it."""
    e = gr11_edges(spark, d).join(N.roads(spark, d).select("code", "len", "design"), "code")
    ends = e.groupBy("link").agg(F.min_by("u", "place").alias("u"), F.max_by("v", "place").alias("v"), F.sum("len").alias("km"), F.count(F.lit(1)).alias("roads"), (F.sum(F.col("design") * F.col("len")) / F.sum("len")).alias("speed"))
    most = e.groupBy("link", "design").agg(F.sum("len").alias("s")).groupBy("link").agg(F.max_by("design", F.struct("s", "design")).alias("design"))
    names = N.zones(spark, d).select("zone", "name")
    side = lambda c: names.toDF(c, f"{c}_name")
    rows = ends.join(most, "link").join(side("u"), "u", "left").join(side("v"), "v", "left")
    label = lambda c: F.coalesce(f"{c}_name", F.concat(F.lit("J"), F.col(c).cast("string")))
    return rows.select(F.format_string("LNK%04d", "link").alias("code"), "u", "v", F.concat_ws("-", label("u"), label("v")).alias("name"), "km", "roads", r("speed").alias("speed"), "design")


@query("GR21_activity", N.with_sql("zones", "counts") + " SELECT zone, round(pow(population, 0.45::DOUBLE) + pow(activity, 0.25::DOUBLE), 6) AS score FROM zones")
def gr21(spark, d):
    return N.zones(spark, d).select("zone", r(F.pow(F.col("population").cast("double"), F.lit(0.45)) + F.pow("activity", F.lit(0.25))).alias("score"))


@query("GR20_od_filter", N.with_sql("od") + " SELECT o, d, q FROM od WHERE q >= 1 AND o <> d")
def gr20(spark, d):
    return N.od(spark, d).where("q >= 1 and o <> d")


# demand models


@query("M1_activity", N.with_sql("zones") + " SELECT zone, round(CASE WHEN (SELECT bool_and(population > 0 AND activity > 0) FROM zones) THEN population * activity ELSE population END, 4) AS activity FROM zones")
def m1(spark, d):
    z = N.zones(spark, d)
    valid = z.agg(F.bool_and((F.col("population") > 0) & (F.col("activity") > 0)).alias("ok"))
    value = F.when(F.col("ok"), F.col("population") * F.col("activity")).otherwise(F.col("population").cast("double"))
    return z.crossJoin(F.broadcast(valid)).select("zone", r(value, 4).alias("activity"))


@query("M2_balance_totals", N.with_sql("zones") + " SELECT zone, round(population * (SELECT sum(activity) FROM zones) / (SELECT sum(population) FROM zones), 6) AS attraction FROM zones")
def m2(spark, d):
    z = N.zones(spark, d)
    total = z.agg((F.sum("activity") / F.sum("population")).alias("f"))
    return z.crossJoin(F.broadcast(total)).select("zone", r(F.col("population") * F.col("f")).alias("attraction"))


GRAVITY = N.with_sql("nodes", "zones") + ", " + N.skim_sql() + """, g AS (SELECT o, d, a.activity * b.activity / 1e6::DOUBLE * exp(-0.2::DOUBLE * c) AS q FROM skim JOIN zones a ON o = a.zone JOIN zones b ON d = b.zone WHERE o <> d)"""


def _gravity(spark, d) -> DataFrame:
    z = N.zones(spark, d).select("zone", "activity")
    skim = _skim(spark, d).select("o", F.col("node").alias("d"), "c").where("o <> d")
    return D.gravity(skim, z, 0.2)


@query("M3_gravity", GRAVITY + " SELECT o, d, round(q, 4) AS q FROM g")
def m3(spark, d):
    return _gravity(spark, d).select("o", "d", r("q", 4).alias("q"))


def _ipf_sql(rounds: int) -> str:
    out, name = [", k AS (SELECT zone, activity AS p FROM zones)"], "g"
    for i in range(rounds):
        out.append(f", r{i} AS (SELECT o, d, q * p / greatest(sum(q) OVER (PARTITION BY o), 1e-12::DOUBLE) AS q FROM {name} JOIN k ON o = zone)")
        out.append(f", s{i} AS (SELECT o, d, q * p / greatest(sum(q) OVER (PARTITION BY d), 1e-12::DOUBLE) AS q FROM r{i} JOIN k ON d = zone)")
        name = f"s{i}"
    return "".join(out) + f" SELECT o, d, round(q, 3) AS q FROM {name}"


@query("M4_ipf", GRAVITY + _ipf_sql(8))
def m4(spark, d):
    z = N.zones(spark, d).select("zone", F.col("activity").alias("p"))
    return D.balanced(_gravity(spark, d), z, z, rounds=8, tolerance=0.0).select("o", "d", r("q", 3).alias("q"))


@query("M4_ipf_converged")
def m4_converged(spark, d):
    """Fitted until the totals are met within 1e-8, or for 200 rounds."""
    z = N.zones(spark, d).select("zone", F.col("activity").alias("p"))
    return D.balanced(_gravity(spark, d), z, z).select("o", "d", r("q", 3).alias("q"))


@query("M5_symmetrise", N.with_sql("demand") + " SELECT o, d, q FROM demand")
def m5(spark, d):
    return N.demand(spark, d)


@query("M7_sigma", N.with_sql("counts") + " SELECT code, round(greatest(0.2::DOUBLE * greatest(n, 1000), sqrt(n)) * sqrt(greatest(1, sqrt(n / (SELECT avg(n) FROM counts WHERE n > 0)))), 6) AS sigma FROM counts")
def m7(spark, d):
    """Standard deviations with floors, wider where more pairs share the count."""
    c = N.counts(spark, d)
    mean = c.agg(F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("mean"))
    base = F.greatest(0.2 * F.greatest(F.col("n"), F.lit(1000)), F.sqrt("n"))
    return c.crossJoin(F.broadcast(mean)).select("code", r(base * F.sqrt(F.greatest(F.lit(1.0), F.sqrt(F.col("n") / F.col("mean"))))).alias("sigma"))


@query("M8_zero_seed_mask", N.with_sql("counts") + " SELECT code, ((v / 1000 <= 1 OR v / 1000 / n <= 0.01::DOUBLE) AND n >= 1000) AS masked FROM counts WHERE n > 0")
def m8(spark, d):
    model = F.col("v") / 1000
    return N.counts(spark, d).where("n > 0").select("code", (((model <= 1) | (model / F.col("n") <= 0.01)) & (F.col("n") >= 1000)).alias("masked"))


@query("M9_beta_choice", N.with_sql("nodes", "od") + ", " + N.skim_sql() + """, x AS (SELECT o % 5 AS fold, b, q, exp(-b * c) AS g FROM od JOIN skim USING (o, d) CROSS JOIN (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.4::DOUBLE)) t(b) WHERE o <> d),
f AS (SELECT b, fold, sum(q * g) AS qg, sum(g * g) AS gg FROM x GROUP BY 1, 2), s AS (SELECT b, fold, (sum(qg) OVER (PARTITION BY b) - qg) / (sum(gg) OVER (PARTITION BY b) - gg) AS scale FROM f)
SELECT x.b AS beta, round(sqrt(avg(pow(q - scale * g, 2))), 4) AS rmse, round(sum(abs(q - scale * g)) / sum(q), 6) AS wape FROM x JOIN s ON x.b = s.b AND x.fold = s.fold GROUP BY 1""")
def m9(spark, d):
    """Leave-one-group-out: a fold's scale is that of the totals less the fold's own sums."""
    skim = _skim(spark, d).select("o", F.col("node").alias("d"), "c")
    b = F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.2, 0.4)))).alias("b")
    x = N.od(spark, d).where("o <> d").join(skim, ["o", "d"]).select((F.col("o") % 5).alias("fold"), b, "q", "c")
    x = x.withColumn("g", F.exp(-F.col("b") * F.col("c")))
    f = x.groupBy("b", "fold").agg(F.sum(F.col("q") * F.col("g")).alias("qg"), F.sum(F.col("g") * F.col("g")).alias("gg"))
    w = Window.partitionBy("b")
    scale = f.select("b", "fold", ((F.sum("qg").over(w) - F.col("qg")) / (F.sum("gg").over(w) - F.col("gg"))).alias("scale"))
    miss = F.col("q") - F.col("scale") * F.col("g")
    return x.join(scale, ["b", "fold"]).groupBy(F.col("b").alias("beta")).agg(r(F.sqrt(F.avg(miss * miss)), 4).alias("rmse"), r(F.sum(F.abs(miss)) / F.sum("q")).alias("wape"))


@query("M11_gls")
def m11(spark, d):
    """Demand fitted to zone totals by entropy-prior least squares; a row per pair with prior and estimate."""
    prior = N.od(spark, d).where("o <> d and q > 0").select("o", "d", "q")
    rows = prior.select(F.concat_ws("-", "o", "d").alias("pair"), F.explode(F.array(F.concat(F.lit("o"), "o"), F.concat(F.lit("d"), "d"))).alias("target"))
    goals = prior.groupBy(F.concat(F.lit("o"), "o").alias("target")).agg((1.1 * F.sum("q")).alias("y"), (0.1 * F.sum("q")).alias("sigma"))
    goals = goals.unionByName(prior.groupBy(F.concat(F.lit("d"), "d").alias("target")).agg((1.1 * F.sum("q")).alias("y"), (0.1 * F.sum("q")).alias("sigma")))
    return D.entropy_least_squares(prior.select(F.concat_ws("-", "o", "d").alias("pair"), "q"), rows.withColumn("p", F.lit(1.0)), goals).rows


# criticality

SCENARIOS = N.with_sql("nodes", "demand", "zones") + ", " + N.skim_sql()


def _removed_sql(rounds: int = 5) -> str:
    """Skims without each road."""
    out = [", l AS (SELECT code AS link FROM roads)"]
    out.append(", x0 AS (SELECT link, u AS o, v AS d, min(t) AS c FROM edges JOIN l ON link <> code GROUP BY 1, 2, 3 UNION ALL SELECT link, node, node, 0 FROM l, nodes)")
    for k in range(1, rounds + 1):
        name = "removed" if k == rounds else f"x{k}"
        out.append(f", {name} AS (SELECT a.link, a.o, b.d, min(a.c + b.c) AS c FROM x{k - 1} a JOIN x{k - 1} b ON a.link = b.link AND a.d = b.o GROUP BY 1, 2, 3)")
    return "".join(out)


REMOVED = SCENARIOS + _removed_sql()


def _scenarios(spark, d) -> tuple[DataFrame, DataFrame]:
    """Weights between nodes as they are, and without each road in turn: (o, node, c) and (link, o, node, c).

    All scenarios are searched at once; state is dealt by scenario, origin and node."""
    e = N.edges(spark, d)
    links = N.roads(spark, d).select(F.col("code").alias("link"))
    nodes = e.select(F.col("u").alias("node")).distinct()
    seeds = nodes.crossJoin(F.broadcast(links)).select("link", F.col("node").alias("o"), "node", F.lit(0.0).alias("c"))
    return _skim(spark, d), G.shortest(e, seeds, group=["link", "o"], banned="link")


def _changes(spark, d) -> DataFrame:
    """link, o, d, before, after for every pair that is connected at first; after is null if it isn't any more."""
    before, after = _scenarios(spark, d)
    links = after.select("link").distinct()
    pairs = before.select("o", F.col("node").alias("d"), F.col("c").alias("before")).crossJoin(F.broadcast(links))
    return cut(pairs.join(after.select("link", "o", F.col("node").alias("d"), F.col("c").alias("after")), ["link", "o", "d"], "left"))


CHANGES = REMOVED + ", ch AS (SELECT l.link, s.o, s.d, s.c AS before, x.c AS after FROM skim s CROSS JOIN l LEFT JOIN removed x ON x.link = l.link AND x.o = s.o AND x.d = s.d)"


def _physical(spark, d, changes):
    """Demand times added hours; a pair that is cut off costs a day or five times its hours."""
    after = F.coalesce("after", F.col("before") + F.greatest(F.lit(24.0), 5 * F.col("before")))
    return changes.join(N.demand(spark, d), ["o", "d"]).groupBy("link").agg(r(F.sum(F.col("q") * (after - F.col("before"))), 4).alias("loss"))


@query("C1_physical_loss", CHANGES + " SELECT link, round(sum(q * (coalesce(after, before + greatest(24, 5 * before)) - before)), 4) AS loss FROM ch JOIN demand USING (o, d) GROUP BY link")
def c1(spark, d):
    return _physical(spark, d, _changes(spark, d))


def _social(spark, d, changes):
    """Mean added hours to the nearest health facility, weighted by population."""
    h = changes.where("d % 4 = 0 and d < 25").groupBy("link", F.col("o").alias("zone")).agg(F.min("before").alias("b"), F.min("after").alias("a"))
    added = F.greatest(F.lit(0.0), F.coalesce("a", F.col("b") + 24) - F.col("b"))
    return h.join(N.zones(spark, d), "zone").groupBy("link").agg(r(F.sum(F.col("population") * added) / F.sum("population")).alias("loss"))


@query("C2_social_loss", CHANGES + ", h AS (SELECT link, o, min(before) AS b, min(after) AS a FROM ch WHERE d % 4 = 0 AND d < 25 GROUP BY 1, 2) SELECT link, round(sum(population * greatest(0, coalesce(a, b + 24) - b)) / sum(population), 6) AS loss FROM h JOIN zones ON o = zone GROUP BY link")
def c2(spark, d):
    return _social(spark, d, _changes(spark, d))


def _economic(spark, d, changes):
    """Loss of exponential access to gateways, weighted by activity; one that is cut off gives none."""
    access = lambda c: F.sum(F.coalesce(F.exp(-F.col(c) / 2), F.lit(0.0)))
    h = changes.where("d % 5 = 0 and d < 25").groupBy("link", F.col("o").alias("zone")).agg(access("before").alias("b"), access("after").alias("a"))
    return h.join(N.zones(spark, d), "zone").groupBy("link").agg(r(F.sum(F.col("activity") * F.greatest(F.lit(0.0), F.col("b") - F.col("a"))) / F.sum("activity")).alias("loss"))


@query("C3_economic_loss", CHANGES + ", h AS (SELECT link, o, sum(exp(-before / 2)) AS b, sum(coalesce(exp(-after / 2), 0)) AS a FROM ch WHERE d % 5 = 0 AND d < 25 GROUP BY 1, 2) SELECT link, round(sum(activity * greatest(0, b - a)) / sum(activity), 6) AS loss FROM h JOIN zones ON o = zone GROUP BY link")
def c3(spark, d):
    return _economic(spark, d, _changes(spark, d))


def _airport(spark, d, changes):
    h = changes.where(f"d % {FACILITY} = 0 and d < 25").groupBy("link", F.col("o").alias("zone")).agg(F.min("before").alias("b"), F.min("after").alias("a"))
    people = F.col("population")
    return h.join(N.zones(spark, d), "zone").groupBy("link").agg(
        r(F.sum(F.when(F.col("a").isNull(), people).otherwise(0)) / F.sum(people)).alias("cut_off"), r(F.sum(people * (F.coalesce("a", F.col("b") + 24) - F.col("b"))) / F.sum(people)).alias("added")
    )


@query("C4_airport_cutoff", CHANGES + ", h AS (SELECT link, o, min(before) AS b, min(after) AS a FROM ch WHERE d % 6 = 0 AND d < 25 GROUP BY 1, 2) SELECT link, round(sum(CASE WHEN a IS NULL THEN population ELSE 0 END) / CAST(sum(population) AS DOUBLE), 6) AS cut_off, round(sum(population * (coalesce(a, b + 24) - b)) / sum(population), 6) AS added FROM h JOIN zones ON o = zone GROUP BY link")
def c4(spark, d):
    return _airport(spark, d, _changes(spark, d))


def _isolated(spark, d, changes):
    left = changes.groupBy("link", F.col("o").alias("zone")).agg((F.count("after") - 1).alias("n"))
    return left.join(N.zones(spark, d), "zone").groupBy("link").agg(F.sum(F.when(F.col("n") == 0, F.col("population")).otherwise(0)).alias("isolated"))


@query("A5_isolated_population", CHANGES + " SELECT link, CAST(sum(CASE WHEN n = 0 THEN population ELSE 0 END) AS BIGINT) AS isolated FROM (SELECT link, o, count(after) - 1 AS n FROM ch GROUP BY 1, 2) JOIN zones ON o = zone GROUP BY link")
def a5(spark, d):
    return _isolated(spark, d, _changes(spark, d))


COMPOSITE = N.with_sql("demand", "counts", "zones") + """, s AS (SELECT zone, coalesce((SELECT sum(q) FROM demand WHERE o = zones.zone), 0) AS p, population AS s, activity AS e, coalesce((SELECT max(q) FROM demand WHERE o = zones.zone), 0) AS i FROM zones),
m AS (SELECT zone, """ + ", ".join(f"CASE WHEN max({c}) OVER () - min({c}) OVER () > 1e-12 THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0 END AS {c}" for c in "psei") + " FROM s), t AS (SELECT zone, 0.35::DOUBLE * p + 0.25::DOUBLE * s + 0.25::DOUBLE * e + 0.15::DOUBLE * i AS score FROM m)"
WEIGHTS = {"p": 0.35, "s": 0.25, "e": 0.25, "i": 0.15}


@query("W1_composite_rank", COMPOSITE + " SELECT zone, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, zone) AS INT) AS rank FROM t")
def flagship(spark, d):
    """Zones by four measures of demand, people and activity, scaled to 0..1, weighted, summed and ranked."""
    flows = N.demand(spark, d).groupBy("o").agg(F.sum("q").alias("p"), F.max("q").alias("i"))
    s = N.zones(spark, d).join(flows, F.col("zone") == F.col("o"), "left").select(
        "zone", F.coalesce("p", F.lit(0.0)).alias("p"), F.col("population").cast("double").alias("s"), F.col("activity").alias("e"), F.coalesce("i", F.lit(0.0)).alias("i")
    )
    ends = s.agg(*[f(c).alias(f"{n}_{c}") for c in WEIGHTS for n, f in (("lo", F.min), ("hi", F.max))])
    score = sum((w * E.min_max(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c, w in WEIGHTS.items()), F.lit(0.0))
    scored = s.crossJoin(F.broadcast(ends)).select("zone", score.alias("score"))
    return scored.select("zone", r("score").alias("score"), F.row_number().over(Window.orderBy(F.desc(r("score", 9)), "zone")).alias("rank"))


@query("T3_top_links", COMPOSITE + " SELECT zone, round(score, 6) AS score FROM t ORDER BY round(score, 9) DESC, zone LIMIT 10")
def t3(spark, d):
    return flagship(spark, d).orderBy("rank").limit(10).select("zone", "score")


DIMENSIONS = {"physical": 0.35, "social": 0.25, "economic": 0.25, "interconnected": 0.15}
#: Weights of the measures within a dimension: people isolated and added hours to a health facility;
#: added hours to an airport and people cut off from all.
MEASURES = {"physical": {"p1": 1.0}, "social": {"s1": 0.4, "s2": 0.6}, "economic": {"e1": 1.0}, "interconnected": {"i1": 0.35, "i2": 0.65}}


@query("W1_link_rank")
def link_rank(spark, d):
    """Every road by its removal: each measure scaled to 0..1 over all links, those of a dimension weighted, the four
    dimensions weighted, summed and ranked."""
    changes = _changes(spark, d)
    s = _physical(spark, d, changes).withColumnRenamed("loss", "p1")
    s = s.join(_isolated(spark, d, changes).withColumnRenamed("isolated", "s1"), "link", "full")
    s = s.join(_social(spark, d, changes).withColumnRenamed("loss", "s2"), "link", "full")
    s = s.join(_economic(spark, d, changes).withColumnRenamed("loss", "e1"), "link", "full")
    s = s.join(_airport(spark, d, changes).toDF("link", "i2", "i1"), "link", "full")
    every = [m for own in MEASURES.values() for m in own]
    s = s.select("link", *(F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in every))
    ends = s.agg(*[f(m).alias(f"{n}_{m}") for m in every for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda m: E.min_max(F.col(m), F.col(f"lo_{m}"), F.col(f"hi_{m}"))
    s = s.crossJoin(F.broadcast(ends)).select("link", *(sum((w * scaled(m) for m, w in own.items()), F.lit(0.0)).alias(k) for k, own in MEASURES.items()))
    s = cut(s.withColumn("score", sum((w * F.col(k) for k, w in DIMENSIONS.items()), F.lit(0.0))))
    place = F.row_number().over(Window.orderBy(F.desc(r("score", 9)), "link"))
    return s.select("link", *(r(k).alias(k) for k in DIMENSIONS), r("score").alias("score"), place.alias("rank"))


@query("T3_top_links_by_dimension")
def link_tops(spark, d):
    """The ten links that score highest in each dimension."""
    s = link_rank(spark, d)
    s = s.select("link", F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).alias("value")) for k in DIMENSIONS))).alias("x")).select("x.dimension", "link", "x.value")
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("value"), "link"))
    return s.withColumn("place", place).where("place <= 10")
