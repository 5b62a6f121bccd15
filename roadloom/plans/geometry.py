"""Geometry over polylines: lines are arrays of points, all work stays in column expressions and equi-joins on grid cells."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import exprs as E
from roadloom.functions.projection import metres_sql, to_degrees, to_metres
from roadloom.operators import graph as G
from roadloom.operators import multimodal, splitting, terrain
from roadloom.operators.matching import attached
from roadloom.operators.nearest import nearest
from roadloom.plans.network import POINTS, _points, close_pairs
from roadloom.sources import network as N
from roadloom.sources.stored import cut, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


r6 = lambda c: F.round(c, 6)

# every road between zones as a line of three points: its ends, and a bend beside the middle
BENDS = N.with_sql("zones", "roads") + """, g AS (SELECT code, len, a.lon AS x1, a.lat AS y1, (a.lon + b.lon) / 2 + 0.1::DOUBLE AS x2, (a.lat + b.lat) / 2 + 0.07::DOUBLE AS y2, b.lon AS x3, b.lat AS y3
 FROM roads JOIN zones a ON u = a.zone JOIN zones b ON v = b.zone)"""


def lines(spark, d) -> DataFrame:
    """code, len, pts (array of x, y)."""
    z = N.zones(spark, d).select("zone", "lon", "lat")
    a, b = z.toDF("u", "x1", "y1"), z.toDF("v", "x3", "y3")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    middle = point((F.col("x1") + F.col("x3")) / 2 + 0.1, (F.col("y1") + F.col("y3")) / 2 + 0.07)
    return N.roads(spark, d).join(a, "u").join(b, "v").select("code", "len", F.array(point(F.col("x1"), F.col("y1")), middle, point(F.col("x3"), F.col("y3"))).alias("pts"))


def segments(pts: Column) -> Column:
    """Pairs (a, b) of neighbouring points."""
    n = F.size(pts) - 1
    return F.zip_with(F.slice(pts, 1, n), F.slice(pts, 2, n), lambda a, b: F.named_struct(F.lit("a"), a, F.lit("b"), b))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def length_km(pts: Column) -> Column:
    return total(F.transform(segments(pts), lambda s: E.distance_km(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def _km(a: str, b: str) -> str:
    return f"111.0::DOUBLE * sqrt(pow((x{a} - x{b}) * cos(radians((y{a} + y{b}) / 2)), 2) + pow(y{a} - y{b}, 2))"


@query("GE4_polyline_km", BENDS + f" SELECT code, round({_km('1', '2')} + {_km('2', '3')}, 6) AS km FROM g")
def ge4(spark, d):
    return lines(spark, d).select("code", r6(length_km(F.col("pts"))).alias("km"))


@query("GE16_midpoint", BENDS + " SELECT code, round(x2, 6) AS x, round(y2, 6) AS y FROM g")
def ge16(spark, d):
    """The middle vertex."""
    p = F.element_at("pts", (F.floor(F.size("pts") / 2) + 1).cast("int"))
    return lines(spark, d).select("code", r6(p["x"]).alias("x"), r6(p["y"]).alias("y"))


def _seg_sql(px: str, py: str, a: str, b: str) -> str:
    dx, dy = f"(x{b} - x{a})", f"(y{b} - y{a})"
    t = f"greatest(0, least(1, (({px} - x{a}) * {dx} + ({py} - y{a}) * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"sqrt(pow({px} - x{a} - {t} * {dx}, 2) + pow({py} - y{a} - {t} * {dy}, 2))"


def line_distance(px: Column, py: Column, pts: Column) -> Column:
    """From a point to the nearest segment of a line."""
    return F.array_min(F.transform(segments(pts), lambda s: E.segment_distance(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


@query("GE5_point_polyline", BENDS + f" SELECT code, round(least({_seg_sql('84.0', '27.5', '1', '2')}, {_seg_sql('84.0', '27.5', '2', '3')}), 6) AS distance FROM g")
def ge5(spark, d):
    return lines(spark, d).select("code", r6(line_distance(F.lit(84.0), F.lit(27.5), F.col("pts"))).alias("distance"))


@query("GE2_line_parts", BENDS + " SELECT code, 0 AS part, 2 AS points FROM g UNION ALL SELECT code, 1, 3 FROM g WHERE len > 40")
def ge2(spark, d):
    """Multi-part lines as one row a part; parts of fewer than two points go."""
    pts = F.col("pts")
    parts = F.array(F.slice(pts, 1, 2), F.when(F.col("len") > 40, pts).otherwise(F.slice(pts, 1, 1)))
    rows = lines(spark, d).select("code", F.posexplode(parts).alias("part", "p")).where(F.size("p") >= 2)
    return rows.select("code", "part", F.size("p").alias("points"))


@query("GE1_clean_lines", BENDS + " SELECT min(code) AS code, count(*) AS copies FROM (SELECT code, x1, y1, x2, y2, x3, y3 FROM g UNION ALL SELECT code || 'b', x1, y1, x2, y2, x3, y3 FROM g WHERE len > 40) GROUP BY x1, y1, x2, y2, x3, y3")
def ge1(spark, d):
    """Rows without geometry go, and of equal geometries the first stays."""
    g = lines(spark, d)
    again = g.where("len > 40").withColumn("code", F.concat("code", F.lit("b")))
    none = g.withColumn("pts", F.when(F.col("len") < 0, F.col("pts")))
    every = g.unionByName(again).unionByName(none).where("pts is not null and size(pts) > 1")
    return every.groupBy("pts").agg(F.min("code").alias("code"), F.count(F.lit(1)).alias("copies")).select("code", "copies")


@query("GE3_centroid", BENDS + f" SELECT code, round(({_km('1', '2')} * (x1 + x2) / 2 + {_km('2', '3')} * (x2 + x3) / 2) / ({_km('1', '2')} + {_km('2', '3')}), 6) AS x, round(({_km('1', '2')} * (y1 + y2) / 2 + {_km('2', '3')} * (y2 + y3) / 2) / ({_km('1', '2')} + {_km('2', '3')}), 6) AS y FROM g")
def ge3(spark, d):
    """The centre of a line, its segments weighted by their lengths."""
    size = lambda s: E.distance_km(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])
    centre = lambda c: total(F.transform(segments(F.col("pts")), lambda s: size(s) * (s["a"][c] + s["b"][c]) / 2)) / length_km(F.col("pts"))
    return lines(spark, d).select("code", r6(centre("x")).alias("x"), r6(centre("y")).alias("y"))


_X, _Y = metres_sql("lon", "lat", 45)


@query("S1_projected", N.with_sql("zones") + f" SELECT zone, round({_X}, 3) AS x, round({_Y}, 3) AS y, round(lon, 8) AS lon, round(lat, 8) AS lat FROM zones")
def s1(spark, d):
    """Zones in metres, and back in degrees."""
    at = N.zones(spark, d).select("zone", to_metres(F.col("lon"), F.col("lat"), 45).alias("m"))
    back = at.select("zone", "m.x", "m.y", to_degrees(F.col("m.x"), F.col("m.y"), 45).alias("g"))
    return back.select("zone", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("g.lon", 8).alias("lon"), F.round("g.lat", 8).alias("lat"))


def _metres(k: int) -> str:
    x, y = metres_sql(f"x{k}", f"y{k}", 45)
    return f"{x} AS mx{k}, {y} AS my{k}"


@query("GE3_centroid_metres", BENDS + f""", m AS (SELECT code, {_metres(1)}, {_metres(2)}, {_metres(3)} FROM g), w AS (SELECT *, sqrt(pow(mx2 - mx1, 2) + pow(my2 - my1, 2)) AS a, sqrt(pow(mx3 - mx2, 2) + pow(my3 - my2, 2)) AS b FROM m)
 SELECT code, round((a * (mx1 + mx2) + b * (mx2 + mx3)) / (2 * (a + b)), 2) AS x, round((a * (my1 + my2) + b * (my2 + my3)) / (2 * (a + b)), 2) AS y, round(a + b, 2) AS length FROM w""")
def ge3_metres(spark, d):
    """The centre of a line and its length, in projected metres."""
    g = lines(spark, d).select("code", F.transform("pts", lambda p: to_metres(p["x"], p["y"], 45)).alias("pts"))
    size = lambda s: F.sqrt(F.pow(s["b"]["x"] - s["a"]["x"], 2) + F.pow(s["b"]["y"] - s["a"]["y"], 2))
    parts = segments(F.col("pts"))
    whole = total(F.transform(parts, size))
    centre = lambda c: total(F.transform(parts, lambda s: size(s) * (s["a"][c] + s["b"][c]) / 2)) / whole
    return g.select("code", F.round(centre("x"), 2).alias("x"), F.round(centre("y"), 2).alias("y"), F.round(whole, 2).alias("length"))


@query("GE6_snapped_points", f"WITH RECURSIVE {POINTS}, e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.02::DOUBLE), w AS (SELECT id AS a, id AS b FROM p UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a), r AS (SELECT a AS id, min(b) AS root FROM w GROUP BY a) SELECT r.id, root, round_even(p.x, 3) AS x, round_even(p.y, 3) AS y FROM r JOIN p ON p.id = root")
def ge6(spark, d):
    """Points within 0.02 of each other, and those of their neighbours, become one: that of the smallest id, rounded."""
    p, size = _points(spark, d), 0.02
    # points of one place are one node of the search for pairs, however many there are
    places = cut(p.groupBy("x", "y").agg(F.min("id").alias("node")))
    both = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    close = cut(close_pairs(places.select(F.col("node").alias("id"), "x", "y"), size).select(both.alias("e")).select("e.u", "e.v"))
    root = G.components(close, places.select("node"))
    at = places.select(F.col("node").alias("label"), F.bround("x", 3).alias("rx"), F.bround("y", 3).alias("ry"))
    of_place = places.join(root, "node").join(at, "label").select("x", "y", F.col("label").alias("root"), "rx", "ry")
    return p.join(of_place, ["x", "y"]).select("id", "root", F.col("rx").alias("x"), F.col("ry").alias("y"))


CROSS = """, s AS (SELECT code, 1 AS k, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS bw FROM g UNION ALL SELECT code, 2, x2, y2, x3, y3 FROM g),
 c0 AS (SELECT s.code, s.k, t.code AS other, t.k AS other_k, s.ax, s.ay, s.bx, s.bw, (s.bx - s.ax) * (t.bw - t.ay) - (s.bw - s.ay) * (t.bx - t.ax) AS den, (t.ax - s.ax) * (t.bw - t.ay) - (t.ay - s.ay) * (t.bx - t.ax) AS num, (t.ax - s.ax) * (s.bw - s.ay) - (t.ay - s.ay) * (s.bx - s.ax) AS mum FROM s JOIN s t ON s.code <> t.code),
 c1 AS (SELECT *, num / den AS t, mum / den AS q FROM c0 WHERE abs(den) > 1e-12::DOUBLE), c2 AS (SELECT * FROM c1 WHERE t > 1e-6::DOUBLE AND t < 1 - 1e-6::DOUBLE AND q >= 0 AND q <= 1)"""


def crossings(g: DataFrame, size: float = 0.5) -> DataFrame:
    """code, k (segment), t (place on it) and the point where another line crosses; found by an equi-join on grid cells that both
    segments' boxes touch. Parallel lines don't cross; a line's own ends don't count."""
    s = g.select("code", F.posexplode(segments(F.col("pts"))).alias("k", "s")).select("code", (F.col("k") + 1).alias("k"), "s.a", "s.b")
    span = lambda c: F.sequence(F.floor(F.least(F.col("a")[c], F.col("b")[c]) / size), F.floor(F.greatest(F.col("a")[c], F.col("b")[c]) / size))
    cells = F.flatten(F.transform(span("x"), lambda i: F.transform(span("y"), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    cells = s.select("*", F.explode(cells).alias("cell"))
    other = cells.select(F.col("code").alias("other"), F.col("k").alias("other_k"), F.col("a").alias("c"), F.col("b").alias("e"), "cell")
    pairs = cells.join(other, "cell").where("code <> other").drop("cell").dropDuplicates(["code", "k", "other", "other_k"])
    x, y = (lambda p, q: F.col(q)["x"] - F.col(p)["x"]), (lambda p, q: F.col(q)["y"] - F.col(p)["y"])
    den = x("a", "b") * y("c", "e") - y("a", "b") * x("c", "e")
    t = F.when(F.abs(den) > 1e-12, (x("a", "c") * y("c", "e") - y("a", "c") * x("c", "e")) / den)
    q = F.when(F.abs(den) > 1e-12, (x("a", "c") * y("a", "b") - y("a", "c") * x("a", "b")) / den)
    found = pairs.select("code", "k", "a", "b", t.alias("t"), q.alias("q")).where((F.col("t") > 1e-6) & (F.col("t") < 1 - 1e-6) & (F.col("q") >= 0) & (F.col("q") <= 1))
    at = lambda c: F.col("a")[c] + F.col("t") * (F.col("b")[c] - F.col("a")[c])
    return found.select("code", "k", F.round("t", 9).alias("t"), F.round(at("x"), 6).alias("x"), F.round(at("y"), 6).alias("y")).distinct()


@query("GE7_crossings", BENDS + CROSS + " SELECT code, count(DISTINCT (k, round(t, 9))) + 1 AS pieces FROM c2 GROUP BY code")
def ge7(spark, d):
    """Lines split where another crosses them: the number of pieces of each that is split."""
    found = crossings(lines(spark, d)).select("code", "k", "t").distinct()
    return found.groupBy("code").agg((F.count(F.lit(1)) + 1).alias("pieces"))


@query("GE7_split_length", BENDS + CROSS + ", u AS (SELECT DISTINCT code, k, round(t, 9) AS t FROM c2), l AS (SELECT s.code, s.k, sqrt(pow(s.bx - s.ax, 2) + pow(s.bw - s.ay, 2)) AS size FROM s) SELECT u.code, count(*) AS cuts, round(sum(u.t * size), 5) AS before FROM u JOIN l ON l.code = u.code AND l.k = u.k GROUP BY u.code")
def ge7b(spark, d):
    g = lines(spark, d)
    size = g.select("code", F.posexplode(segments(F.col("pts"))).alias("k", "s")).select("code", (F.col("k") + 1).alias("k"), F.sqrt(F.pow(F.col("s.b.x") - F.col("s.a.x"), 2) + F.pow(F.col("s.b.y") - F.col("s.a.y"), 2)).alias("size"))
    cuts = crossings(g).select("code", "k", "t").distinct()
    return cuts.join(size, ["code", "k"]).groupBy("code").agg(F.count(F.lit(1)).alias("cuts"), F.round(F.sum(F.col("t") * F.col("size")), 5).alias("before"))


NODED = """, sg AS (SELECT code, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS b2, 0.0::DOUBLE AS f FROM g UNION ALL SELECT code, x2, y2, x3, y3, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) FROM g),
 s1 AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(b2 - ay, 2)) AS size FROM sg), ends AS (SELECT code, sum(size) AS whole FROM s1 GROUP BY code),
 pr AS (SELECT a.code, b.code AS other, a.f, a.size, (a.bx - a.ax) * (b.b2 - b.ay) - (a.b2 - a.ay) * (b.bx - b.ax) AS den, (b.ax - a.ax) * (b.b2 - b.ay) - (b.ay - a.ay) * (b.bx - b.ax) AS num, (b.ax - a.ax) * (a.b2 - a.ay) - (b.ay - a.ay) * (a.bx - a.ax) AS mum FROM s1 a JOIN s1 b ON a.code <> b.code),
 hit AS (SELECT code, f + num / den * size AS pos FROM pr WHERE abs(den) > 1e-12::DOUBLE AND num / den BETWEEN -1e-9::DOUBLE AND 1 + 1e-9::DOUBLE AND mum / den BETWEEN -1e-9::DOUBLE AND 1 + 1e-9::DOUBLE),
 stops AS (SELECT DISTINCT code, round(pos, 6) AS pos FROM hit JOIN ends USING (code) WHERE pos > 1e-6::DOUBLE AND pos < whole - 1e-6::DOUBLE UNION ALL SELECT code, 0 FROM ends UNION ALL SELECT code, whole FROM ends),
 pc AS (SELECT code, row_number() OVER w - 1 AS part, count(*) OVER (PARTITION BY code) - 1 AS pieces, lead(pos) OVER w - pos AS length FROM stops WINDOW w AS (PARTITION BY code ORDER BY pos))"""


@query("GE7_split_lines", BENDS + NODED + " SELECT code, part, pieces, round(length, 6) AS length, len FROM pc JOIN g USING (code) WHERE length IS NOT NULL")
def ge7_lines(spark, d):
    """Every line in the pieces that the others leave of it, with its attributes."""
    pieces = splitting.noded(lines(spark, d), size=0.5, carried=["len"])
    return pieces.select("code", "part", "pieces", r6("length").alias("length"), "len")


@query("GE8_shared_vertices", BENDS + ", v AS (SELECT code, round_even(x1, 5) AS x, round_even(y1, 5) AS y FROM g UNION SELECT code, round_even(x2, 5), round_even(y2, 5) FROM g UNION SELECT code, round_even(x3, 5), round_even(y3, 5) FROM g) SELECT x, y, count(*) AS features FROM v GROUP BY x, y HAVING count(*) > 1")
def ge8(spark, d):
    """Vertices that more than one line has: where lines are split."""
    v = lines(spark, d).select("code", F.explode("pts").alias("p")).select("code", F.bround("p.x", 5).alias("x"), F.bround("p.y", 5).alias("y")).distinct()
    return v.groupBy("x", "y").agg(F.count(F.lit(1)).alias("features")).where("features > 1")


@query("GE8_split_lengths", BENDS + f" SELECT code, 1 AS piece, round(len * {_km('1', '2')} / ({_km('1', '2')} + {_km('2', '3')}), 6) AS km FROM g UNION ALL SELECT code, 2, round(len * {_km('2', '3')} / ({_km('1', '2')} + {_km('2', '3')}), 6) FROM g")
def ge8b(spark, d):
    """A line split at its bend: the official length goes to the pieces in proportion to their geometry."""
    pts = F.col("pts")
    pieces = lines(spark, d).select("code", "len", length_km(pts).alias("all"), F.posexplode(F.array(F.slice(pts, 1, 2), F.slice(pts, 2, 2))).alias("n", "p"))
    return pieces.select("code", (F.col("n") + 1).alias("piece"), r6(F.col("len") * length_km(F.col("p")) / F.col("all")).alias("km"))


@query("GE9_nearest_edge", BENDS + f", q AS (SELECT zone, lon + 0.2::DOUBLE AS px, lat + 0.15::DOUBLE AS py FROM zones), n AS (SELECT zone, code, round(least({_seg_sql('px', 'py', '1', '2')}, {_seg_sql('px', 'py', '2', '3')}), 9) AS distance FROM q CROSS JOIN g) SELECT zone, min_by(code, {{'d': distance, 'c': code}}) AS code, round(min(distance), 6) AS distance FROM n GROUP BY zone")
def ge9(spark, d):
    """Each point's nearest line, ties to the smaller code."""
    q = N.zones(spark, d).select("zone", (F.col("lon") + 0.2).alias("x"), (F.col("lat") + 0.15).alias("y"))
    return nearest(q, line_sites(lines(spark, d))).select("zone", "site.code", r6("distance").alias("distance"))


def line_sites(g: DataFrame) -> DataFrame:
    """Every segment as a site named by its line and its place there."""
    s = g.select("code", F.posexplode(segments(F.col("pts"))).alias("k", "s"))
    return s.select(F.struct("code", "k").alias("site"), F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def _heads(spark, d) -> DataFrame:
    """Suppliers as places beside the network: id, x, y; several fall on one place."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), (80 + (k * 37 % 100) / 14).alias("x"), (26 + (k * 91 % 100) / 21).alias("y"))


SEGMENTS = """, sg AS (SELECT code, 0 AS k, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS b2, 0.0::DOUBLE AS f FROM g UNION ALL SELECT code, 1, x2, y2, x3, y3, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) FROM g),
 s1 AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(b2 - ay, 2)) AS size FROM sg),
 hp AS (SELECT s_suppkey AS id, 80 + (s_suppkey * 37 % 100) / 14 AS x, 26 + (s_suppkey * 91 % 100) / 21 AS y FROM supplier),
 h1 AS (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (b2 - ay)) / (size * size))) AS t FROM hp CROSS JOIN s1),
 h2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (b2 - ay), 2)), 9), code, k) AS n FROM h1),
 ends AS (SELECT code, sum(size) AS whole FROM s1 GROUP BY code),
 nk AS (SELECT code, printf('%.3f %.3f', round_even(x1, 3), round_even(y1, 3)) AS u, printf('%.3f %.3f', round_even(x3, 3), round_even(y3, 3)) AS v FROM g),
 h3 AS (SELECT h2.id, h2.code, round(sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (b2 - ay), 2)), 9) AS distance, f + t * size AS pos, whole, u, v,
   printf('%.3f %.3f', round_even(ax + t * (bx - ax), 3), round_even(ay + t * (b2 - ay), 3)) AS here FROM h2 JOIN ends USING (code) JOIN nk USING (code) WHERE n = 1),
 on_line AS (SELECT *, CASE WHEN pos <= 0 THEN u WHEN pos >= whole THEN v ELSE here END AS node FROM h3),
 firsts AS (SELECT code, node, min_by(pos, id) AS pos, min(id) AS first_id FROM on_line WHERE node <> u AND node <> v GROUP BY code, node)"""


@query("GE9_points_on_lines", BENDS + SEGMENTS + " SELECT id, o.code, round(distance, 6) AS distance, o.node, coalesce(first_id = id, FALSE) AS is_new FROM on_line o LEFT JOIN firsts f ON f.code = o.code AND f.node = o.node")
def ge9_points(spark, d):
    """Every place put onto its nearest line: its node there, and whether it made that node or found it."""
    nodes, _ = splitting.split(_heads(spark, d), lines(spark, d), digits=3)
    return nodes.select("id", "code", r6("distance").alias("distance"), "node", "is_new")


@query("GE9_split_edges", BENDS + SEGMENTS + """, stops AS (SELECT code, 0.0::DOUBLE AS pos, 0 AS kind, u AS node FROM nk UNION ALL SELECT code, whole, 2, v FROM ends JOIN nk USING (code) UNION ALL SELECT code, pos, 1, node FROM firsts),
 pc AS (SELECT code, row_number() OVER w - 1 AS part, node AS u, lead(node) OVER w AS v, lead(pos) OVER w - pos AS length FROM stops WINDOW w AS (PARTITION BY code ORDER BY pos, kind, node))
 SELECT u, v, code, part, round(length, 6) AS length FROM pc WHERE v IS NOT NULL UNION ALL SELECT v, u, code, part, round(length, 6) FROM pc WHERE v IS NOT NULL""")
def ge9_edges(spark, d):
    """What the places leave of the lines: pieces between nodes, both directions, with their lengths."""
    _, pieces = splitting.split(_heads(spark, d), lines(spark, d), digits=3)
    return pieces.select("u", "v", "code", "part", r6("length").alias("length"))


REACH = 0.2


@query("J13_matched_stations", BENDS + SEGMENTS + f""", st AS (SELECT o.code, s_acctbal AS n FROM on_line o JOIN supplier ON s_suppkey = id WHERE s_acctbal > 0 AND o.distance <= {REACH}::DOUBLE), m AS (SELECT code, median(n) AS n FROM st GROUP BY code),
 f AS (SELECT substr(code, 1, 3) AS route, median(n) AS n FROM st GROUP BY 1) SELECT r.code, round(coalesce(m.n, f.n, (SELECT median(n) FROM st)), 4) AS count, CASE WHEN m.n IS NOT NULL THEN 'station' WHEN f.n IS NOT NULL THEN 'route' ELSE 'network' END AS source
 FROM roads r LEFT JOIN m ON m.code = r.code LEFT JOIN f ON f.route = substr(r.code, 1, 3)""")
def j13_matched(spark, d):
    """Stations go to the nearest link within reach: a link's count is the median of its stations, else of its route's, else of all."""
    value = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("n"))
    at = nearest(_heads(spark, d).join(value, "id"), line_sites(lines(spark, d))).where(F.col("distance") <= REACH)
    at = cut(at.select(F.col("site.code").alias("code"), "n"))
    route = lambda c: F.substring(c, 1, 3)
    own = at.groupBy("code").agg(F.median("n").alias("m"))
    of_route = at.groupBy(route("code").alias("route")).agg(F.median("n").alias("f"))
    every = N.roads(spark, d).select("code", route("code").alias("route")).join(own, "code", "left").join(of_route, "route", "left").crossJoin(F.broadcast(at.agg(F.median("n").alias("g"))))
    source = F.when(F.col("m").isNotNull(), "station").when(F.col("f").isNotNull(), "route").otherwise("network")
    return every.select("code", F.round(F.coalesce("m", "f", "g"), 4).alias("count"), source.alias("source"))


@query("GE9_projection", BENDS + ", q AS (SELECT code, x1 + 0.3::DOUBLE AS px, y1 + 0.1::DOUBLE AS py, x1, y1, x2, y2 FROM g), t AS (SELECT *, greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM q) SELECT code, round(t, 6) AS t, round(x1 + t * (x2 - x1), 6) AS x, round(y1 + t * (y2 - y1), 6) AS y, t > 0 AND t < 1 AS splits FROM t")
def ge9b(spark, d):
    """The foot of a point on a segment; at an end of it nothing is split."""
    a, b = F.element_at("pts", 1), F.element_at("pts", 2)
    px, py, dx, dy = a["x"] + 0.3, a["y"] + 0.1, b["x"] - a["x"], b["y"] - a["y"]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - a["x"]) * dx + (py - a["y"]) * dy) / (dx * dx + dy * dy)))
    rows = lines(spark, d).select("code", a.alias("a"), dx.alias("dx"), dy.alias("dy"), t.alias("t"))
    return rows.select("code", r6("t").alias("t"), r6(F.col("a.x") + F.col("t") * F.col("dx")).alias("x"), r6(F.col("a.y") + F.col("t") * F.col("dy")).alias("y"), ((F.col("t") > 0) & (F.col("t") < 1)).alias("splits"))


def allocated(anchors: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Totals of anchors (district, x, y, total) dealt evenly to their k nearest nodes (node, x, y), by distance and node:
    district, node, place, amount. Shares add up to the total."""
    near = nearest(anchors, nodes.select(F.col("node").alias("site"), "x", "y"), k)
    n = near.groupBy("district").agg(F.count(F.lit(1)).alias("n"))
    return near.join(n, "district").select("district", F.col("site").alias("node"), "place", (F.col("total") / F.col("n")).alias("amount"))


NEAREST = f"{N.with_sql('zones')}, {POINTS}, n AS (SELECT zone, id, population, row_number() OVER (PARTITION BY zone ORDER BY round(sqrt(pow(x - lon, 2) + pow(y - lat, 2)), 9), id) AS place FROM zones CROSS JOIN p), k AS (SELECT * FROM n WHERE place <= 24)"


@query("T5_nearest_nodes", NEAREST + " SELECT zone AS district, id AS node, CAST(place AS INT) AS place FROM k")
def t5(spark, d):
    return _allocation(spark, d).select("district", "node", "place")


def _allocation(spark, d):
    z = N.zones(spark, d).select(F.col("zone").alias("district"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("population").cast("double").alias("total"))
    return allocated(z, _points(spark, d).withColumnRenamed("id", "node"), 24)


@query("GR19_allocation", NEAREST + ", s AS (SELECT id, zone, population / count(*) OVER (PARTITION BY zone) AS people FROM k) SELECT id AS node, round(sum(people), 6) AS people, string_agg(zone, '|' ORDER BY zone) AS districts FROM s GROUP BY id")
def gr19(spark, d):
    """District totals on their nearest nodes: what each node gets, and from which districts."""
    rows = _allocation(spark, d)
    return rows.groupBy("node").agg(r6(F.sum("amount")).alias("people"), F.array_join(F.transform(F.sort_array(F.collect_set("district")), lambda x: x.cast("string")), "|").alias("districts"))


@query("GR19_conservation", N.with_sql("zones") + " SELECT zone AS district, population, TRUE AS ok FROM zones")
def gr19b(spark, d):
    """What a district's nodes got is what the district has, within 1e-10 of it."""
    got = _allocation(spark, d).groupBy("district").agg(F.sum("amount").alias("got"))
    z = N.zones(spark, d).select(F.col("zone").alias("district"), "population").join(got, "district", "left")
    return z.select("district", "population", (F.abs(F.coalesce("got", F.lit(0.0)) - F.col("population")) <= 1e-10 * F.greatest(F.col("population"), F.lit(1))).alias("ok"))


@query("GR22_place_names", N.with_sql("zones") + f", {POINTS} SELECT id, min_by(name, {{'d': round(sqrt(pow(x - lon, 2) + pow(y - lat, 2)), 9), 'z': zone}}) AS place FROM p, zones GROUP BY id")
def gr22(spark, d):
    """The name of the nearest place."""
    z = N.zones(spark, d).select(F.struct("zone", "name").alias("site"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return nearest(_points(spark, d), z).select("id", F.col("site.name").alias("place"))


@query("V5_region_boxes", f"WITH {POINTS} SELECT CASE WHEN x < 82.5 THEN 'west' WHEN x < 85.7 THEN 'middle' ELSE 'east' END AS box, count(*) AS n FROM p WHERE y BETWEEN 26 AND 30.7 GROUP BY 1")
def v5(spark, d):
    return _points(spark, d).where("y between 26 and 30.7").groupBy(E.macro_region(F.col("x")).alias("box")).agg(F.count(F.lit(1)).alias("n"))


@query("V1_count_layer", N.with_sql("counts") + " SELECT regexp_replace(code, '[^A-Z0-9]', '', 'g') AS code, n, round(CASE WHEN n % 3 = 0 THEN 1e9 ELSE 0 END + n, 3) AS priority, n % 3 = 0 AS used FROM counts WHERE n > 0")
def v1(spark, d):
    """Positive counts with whether the fit used them, and the order in which labels are placed."""
    used = F.col("n") % 3 == 0
    return N.counts(spark, d).where("n > 0").select(E.link_code(F.col("code")).alias("code"), "n", (F.when(used, 1e9).otherwise(0.0) + F.col("n")).alias("priority"), used.alias("used"))


@query("W4_network_codes", N.with_sql("nodes", "roads") + ", " + N.skim_sql() + ", c AS (SELECT o AS node, min(d) AS k FROM skim GROUP BY o), s AS (SELECT k, sum(len) AS km, avg(u) AS x FROM roads JOIN c ON node = u GROUP BY k) SELECT k AS component, km, 'NH' || row_number() OVER (ORDER BY km DESC, x) AS code FROM s")
def w4(spark, d):
    """Components by length, the longest first, then by place: NH1, NH2 and so on."""
    e = N.edges(spark, d)
    label = G.components(e, e.select(F.col("u").alias("node")).distinct())
    s = N.roads(spark, d).join(label, F.col("u") == F.col("node")).groupBy(F.col("label").alias("component")).agg(F.sum("len").alias("km"), F.avg("u").alias("x"))
    return s.select("component", "km", F.concat(F.lit("NH"), F.row_number().over(Window.orderBy(F.desc("km"), "x"))).alias("code"))


@query("GR4_assignment_graph", N.with_sql("edges") + ", a AS (SELECT u, v, CASE WHEN (u + v) % 5 = 0 THEN 'air' WHEN (u + v) % 7 = 0 THEN 'access' ELSE 'road' END AS kind, len, design FROM roads) SELECT CASE WHEN CAST(u AS VARCHAR) <= CAST(v AS VARCHAR) THEN u || '_' || v ELSE v || '_' || u END AS key, kind, round(CASE kind WHEN 'air' THEN 4 + 10 * len / 400 ELSE len / greatest(0.4::DOUBLE * design, 1) END, 9) AS hours FROM a WHERE kind <> 'access' OR u % 2 = 0")
def gr4(spark, d):
    """Hours by kind of edge; access edges to assets that don't operate go; keys from the ends in the order of their texts."""
    u, v = F.col("u").cast("string"), F.col("v").cast("string")
    both = F.col("u") + F.col("v")
    kind = F.when(both % 5 == 0, "air").when(both % 7 == 0, "access").otherwise("road")
    rows = N.roads(spark, d).withColumn("kind", kind).where("kind <> 'access' or u % 2 = 0")
    hours = F.when(F.col("kind") == "air", 4 + 10 * F.col("len") / 400).otherwise(F.col("len") / F.greatest(0.4 * F.col("design"), F.lit(1.0)))
    return rows.select(F.when(u <= v, F.concat_ws("_", u, v)).otherwise(F.concat_ws("_", v, u)).alias("key"), "kind", F.round(hours, 9).alias("hours"))


@query("GR1_oneway", N.with_sql("roads") + ", t AS (SELECT *, CASE u % 4 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' END AS oneway FROM roads WHERE u <> v AND len > 1e-6) SELECT u, v, code FROM t WHERE coalesce(oneway, '') <> '-1' UNION ALL SELECT v, u, code FROM t WHERE coalesce(oneway, '') <> 'yes'")
def gr1(spark, d):
    """Directions by the one-way tag: forward, backward, else both; loops and lines of no length go."""
    tag = F.element_at(F.array(F.lit("yes"), F.lit("-1"), F.lit("no"), F.lit(None).cast("string")), (F.col("u") % 4 + 1).cast("int"))
    rows = N.roads(spark, d).where("u <> v and len > 1e-6").withColumn("tag", F.coalesce(F.lower(tag), F.lit("")))
    ahead = F.when(~F.col("tag").isin("-1", "reverse", "r"), F.struct(F.col("u").alias("a"), F.col("v").alias("b")))
    back = F.when(~F.col("tag").isin("yes", "true", "1", "t", "f"), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))
    ways = F.filter(F.array(ahead, back), lambda x: x.isNotNull())
    return rows.select("code", F.explode(ways).alias("w")).select(F.col("w.a").alias("u"), F.col("w.b").alias("v"), "code")


#: Of the lines that are chosen.
MOST_ALIKE, PER_REGION, CHOSEN = 0.6, 5, 10


def distinct_top(rows: DataFrame, chosen: int = CHOSEN, per_region: int = PER_REGION, alike: float = MOST_ALIKE) -> list[tuple]:
    """(code, score, region) of the best rows (code, score, region, cells) in order: none shares more than `alike` of its cells (of the smaller
    of two) with one before, and no region has more than `per_region`.

    The best row that is still open is taken, and it closes those that are like it: as many passes as rows are chosen, whatever the
    number of rows; a pass keeps one row a task."""
    left, taken, regions = rows, [], Counter()
    while len(taken) < chosen:
        best = left.orderBy(F.desc("score"), "code").limit(1).collect()
        if not best:
            break
        best = best[0]
        taken.append((best.code, best.score, best.region))
        regions[best.region] += 1
        own = F.array_distinct(F.array(*map(F.lit, best.cells)).cast("array<string>"))
        size = lambda c: F.size(F.array_distinct(c))
        share = F.size(F.array_intersect("cells", own)) / F.greatest(F.lit(1), F.least(size(F.col("cells")), size(own)))
        left = left.where((share <= alike) & (F.col("code") != best.code))
        if regions[best.region] >= per_region:
            left = left.where(~F.col("region").eqNullSafe(F.lit(best.region)))
    return taken


@query("T4_distinct_top", None)
def t4(spark, d):
    """The ten longest lines that share at most 60 % of their cells with any that is longer and chosen, five of a part of the country at most."""
    cells = F.transform("pts", lambda p: F.concat_ws("_", F.floor(p["x"]), F.floor(p["y"]))).alias("cells")
    rows = lines(spark, d).select("code", F.col("len").alias("score"), E.macro_region(F.element_at("pts", 1)["x"]).alias("region"), cells)
    return spark.createDataFrame([(k + 1, *x) for k, x in enumerate(distinct_top(cut(rows)))], "place int, code string, len double, region string")


@query("T6_spread_sample", None)
def t6(spark, d):
    """Of each district's points eight that lie far from each other: the nearest to its place first, then always the farthest from those
    taken, ties to the smaller id. A district's points are compared with the ones taken alone."""
    z = N.zones(spark, d).select("zone", "lon", "lat")
    best = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("zone"))
    p = cut(_points(spark, d).join(best, "id").join(z, "zone"))
    gap = lambda x, y: F.round(F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2)), 9)
    first = p.groupBy("zone").agg(F.min_by(F.struct("id", "x", "y"), F.struct(gap(F.col("lon"), F.col("lat")), "id")).alias("t"))
    taken = cut(first.select("zone", F.array("t").alias("taken")))
    for _ in range(7):
        far = p.join(taken, "zone").withColumn("gap", F.array_min(F.transform("taken", lambda t: gap(t["x"], t["y"])))).where("gap > 0")
        more = far.groupBy("zone").agg(F.max_by(F.struct("id", "x", "y"), F.struct("gap", -F.col("id"))).alias("t"))
        taken = cut(taken.join(more, "zone", "left").select("zone", F.when(F.col("t").isNotNull(), F.concat("taken", F.array("t"))).otherwise(F.col("taken")).alias("taken")))
    return taken.select("zone", F.posexplode("taken").alias("place", "t")).select("zone", "place", "t.id")


@query("GE10_labels_attached")
def ge10(spark, d):
    """Zones' labels, moved off their places, attached to the zones again."""
    z = N.zones(spark, d)
    k = F.col("zone")
    labels = z.select(k.alias("label"), (F.col("lon") + (k * 7 % 11) / 4 - 1).alias("x"), (F.col("lat") + (k * 3 % 7) / 3 - 1).alias("y"))
    return attached(labels, z.select(k.alias("area"), F.col("lon").alias("x"), F.col("lat").alias("y")))


#: Levels in metres of the classes of terrain, the buffer in degrees, and the class without any level.
BREAKS = {"Plain": (0.0, 400.0), "Rolling": (400.0, 900.0), "Mountainous": (900.0, 1500.0), "Steep": (1500.0, 9000.0)}
BUFFER, NO_LEVEL = 0.03, "Rolling"
CONTOURS = """, ct AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 > 0 THEN 40.0::DOUBLE * p_size END AS level, 80 + (p_partkey * 37 % 1009) / 300 AS qx, 26 + (p_partkey * 91 % 1013) / 250 AS qy FROM part),
 cl AS (SELECT id, level, qx AS ax, qy AS ay, qx + 0.02::DOUBLE AS bx, qy + 0.01::DOUBLE AS b2, qx + 0.05::DOUBLE AS ex, qy - 0.01::DOUBLE AS ey FROM ct),
 cs AS (SELECT id, level, ax AS cx, ay AS cy, bx AS dx, b2 AS dy FROM cl UNION ALL SELECT id, level, bx, b2, ex, ey FROM cl),
 cc AS (SELECT id, level, (m1 * (ax + bx) / 2 + m2 * (bx + ex) / 2) / (m1 + m2) AS x, (m1 * (ay + b2) / 2 + m2 * (b2 + ey) / 2) / (m1 + m2) AS y FROM (SELECT *, sqrt(pow(bx - ax, 2) + pow(b2 - ay, 2)) AS m1, sqrt(pow(ex - bx, 2) + pow(ey - b2, 2)) AS m2 FROM cl)),
 rs AS (SELECT code, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS b2 FROM g UNION ALL SELECT code, x2, y2, x3, y3 FROM g)"""


def _ends_sql(px: str, py: str, a: str, c: str, b: str, e: str) -> str:
    dx, dy = f"({b} - {a})", f"({e} - {c})"
    t = f"greatest(0, least(1, (({px} - {a}) * {dx} + ({py} - {c}) * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"sqrt(pow({px} - {a} - {t} * {dx}, 2) + pow({py} - {c} - {t} * {dy}, 2))"


_R, _C = ("ax", "ay", "bx", "b2"), ("cx", "cy", "dx", "dy")
_side = lambda s, x, y: f"(({s[2]} - {s[0]}) * ({y} - {s[1]}) - ({s[3]} - {s[1]}) * ({x} - {s[0]}))"
_across = lambda s, t: f"{_side(s, t[0], t[1])} * {_side(s, t[2], t[3])} < 0"
_APART = f"CASE WHEN {_across(_R, _C)} AND {_across(_C, _R)} THEN 0 ELSE least({', '.join(_ends_sql(s[k], s[k + 1], *t) for s, t in ((_R, _C), (_C, _R)) for k in (0, 2))}) END"
TERRAIN = f""", direct AS (SELECT code, avg(level) AS level FROM (SELECT DISTINCT code, id, level FROM rs CROSS JOIN cs WHERE level IS NOT NULL AND {_APART} <= {BUFFER}::DOUBLE) GROUP BY code),
 hw AS (SELECT code, CASE WHEN s1 >= s2 THEN x1 + (s1 + s2) / 2 / s1 * (x2 - x1) ELSE x2 + ((s1 + s2) / 2 - s1) / s2 * (x3 - x2) END AS hx, CASE WHEN s1 >= s2 THEN y1 + (s1 + s2) / 2 / s1 * (y2 - y1) ELSE y2 + ((s1 + s2) / 2 - s1) / s2 * (y3 - y2) END AS hy
  FROM (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS s1, sqrt(pow(x3 - x2, 2) + pow(y3 - y2, 2)) AS s2 FROM g)),
 near AS (SELECT code, level FROM (SELECT code, level, row_number() OVER (PARTITION BY code ORDER BY round(sqrt(pow(x - hx, 2) + pow(y - hy, 2)), 9), id) AS n FROM hw CROSS JOIN cc) WHERE n = 1),
 src AS (SELECT code, CASE WHEN len % 9 = 0 THEN 'Mountainous' WHEN len % 9 = 4 THEN 'Plain' END AS known FROM roads),
 lv AS (SELECT code, known, CASE WHEN known IS NULL THEN coalesce(d.level, n.level) END AS level, CASE WHEN known IS NOT NULL THEN 'source' WHEN d.level IS NOT NULL THEN 'direct' ELSE 'nearest' END AS how
  FROM g JOIN src USING (code) LEFT JOIN direct d USING (code) JOIN near n USING (code))"""
_CASES = " ".join(f"WHEN level >= {lo} AND level < {hi} THEN '{name}'" for name, (lo, hi) in BREAKS.items())


@query("GE11_terrain", BENDS + CONTOURS + TERRAIN + f" SELECT code, round(level, 6) AS elevation_m, coalesce(known, CASE {_CASES} ELSE '{list(BREAKS)[-1]}' END) AS terrain, CASE WHEN known IS NULL THEN '{terrain.FROM_CONTOURS}' ELSE '{terrain.FROM_SOURCE}' END AS terrain_source, how FROM lv")
def ge11(spark, d):
    """Terrain of every road: its source's code, else from the contours near it, else from the nearest contour. Parts stand for contours, which
    cover the west alone."""
    k, point = F.col("p_partkey"), lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = 80 + (k * 37 % 1009) / 300, 26 + (k * 91 % 1013) / 250
    pts = F.array(point(x, y), point(x + 0.02, y + 0.01), point(x + 0.05, y - 0.01))
    contours = table(spark, d, "part").select(k.alias("id"), pts.alias("pts"), F.when(k % 7 > 0, 40.0 * F.col("p_size")).alias("level"))
    code = F.when(F.col("len") % 9 == 0, " m").when(F.col("len") % 9 == 4, "P").otherwise("x")
    found = terrain.assigned(lines(spark, d).withColumn("source_code", code), contours, BUFFER, BREAKS, NO_LEVEL)
    return found.select("code", r6("elevation_m").alias("elevation_m"), "terrain", "terrain_source", "how")


LAYERS = """, v AS (SELECT code, 0 AS i, x1 AS x, y1 AS y FROM g UNION ALL SELECT code, 1, x2, y2 FROM g UNION ALL SELECT code, 2, x3, y3 FROM g),
 k AS (SELECT *, round_even(x, 5) AS kx, round_even(y, 5) AS ky FROM v), shared AS (SELECT kx, ky FROM k GROUP BY 1, 2 HAVING count(DISTINCT code) > 1),
 w AS (SELECT code, i, x, y, kx, ky, coalesce(111.0::DOUBLE * sqrt(pow((x - lag(x) OVER o) * cos(radians((y + lag(y) OVER o) / 2)), 2) + pow(y - lag(y) OVER o, 2)), 0) AS step FROM k WINDOW o AS (PARTITION BY code ORDER BY i)),
 way AS (SELECT *, sum(step) OVER (PARTITION BY code ORDER BY i) AS way, sum(step) OVER (PARTITION BY code) AS whole FROM w),
 stops AS (SELECT * FROM way WHERE i IN (0, 2) OR (kx, ky) IN (SELECT (kx, ky) FROM shared)),
 pc AS (SELECT code, row_number() OVER o - 1 AS segment, x AS ax, y AS ay, kx AS akx, ky AS aky, lead(x) OVER o AS bx, lead(y) OVER o AS b2, lead(kx) OVER o AS bkx, lead(ky) OVER o AS bky, (lead(way) OVER o - way) / greatest(whole, 1e-9) * len AS km
  FROM stops JOIN roads USING (code) WINDOW o AS (PARTITION BY code ORDER BY i)), p2 AS (SELECT * FROM pc WHERE km > 0),
 firsts AS (SELECT kx, ky, min({'c': code, 's': segment, 'e': e, 'x': x, 'y': y}) AS m FROM (SELECT code, segment, 0 AS e, akx AS kx, aky AS ky, ax AS x, ay AS y FROM p2 UNION ALL SELECT code, segment, 1, bkx, bky, bx, b2 FROM p2) GROUP BY kx, ky),
 nd AS (SELECT kx, ky, m.x AS x, m.y AS y, row_number() OVER (ORDER BY m) - 1 AS node FROM firsts),
 ed AS (SELECT least(a.node, b.node) AS u, greatest(a.node, b.node) AS v, km, code, segment FROM p2 JOIN nd a ON akx = a.kx AND aky = a.ky JOIN nd b ON bkx = b.kx AND bky = b.ky WHERE a.node <> b.node),
 e1 AS (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY km DESC, code, segment) AS n FROM ed),
 ap AS (SELECT s_suppkey AS id, 80 + (s_suppkey * 37 % 100) / 14 AS x, 26 + (s_suppkey * 91 % 100) / 21 AS y FROM supplier),
 an AS (SELECT *, row_number() OVER (ORDER BY x, y, id) AS n FROM ap),
 tie AS (SELECT an.id, an.n, node, round(111.0::DOUBLE * sqrt(pow((an.x - nd.x) * cos(radians((an.y + nd.y) / 2)), 2) + pow(an.y - nd.y, 2)), 9) AS km FROM an CROSS JOIN nd),
 t1 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, node) AS place FROM tie)"""


@query("GR2_multimodal_edges", BENDS + LAYERS + " SELECT 'road' AS kind, CAST(u AS VARCHAR) AS u, CAST(v AS VARCHAR) AS v, round(km, 6) AS km, code AS id, CAST(segment AS INT) AS segment FROM e1 WHERE n = 1 UNION ALL SELECT 'airport_access', CAST(node AS VARCHAR), printf('AP%03d', n), round(km, 6), CAST(id AS VARCHAR), 0 FROM t1 WHERE place = 1")
def gr2(spark, d):
    """Roads noded where they meet and suppliers tied to them as airfields: one table of typed edges."""
    roads = lines(spark, d).select(F.col("code").alias("id"), "pts", F.col("len").alias("km"))
    return multimodal.multimodal(roads, _heads(spark, d)).withColumn("km", r6("km"))
