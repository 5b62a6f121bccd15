"""Normalisers, joins, matrix checks, fit metrics and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadloom.functions import exprs as E
from roadloom.sources import network as N
from roadloom.sources.stored import cut, table, tasks

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


r6 = lambda c: F.round(c, 6)


@query("P3_positive_number", "SELECT p_partkey, CASE WHEN x > 0 THEN x END AS number FROM (SELECT p_partkey, TRY_CAST(regexp_extract(lower(p_name || ' ' || (p_size - 10) || ' km/h'), '([-+]?\\d*\\.?\\d+)', 1) AS DOUBLE) AS x FROM part)")
def p3(spark, d):
    return table(spark, d, "part").select("p_partkey", E.positive_number(F.concat("p_name", F.lit(" "), F.col("p_size") - 10, F.lit(" km/h"))).alias("number"))


@query("P5_reference_filter", "SELECT c_custkey FROM customer WHERE starts_with(c_mktsegment, 'AUTO') OR starts_with(c_mktsegment, 'BUILD') OR trim(c_mktsegment) = ''")
def p5(spark, d):
    """Prefixes from a text of tokens; `%` and `*` at their ends don't count."""
    tokens = [t.strip().rstrip("%*") for t in "AUTO%;BUILD*|BLANK".replace(";", "|").replace(",", "|").split("|")]
    c = F.col("c_mktsegment")
    keep = F.lit(False)
    for t in tokens:
        keep = keep | (F.trim(c) == "" if t == "BLANK" else c.startswith(t))
    return table(spark, d, "customer").where(keep).select("c_custkey")


@query("P10_zone_label", "SELECT zone, split_part(label, ' | ', 1) AS district, split_part(label, ' | ', 2) AS head FROM (SELECT n_nationkey AS zone, n_name || ' | ' || lower(n_name) || ' hq' AS label FROM nation)")
def p10(spark, d):
    label = F.concat("n_name", F.lit(" | "), F.lower("n_name"), F.lit(" hq"))
    part = lambda k: F.regexp_extract(label, r"^(.*?) \| (.*)$", k)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"), part(1).alias("district"), part(2).alias("head"))


@query("P11_link_code", "SELECT o_orderkey, regexp_replace(upper(trim(o_orderpriority)), '[^A-Z0-9]+', '', 'g') AS code FROM orders")
def p11(spark, d):
    return table(spark, d, "orders").select("o_orderkey", E.link_code(F.col("o_orderpriority")).alias("code"))


@query("P12_place_key", "SELECT p_partkey, coalesce(alias, k) AS place FROM (SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '', 'g') AS k FROM part) LEFT JOIN (VALUES ('part1', 'first'), ('part2', 'second')) a(k2, alias) ON k = k2")
def p12(spark, d):
    alias = F.create_map(*map(F.lit, ("part1", "first", "part2", "second")))
    k = E.place_key(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(alias[k], k).alias("place"))


@query("P13_route_codes", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(upper('nh ' || p_size || ', NH-' || (p_size % 7) || ' nh0' || (p_partkey % 120)), 'NH[ -]*0*(\\d+)', 1), lambda x: 'NH' || CASE WHEN len(x) < 2 THEN lpad(x, 2, '0') ELSE x END))), '|') AS routes FROM part")
def p13(spark, d):
    text = F.concat(F.lit("nh "), F.col("p_size"), F.lit(", NH-"), F.col("p_size") % 7, F.lit(" nh0"), F.col("p_partkey") % 120)
    return table(spark, d, "part").select("p_partkey", F.array_join(E.route_codes(text), "|").alias("routes"))


@query("P14_speed_with_source", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0.4::DOUBLE * p_size WHEN p_size % 3 = 1 THEN p_retailprice / 100 ELSE 30.0::DOUBLE END AS speed, CASE WHEN p_size % 3 = 0 THEN 'design' WHEN p_size % 3 = 1 THEN 'measured' ELSE 'default' END AS origin FROM part")
def p14(spark, d):
    """The first source that has a value, and its name."""
    kind = F.col("p_size") % 3
    sources = [("design", F.when(kind == 0, 0.4 * F.col("p_size"))), ("measured", F.when(kind == 1, F.col("p_retailprice") / 100)), ("default", F.lit(30.0))]
    found = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("speed"), F.lit(n).alias("origin"))) for n, v in sources])
    return table(spark, d, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.*")


@query("P15_surface", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'brass|steel') THEN 'paved' WHEN regexp_matches(lower(p_type), 'tin') THEN 'unpaved' WHEN p_size > 40 AND p_retailprice < 2000 THEN 'unpaved' ELSE 'paved' END AS surface FROM part")
def p15(spark, d):
    t = F.lower("p_type")
    kind = F.when(t.rlike("brass|steel"), "paved").when(t.rlike("tin"), "unpaved").when((F.col("p_size") > 40) & (F.col("p_retailprice") < 2000), "unpaved").otherwise("paved")
    return table(spark, d, "part").select("p_partkey", kind.alias("surface"))


@query("P16_bands", N.with_sql("zones") + " SELECT zone, CASE WHEN lat < 27.5 THEN 'plain' WHEN lat >= 29 THEN 'mountain' ELSE 'hill' END AS terrain, CASE WHEN lon < 82.5 THEN 'west' WHEN lon < 85.7 THEN 'middle' ELSE 'east' END AS part FROM zones")
def p16(spark, d):
    return N.zones(spark, d).select("zone", E.terrain(F.col("lat")).alias("terrain"), E.macro_region(F.col("lon")).alias("part"))


@query("P17_coordinates", "SELECT s_suppkey, s_suppkey % 90 + (s_suppkey % 60) / 60 + (s_suppkey % 7) / 3600 AS lat, -(s_suppkey % 180 + (s_suppkey % 13) / 60 + (s_suppkey % 50) / 3600) AS lon FROM supplier")
def p17(spark, d):
    """Degrees, minutes, seconds and hemisphere out of one text."""
    k = F.col("s_suppkey")
    text = F.format_string("%d° %d' %d\" N, %d° %d' %d\" W", k % 90, k % 60, k % 7, k % 180, k % 13, k % 50)
    part = lambda g, h: F.regexp_extract(text, rf"(\d+)° (\d+)' (\d+)\" {h}", g).cast("double")
    of = lambda h: E.sexagesimal(part(1, h), part(2, h), part(3, h), F.lit(h))
    return table(spark, d, "supplier").select("s_suppkey", of("N").alias("lat"), of("W").alias("lon"))


@query("P20_name_lookup", "WITH k AS (SELECT n_nationkey AS id, n_name AS name FROM nation), m AS (SELECT r_name, id, row_number() OVER (PARTITION BY r_name ORDER BY r_name <> name, id) AS n FROM region JOIN k ON contains(r_name, name) OR contains(name, r_name) OR contains(lower(name), lower(substr(r_name, 1, 2)))) SELECT r.r_name, coalesce(m.id, -1) AS id FROM region r LEFT JOIN m ON r.r_name = m.r_name AND n = 1")
def p20(spark, d):
    """Exact name, else the first that contains the other, else a default."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    close = F.col("r_name").contains(F.col("n_name")) | F.col("n_name").contains(F.col("r_name")) | F.lower("n_name").contains(F.lower(F.substring("r_name", 1, 2)))
    found = region.join(nation, close).groupBy("r_name").agg(F.min(F.struct((F.col("r_name") != F.col("n_name")).alias("x"), F.col("n_nationkey").alias("id"))).alias("m"))
    return region.join(found, "r_name", "left").select("r_name", F.coalesce("m.id", F.lit(-1)).alias("id"))


@query("P2_first_value", "SELECT event_id, coalesce(nullif(trim(CASE WHEN user_id % 4 = 0 THEN ' ' ELSE event_type END), ''), 'user ' || user_id) AS label FROM events")
def p2(spark, d):
    blank = F.when(F.col("user_id") % 4 == 0, F.lit(" ")).otherwise(F.col("event_type"))
    names = [blank, F.concat(F.lit("user "), F.col("user_id"))]
    return table(spark, d, "events").select("event_id", F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in names]).alias("label"))


def _unpivoted(od, columns):
    """A wide matrix, with the named columns, read back into long form."""
    if not columns:
        return od.where("q > 0").select("o", "d", "q")
    wide = od.groupBy("o").pivot("d", columns).agg(F.sum("q"))
    return wide.unpivot("o", [str(k) for k in columns], "d", "q").where("q > 0").select("o", F.col("d").cast("long").alias("d"), "q")


@query("S5_matrix_unpivot", N.with_sql("od") + " SELECT o, d, q FROM od WHERE q > 0")
def s5(spark, d):
    od = cut(N.od(spark, d))
    return _unpivoted(od, [x.d for x in od.select("d").distinct().orderBy("d").collect()])


@query("S17_positive_edges", N.with_sql("edges") + " SELECT u || '->' || v AS edge_key, t FROM edges WHERE t > 0 AND u IS NOT NULL")
def s17(spark, d):
    return N.edges(spark, d).where("t > 0 and u is not null and v is not null").select(F.concat_ws("->", "u", "v").alias("edge_key"), "t")


@query("S18_last_selected", "SELECT user_id, max_by(event_id, {'a': ts, 'b': event_id}) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def s18(spark, d):
    last = F.max_by("event_id", F.struct("ts", "event_id"))
    return table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(last.alias("event_id"))


@query("J4_labels_matched", "SELECT n.n_nationkey AS zone, coalesce(r.r_name, '(none)') AS head, r.r_name IS NULL AS unmatched FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey % 6 <> 5")
def j4(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    joined = n.join(r, (n.n_regionkey == r.r_regionkey) & (n.n_nationkey % 6 != 5), "left")
    return joined.select(F.col("n_nationkey").alias("zone"), F.coalesce("r_name", F.lit("(none)")).alias("head"), F.col("r_name").isNull().alias("unmatched"))


@query("J5_alignment", "WITH m AS (SELECT c_custkey AS label, c_mktsegment AS k FROM customer), z AS (SELECT DISTINCT o_orderpriority AS name, c_mktsegment AS k FROM orders JOIN customer ON o_custkey = c_custkey) SELECT name, z.k, count(label) AS matches, CASE WHEN count(label) = 0 THEN 'missing' WHEN count(label) = 1 THEN 'matched' ELSE 'ambiguous' END AS status, min(label) AS label FROM z LEFT JOIN m ON z.k = m.k GROUP BY 1, 2")
def j5(spark, d):
    return _aligned(spark, d, table(spark, d, "customer"))


def _aligned(spark, d, labelled):
    """Every zone's labels counted by a shared key: matched, ambiguous or missing."""
    c = table(spark, d, "customer")
    labels = labelled.groupBy(F.col("c_mktsegment").alias("k")).agg(F.count(F.lit(1)).alias("m"), F.min("c_custkey").alias("label"))
    named = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderpriority").alias("name"), F.col("c_mktsegment").alias("k")).distinct()
    m = F.coalesce("m", F.lit(0))
    status = F.when(m == 0, "missing").when(m == 1, "matched").otherwise("ambiguous")
    return named.join(labels, "k", "left").select("name", "k", m.alias("matches"), status.alias("status"), "label")


@query("J7_count_links", N.with_sql("roads") + " SELECT regexp_replace(code, '[^A-Z0-9]', '', 'g') AS code, count(DISTINCT l_partkey) AS parts, count(*) AS n FROM roads JOIN lineitem ON l_suppkey % 25 = u GROUP BY 1")
def j7(spark, d):
    lines = table(spark, d, "lineitem").select((F.col("l_suppkey") % 25).alias("u"), "l_partkey")
    # aggregated by the join key before the join; part sets are kept distinct
    parts = lines.groupBy("u").agg(F.countDistinct("l_partkey").alias("parts"), F.count(F.lit(1)).alias("n"))
    return N.roads(spark, d).join(parts, "u").select(E.link_code(F.col("code")).alias("code"), "parts", "n")


@query("J11_containment", "WITH p AS (SELECT r_regionkey, lower(substr(r_name, 1, 1)) AS k FROM region), m AS (SELECT r_regionkey, n_nationkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY abs(len(n_name) - len(k)), n_name) AS n FROM p JOIN nation ON contains(lower(n_name), k)) SELECT r_regionkey AS region, n_nationkey AS nation FROM m WHERE n = 1")
def j11(spark, d):
    """The name that contains the key and is closest to it in length, ties by name."""
    r = table(spark, d, "region").select("r_regionkey", F.lower(F.substring("r_name", 1, 1)).alias("k"))
    hit = r.join(table(spark, d, "nation"), F.lower("n_name").contains(F.col("k")))
    best = F.min_by("n_nationkey", F.struct(F.abs(F.length("n_name") - F.length("k")), "n_name"))
    return hit.groupBy(F.col("r_regionkey").alias("region")).agg(best.alias("nation"))


@query("J17_merge_scores", "WITH a AS (SELECT l_suppkey AS k, sum(l_quantity) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_suppkey AS k, sum(l_quantity) AS y FROM lineitem WHERE l_discount > 0.09 GROUP BY 1) SELECT coalesce(a.k, b.k) AS supplier, 0.5::DOUBLE * (coalesce(x, 0) + coalesce(y, 0)) AS score FROM a FULL JOIN b ON a.k = b.k")
def j17(spark, d):
    """Both scores in one aggregation of one scan."""
    line = table(spark, d, "lineitem").where("l_returnflag = 'R' or l_discount > 0.09D")
    part = lambda c: F.sum(F.when(c, F.col("l_quantity")).otherwise(0.0))
    return line.groupBy(F.col("l_suppkey").alias("supplier")).agg((0.5 * (part(F.col("l_returnflag") == "R") + part(F.expr("l_discount > 0.09D")))).alias("score"))


@query("ST1_set_difference", "SELECT DISTINCT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def st1(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).distinct().join(table(spark, d, "orders"), F.col("k") == F.col("o_custkey"), "left_anti")


@query("ST2_set_overlap", "WITH s AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), n AS (SELECT s, count(*) AS n FROM s GROUP BY 1) SELECT a.s AS a, b.s AS b, count(*) AS shared, round(count(*) / CAST(max(na.n) + max(nb.n) - count(*) AS DOUBLE), 6) AS jaccard FROM s a JOIN s b ON a.p = b.p AND a.s < b.s JOIN n na ON na.s = a.s JOIN n nb ON nb.s = b.s GROUP BY 1, 2")
def st2(spark, d):
    """All suppliers, by their parts' own keys."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    # dealt before, as hardly a row repeats: a scan's task would hold all rows of its file split otherwise
    return _overlaps(rows.repartition(tasks(spark, rows.count()), "s", "p").distinct())


#: Sets of one element that one list holds; a set meets an element's lists one by one.
LISTED = 1024


def _overlaps(s, listed: int = LISTED):
    """Jaccard of pairs of sets (s, p, distinct) that share support: each set meets the lists of the sets that hold its elements, and
    counts them.

    The lists are dealt by set, so that a task holds a count for each pair of its own sets only; tasks follow the number of pairs that meet."""
    s = cut(s)
    n = cut(s.groupBy("s").agg(F.count(F.lit(1)).alias("n")))
    holders = s.groupBy("p").agg(F.count(F.lit(1)).alias("m"))
    parts = tasks(s.sparkSession, holders.agg((F.sum(F.col("m") * F.col("m")) / 2).cast("long").alias("pairs")).head().pairs)
    lists = holders.select("p", F.ceil(F.col("m") / listed).alias("lists"))
    held = s.repartition(parts, "p").join(lists.repartition(parts, "p").hint("merge"), "p")
    own = held.select(F.col("s").alias("a"), "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lists") - 1)).alias("list"))
    others = held.groupBy("p", F.pmod(F.xxhash64("s"), "lists").alias("list")).agg(F.collect_list("s").alias("others"))
    met = own.repartition(parts, "p", "list").join(others.repartition(parts, "p", "list").hint("merge"), ["p", "list"])
    met = met.select("a", F.filter("others", lambda b: b > F.col("a")).alias("others")).where(F.size("others") > 0)
    shared = met.repartition(parts, "a").select("a", F.explode("others").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    sized = shared.join(n.select(F.col("s").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("s").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", "shared", r6(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


FIT = "SELECT l_orderkey, sum(l_quantity) AS y, sum(l_extendedprice) / 1500 AS m, 1 + count(*) % 3 AS w FROM lineitem GROUP BY 1"


def _fit(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("y"), (F.sum("l_extendedprice") / 1500).alias("m"), (1 + F.count(F.lit(1)) % 3).alias("w")
    )


@query("A1_scale", f"SELECT round(sum(w * m * y / greatest(y, 1)) / sum(w * m * m / greatest(y, 1)), 6) AS scale FROM ({FIT})")
def a1(spark, d):
    """The factor that fits the model to the counts by weighted least squares."""
    v = F.greatest("y", F.lit(1.0))
    return _fit(spark, d).agg(r6(F.sum(F.col("w") * F.col("m") * F.col("y") / v) / F.sum(F.col("w") * F.col("m") * F.col("m") / v)).alias("scale"))


@query("A2_fit_metrics", f"""WITH f AS ({FIT}), g AS (SELECT *, CASE WHEN m + y > 0 THEN sqrt(2 * (m - y) * (m - y) / (m + y)) ELSE 0 END AS geh FROM f)
SELECT count(*) AS n, round(sqrt(avg((m - y) * (m - y))), 6) AS rmse, round(avg(abs(m - y)), 6) AS mae, round(sqrt(sum(w * (m - y) * (m - y)) / sum(w)), 6) AS weighted_rmse,
 round(1 - sum((m - y) * (m - y)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((m - y) * (m - y))) / avg(y), 6) AS relative_rmse, round(avg(geh), 6) AS mean_geh, round(avg(CAST(geh < 5 AS INT)), 6) AS share_geh5 FROM g""")
def a2(spark, d):
    """All fit metrics in one aggregation."""
    e2 = (F.col("m") - F.col("y")) * (F.col("m") - F.col("y"))
    g = E.geh(F.col("m"), F.col("y"))
    return _fit(spark, d).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sqrt(F.avg(e2))).alias("rmse"), r6(F.avg(F.abs(F.col("m") - F.col("y")))).alias("mae"),
        r6(F.sqrt(F.sum(F.col("w") * e2) / F.sum("w"))).alias("weighted_rmse"), r6(1 - F.sum(e2) / (F.var_pop("y") * F.count(F.lit(1)))).alias("r2"),
        r6(F.sqrt(F.avg(e2)) / F.avg("y")).alias("relative_rmse"), r6(F.avg(g)).alias("mean_geh"), r6(F.avg((g < 5).cast("int"))).alias("share_geh5"),
    )


@query("A3_fit_summary", f"SELECT w, count(*) AS n, round(100 * avg(abs(m - y) / y), 6) AS mape, CAST(sum(CAST(abs(m - y) <= 0.1::DOUBLE * y AS INT)) AS BIGINT) AS within_10, CAST(sum(CAST(abs(m - y) <= 0.25::DOUBLE * y AS INT)) AS BIGINT) AS within_25 FROM ({FIT}) WHERE y > 0 GROUP BY w")
def a3(spark, d):
    err = F.abs(F.col("m") - F.col("y"))
    within = lambda s: F.count_if(err <= s * F.col("y"))
    return _fit(spark, d).where("y > 0").groupBy("w").agg(F.count(F.lit(1)).alias("n"), r6(100 * F.avg(err / F.col("y"))).alias("mape"), within(0.1).alias("within_10"), within(0.25).alias("within_25"))


@query("A6_weighted_means", "SELECT l_suppkey AS link, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS mean, median(l_quantity) AS middle, bool_or(l_returnflag = 'R') AS bridge FROM lineitem GROUP BY 1")
def a6(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("link")).agg(
        r6(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity")).alias("mean"), F.median("l_quantity").alias("middle"), F.bool_or(F.col("l_returnflag") == "R").alias("bridge")
    )


@query("A7_dominant", "WITH s AS (SELECT l_suppkey AS k, l_returnflag AS f, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT k, min_by(f, {'a': -q, 'b': f}) AS dominant, string_agg(f, '|' ORDER BY f) AS every FROM s GROUP BY k")
def a7(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("f")).agg(F.sum("l_quantity").alias("q"))
    return s.groupBy("k").agg(F.min_by("f", F.struct(-F.col("q"), "f")).alias("dominant"), F.array_join(F.sort_array(F.collect_set("f")), "|").alias("every"))


@query("A8_region_share", N.with_sql("zones") + " SELECT zone, round(activity / sum(activity) OVER (PARTITION BY region) / (SELECT count(DISTINCT region) FROM zones WHERE activity > 0), 9) AS share FROM zones")
def a8(spark, d):
    z = N.zones(spark, d)
    totals = z.where("activity > 0").groupBy("region").agg(F.sum("activity").alias("total"))
    n = totals.agg(F.count(F.lit(1)).alias("regions"))
    return z.join(totals, "region").crossJoin(F.broadcast(n)).select("zone", F.round(F.col("activity") / F.col("total") / F.col("regions"), 9).alias("share"))


@query("A13_value_counts", "SELECT c_mktsegment AS value, count(*) AS n, count(DISTINCT c_nationkey) AS distinct_nations FROM customer GROUP BY 1")
def a13(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_nationkey").alias("distinct_nations"))


@query("A15_matrix_checks", N.with_sql("od") + " SELECT max(abs(a.q - coalesce(b.q, 0))) AS asymmetry, CAST(sum(CAST(a.o = a.d AND a.q <> 0 AS INT)) AS BIGINT) AS diagonal, count(DISTINCT a.o) AS origins, count(DISTINCT a.d) AS destinations, count(*) AS cells FROM od a LEFT JOIN od b ON a.o = b.d AND a.d = b.o")
def a15(spark, d):
    """Each cell meets its mirror under one key, so the matrix is read once and joined with nothing."""
    cells = N.od(spark, d)
    mirrored = cells.groupBy(F.least("o", "d").alias("x"), F.greatest("o", "d").alias("y")).agg(
        F.sum(F.when(F.col("o") <= F.col("d"), F.col("q")).otherwise(-F.col("q"))).alias("gap"), F.count(F.lit(1)).alias("n")
    )
    gap = mirrored.agg(F.max(F.when(F.col("x") == F.col("y"), 0.0).otherwise(F.abs("gap"))).alias("asymmetry"))
    counts = cells.agg(
        F.count_if((F.col("o") == F.col("d")) & (F.col("q") != 0)).alias("diagonal"), F.countDistinct("o").alias("origins"), F.countDistinct("d").alias("destinations"), F.count(F.lit(1)).alias("cells")
    )
    return gap.crossJoin(counts)


@query("A17_od_totals", N.with_sql("od") + " SELECT sum(q) AS total, sum(CASE WHEN q < 100 THEN q ELSE 0 END) AS below, sum(CASE WHEN o = d THEN q ELSE 0 END) AS same_zone, count(*) AS cells FROM od")
def a17(spark, d):
    part = lambda c: F.sum(F.when(c, F.col("q")).otherwise(0.0))
    return N.od(spark, d).agg(F.sum("q").alias("total"), part(F.col("q") < 100).alias("below"), part(F.col("o") == F.col("d")).alias("same_zone"), F.count(F.lit(1)).alias("cells"))


@query("T1_top_cells", N.with_sql("od") + " SELECT o, d, q FROM od WHERE o <> d AND q > 0 ORDER BY q DESC, o, d LIMIT 50")
def t1(spark, d):
    return N.od(spark, d).where("o <> d and q > 0").orderBy(F.desc("q"), "o", "d").limit(50)


@query("T2_top_per_group", "WITH r AS (SELECT l_suppkey AS link, l_orderkey, l_linenumber, l_extendedprice AS loss, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) SELECT link, CAST(rank AS INT) AS rank, l_orderkey, loss FROM r WHERE rank <= 5")
def t2(spark, d):
    w = Window.partitionBy("link").orderBy(F.desc("loss"), "l_orderkey", "l_linenumber")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("link"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("loss"))
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("link", "rank", "l_orderkey", "loss")


@query("W3_sequential_ids", "SELECT n_name, printf('LNK%04d', CAST(row_number() OVER (ORDER BY n_name) AS INT)) AS id FROM nation")
def w3(spark, d):
    """Numbers over one row per nation; the window has no partition because its table has a fixed size."""
    return table(spark, d, "nation").select("n_name", F.format_string("LNK%04d", F.row_number().over(Window.orderBy("n_name"))).alias("id"))


@query("K4_pair_table", N.with_sql("zones", "demand") + " SELECT a.name || ' | ' || b.name AS pair, q FROM demand JOIN zones a ON o = a.zone JOIN zones b ON d = b.zone WHERE o < d")
def k4(spark, d):
    z = N.zones(spark, d).select("zone", "name")
    a, b = z.toDF("o", "name_o"), z.toDF("d", "name_d")
    return N.demand(spark, d).where("o < d").join(a, "o").join(b, "d").select(F.concat_ws(" | ", "name_o", "name_d").alias("pair"), "q")


@query("JS_event_properties", "SELECT event_type, count(*) AS n, count(DISTINCT props) AS kinds, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def js(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("props").alias("kinds"), r6(F.avg("value")).alias("mean"))
