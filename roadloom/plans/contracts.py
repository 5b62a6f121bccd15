"""Sources, contracts, staged joins and sinks over the trade tables and the derived network."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadloom.functions import exprs as E
from roadloom.operators import contracts as C
from roadloom.operators.nearest import nearest
from roadloom.plans import calibration as K
from roadloom.plans import routing as R
from roadloom.sources import network as N
from roadloom.sources.stored import cut, shared_base, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


r6 = lambda c: F.round(c, 6)


# sources


@query("P1_canonical_columns", "SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS label, CAST(NULL AS VARCHAR) AS surface FROM part")
def p1(spark, d):
    df = table(spark, d, "part").withColumnRenamed("p_name", "Link Name").withColumn("p_partkey", F.col("p_partkey").cast("string"))
    return C.renamed(df, {"code": ("link_code", "P-PARTKEY"), "label": ("road_name", "link_name"), "surface": ("pavement",)}, required=["code"])


@query("P4_standardised_roads", "SELECT p_partkey AS code, p_retailprice AS count, CAST(p_size AS DOUBLE) AS design_speed, 'no' AS oneway FROM part WHERE p_size > 0")
def p4(spark, d):
    """Aliased columns, a default, and errors for a column without any value."""
    df = C.renamed(table(spark, d, "part"), {"code": ("p_partkey",), "count": ("p_retailprice",), "design_speed": ("p_size",), "oneway": ("one_way",)}, required=["code", "count", "design_speed"])
    df = df.withColumns({"design_speed": F.col("design_speed").cast("double"), "oneway": F.coalesce("oneway", F.lit("no"))}).where("design_speed > 0")
    if df.isEmpty():
        raise ValueError("no road has a design speed")
    return df


@query("P7_area_labels", "SELECT DISTINCT trim(c_mktsegment) AS district, trim(n_name) AS head FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE trim(c_mktsegment) <> ''")
def p7(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.trim("c_mktsegment").alias("district"), F.trim("n_name").alias("head")).where(F.length("district") > 0).dropDuplicates()


@query("P21_rounded_coordinates", "SELECT o_orderkey, round_even(o_totalprice / 7, 3) AS x, round_even(o_totalprice / 11, 5) AS y FROM orders")
def p21(spark, d):
    """Half to even, as for keys of nodes."""
    return table(spark, d, "orders").select("o_orderkey", F.bround(F.col("o_totalprice") / 7, 3).alias("x"), F.bround(F.col("o_totalprice") / 11, 5).alias("y"))


@query("P19_status", "WITH k(word, status) AS (VALUES ('build', 'open'), ('auto', 'closed'), ('house', 'planned')), g(code, status) AS (VALUES (3, 'open'), (8, 'closed')) SELECT c_custkey, coalesce((SELECT min(status) FROM k WHERE contains(lower(c_mktsegment), word) OR contains(word, lower(c_mktsegment))), g.status, 'unknown') AS status FROM customer LEFT JOIN g ON code = c_nationkey")
def p19(spark, d):
    """By a word that either name contains, else by the registry's code, else unknown."""
    words = {"build": "open", "auto": "closed", "house": "planned"}
    name = F.lower("c_mktsegment")
    by_word = F.array_min(F.filter(F.array(*(F.when(name.contains(w) | F.lit(w).contains(name), F.lit(s)) for w, s in words.items())), lambda x: x.isNotNull()))
    registry = F.create_map(*map(F.lit, (3, "open", 8, "closed")))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(by_word, F.element_at(registry, F.col("c_nationkey")), F.lit("unknown")).alias("status"))


@query("S3_layers", "SELECT * FROM (SELECT 'roads' AS key, 'lineitem' AS layer, (SELECT count(*) FROM lineitem) AS n UNION ALL SELECT 'zones', 'nation', (SELECT count(*) FROM nation) UNION ALL SELECT 'airports', NULL, 0)")
def s3(spark, d):
    """Layers by the first candidate that is there, in any case; an optional one that is missing is an empty typed table."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(d)
    listed = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path)
    there = {s.getPath().getName().removesuffix(".parquet").lower(): s.getPath().getName().removesuffix(".parquet") for s in listed}
    keys = {"roads": (["NH", "LineItem"], None), "zones": (["district_hq", "NATION"], None), "airports": (["airport"], "name string, x double, y double")}
    out = None
    for key, (tried, empty) in keys.items():
        layer = next((there[t.lower()] for t in tried if t.lower() in there), None)
        if layer is None and empty is None:
            raise ValueError(f"no layer for {key}: tried {tried}, found {sorted(there.values())}")
        df = table(spark, d, layer) if layer else spark.createDataFrame([], empty)
        row = df.agg(F.lit(key).alias("key"), F.lit(layer).cast("string").alias("layer"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


# a table of parameters: types of parts with dashes of both kinds, some under a second name, some headings and check sums between
PARAMS_SQL = """SELECT CASE WHEN p_partkey % 11 = 0 THEN 'Parameter name' WHEN p_partkey % 13 = 0 THEN 'Sum check ' || p_size WHEN p_partkey % 17 = 0 THEN ' ' ELSE p_type || CASE WHEN p_partkey % 2 = 0 THEN ' – ' ELSE '-' END || p_size END AS name,
 ' ' || p_partkey || ' ' AS value, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' - ' || p_partkey END AS alias FROM part"""
NORM = "lower(trim(regexp_replace(replace({}, '–', '-'), '[ -]+', ' ', 'g')))"


@query("S8_parameters", f"WITH r AS (SELECT {NORM.format('name')} AS key, trim(value) AS value, {NORM.format('alias')} AS other FROM ({PARAMS_SQL}) WHERE trim(name) <> '' AND NOT starts_with(lower(trim(name)), 'parameter') AND NOT starts_with(lower(trim(name)), 'sum check')) SELECT key, value FROM r UNION SELECT other, value FROM r WHERE other IS NOT NULL")
def s8(spark, d):
    """Name and value rows, under both names; headings and check sums don't count."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    dash = F.when(k % 2 == 0, " – ").otherwise("-")
    text = F.when(k % 11 == 0, "Parameter name").when(k % 13 == 0, F.concat(F.lit("Sum check "), size)).when(k % 17 == 0, " ").otherwise(F.concat("p_type", dash, size))
    alias = F.when(k % 3 == 0, F.concat("p_brand", F.lit(" - "), k.cast("string")))
    rows = table(spark, d, "part").select(text.alias("name"), F.concat(F.lit(" "), k.cast("string"), F.lit(" ")).alias("value"), alias.alias("alias"))
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "–", "-"), "[ -]+", " ")))
    name = F.lower(F.trim("name"))
    rows = rows.where((F.trim("name") != "") & ~name.startswith("parameter") & ~name.startswith("sum check"))
    keys = rows.select(F.explode(F.array(norm("name"), norm("alias"))).alias("key"), F.trim("value").alias("value"))
    return keys.where("key is not null").distinct()


@query("S9_promoted_header", "SELECT CAST(c_custkey AS VARCHAR) AS zone_id, c_name AS name, CAST(c_acctbal AS VARCHAR) AS population FROM customer WHERE c_custkey % 8 <> 0")
def s9(spark, d):
    """The row with the most known tokens is the header; rows before it, and empty ones after it, go. The sheet is the customers,
    every eighth row empty, below a title and a heading."""
    k = F.col("c_custkey")
    cell = lambda c: F.when(k % 8 == 0, "").otherwise(F.col(c).cast("string"))
    body = table(spark, d, "customer").select((k + 1).alias("n"), cell("c_custkey").alias("a"), cell("c_name").alias("b"), cell("c_acctbal").alias("c"))
    rows = spark.createDataFrame([(0, "Report", "Name", ""), (1, "zone_id", "Name", "Population")], "n long, a string, b string, c string").unionByName(body)
    known = {"zoneid", "name", "population", "province"}
    score = sum((E.place_key(F.col(c)).isin(*known).cast("int") for c in "abc"), F.lit(0))
    head = rows.select("n", "a", "b", "c", score.alias("score")).orderBy(F.desc("score"), "n").first()  # the names of the columns
    names = [C.plain_name(head[c]) for c in "abc"]
    body = rows.where((F.col("n") > head["n"]) & (F.length(F.concat("a", "b", "c")) > 0)).select(*(F.col(c).alias(x) for c, x in zip("abc", names, strict=True)))
    return C.renamed(body, {"zone_id": ("zoneid",), "name": (), "population": ()})


@query("S10_sections", """WITH s AS (SELECT c_custkey AS k, lower(n_name) AS n, lower(r_name) AS r, lower(c_mktsegment) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT CASE k % 4 WHEN 3 THEN r || '|' || m ELSE n || '|' || r || '|' || m END AS section, CAST(CASE k % 4 WHEN 3 THEN 2 ELSE 3 END AS INT) AS places FROM s WHERE k % 4 <> 2""")
def s10(spark, d):
    """Place sequences from a text with arrows or from origin, via and destination; the same in another case counts once; one place is no section."""
    kind = F.col("c_custkey") % 4
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(
        F.when(kind == 0, F.concat_ws(" -> ", "n_name", "r_name", "c_mktsegment")).when(kind == 1, F.lower("n_name")).when(kind == 2, F.col("n_name")).alias("origin"),
        F.when((kind == 1) | (kind == 3), F.col("r_name")).alias("via"), F.when((kind == 1) | (kind == 3), F.col("c_mktsegment")).alias("destination"),
    )
    text = F.concat_ws("->", "origin", "via", "destination")
    places = F.filter(F.transform(F.split(text, r"\s*->\s*"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return rows.select(F.array_join(places, "|").alias("section"), F.size(places).alias("places")).where("places >= 2").dropDuplicates(["section"])


@query("S11_formula_index", "SELECT p_brand AS dimension, p_type AS term, count(*) AS n FROM part WHERE p_type IS NOT NULL AND p_size % 5 <> 0 GROUP BY 1, 2")
def s11(spark, d):
    """Rows with a term and a formula; a blank one counts as none."""
    formula = F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("w*"), F.col("p_size")))
    rows = table(spark, d, "part").select(F.col("p_brand").alias("dimension"), F.col("p_type").alias("term"), formula.alias("formula"))
    return rows.where("term is not null and formula is not null").groupBy("dimension", "term").agg(F.count(F.lit(1)).alias("n"))


@query("S13_zones_contract", "SELECT CAST(c_custkey AS VARCHAR) AS zone_id, trim(c_name) AS name, TRY_CAST(CASE WHEN c_custkey % 9 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE) AS gdp FROM customer WHERE c_custkey % 7 <> 0")
def s13(spark, d):
    """Zones whose ids are numbers; texts that are no numbers become null."""
    c = table(spark, d, "customer")
    id_ = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("Z"), F.col("c_custkey"))).otherwise(F.col("c_custkey").cast("string"))
    gdp = F.when(F.col("c_custkey") % 9 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return C.zones(c.select(id_.alias("zone_id"), F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("name"), gdp.alias("gdp")), ["gdp"])


@query("S15_count_targets", N.with_sql("counts") + " SELECT code, split_part(code, '-', 1) AS ref, n, row_number() OVER (ORDER BY code) AS station_no FROM counts WHERE n > 0")
def s15(spark, d):
    """Links with a positive count; a missing reference is the code's first part. One row per counted link, numbered in order."""
    rows = N.counts(spark, d).where("n > 0").select("code", F.split("code", "-")[0].alias("ref"), "n")
    return rows.withColumn("station_no", F.row_number().over(Window.orderBy("code")).cast("long"))


RAW_WEIGHTS = "SELECT ['physical', 'social', 'economic', 'interconnected'][c_nationkey % 4 + 1] AS dimension, round(avg(c_acctbal) - 4000, 2) AS w FROM customer GROUP BY 1"


@query("S16_weights", f"WITH w AS ({RAW_WEIGHTS}), t AS (SELECT sum(greatest(w, 0)) AS total FROM w) SELECT dimension, round(CASE WHEN total > 0 THEN greatest(w, 0) / total ELSE w END, 6) AS weight FROM w, t")
def s16(spark, d):
    """Weights of the four dimensions as shares of their sum, negatives counting as nothing."""
    name = F.element_at(F.array(*map(F.lit, ("physical", "social", "economic", "interconnected"))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    raw = table(spark, d, "customer").groupBy(name.alias("dimension")).agg(F.round(F.avg("c_acctbal") - 4000, 2).alias("w"))
    rows = C.weights({r.dimension: r.w for r in raw.collect()})  # four rows
    return spark.createDataFrame(sorted(rows.items()), "dimension string, weight double").withColumn("weight", r6("weight"))


@query("S19_anchors", "SELECT regexp_replace(lower(trim(c_mktsegment)), '[^a-z0-9]+', '', 'g') AS district, max(c_custkey) AS row_no, max_by(c_acctbal, c_custkey) AS lon FROM customer GROUP BY 1")
def s19(spark, d):
    """Of a district that repeats the last row counts."""
    last = table(spark, d, "customer").groupBy(E.place_key(F.col("c_mktsegment")).alias("district")).agg(F.max(F.struct("c_custkey", "c_acctbal")).alias("x"))
    return last.select("district", F.col("x.c_custkey").alias("row_no"), F.col("x.c_acctbal").alias("lon"))


# contracts of matrices

BROKEN = """m AS (SELECT ' ' || o || ' ' AS o, CAST(d AS VARCHAR) AS d, CASE WHEN o = 3 AND d = 4 THEN 'x' WHEN o = 5 AND d = 6 THEN 'Infinity' WHEN o = 7 AND d = 8 THEN '-5' ELSE CAST(q AS VARCHAR) END AS value FROM od WHERE o <> 9)"""


def _broken(spark, d):
    at = lambda o, x: (F.col("o") == o) & (F.col("d") == x)
    value = F.when(at(3, 4), "x").when(at(5, 6), "Infinity").when(at(7, 8), "-5").otherwise(F.col("q").cast("string"))
    return N.od(spark, d).where("o <> 9").select(F.concat(F.lit(" "), F.col("o"), F.lit(" ")).alias("o"), F.col("d").cast("string").alias("d"), value.alias("value"))


@query("P9_matrix_faults", N.with_sql("od") + ", " + BROKEN + """, t AS (SELECT trim(o) AS o, trim(d) AS d, TRY_CAST(value AS DOUBLE) AS v FROM m)
SELECT 'not a number' AS check, count(*) FILTER (v IS NULL) AS n FROM t UNION ALL SELECT 'not finite', count(*) FILTER (isinf(v)) FROM t UNION ALL SELECT 'negative', count(*) FILTER (v < -1e-9) FROM t
UNION ALL SELECT 'diagonal', count(*) FILTER (o = d AND v <> 0) FROM t UNION ALL SELECT 'repeated', 0 UNION ALL SELECT 'row without column', (SELECT count(*) FROM (SELECT o FROM t EXCEPT SELECT d FROM t)) UNION ALL SELECT 'column without row', (SELECT count(*) FROM (SELECT d FROM t EXCEPT SELECT o FROM t))""")
def p9(spark, d):
    return C.matrix_faults(_broken(spark, d))


@query("P8_clean_matrix", N.with_sql("od") + " SELECT CAST(o AS VARCHAR) AS o, CAST(d AS VARCHAR) AS d, CASE WHEN o = d THEN 0 ELSE q END AS value FROM od WHERE o <> 2")
def p8(spark, d):
    """A row without any value goes; labels are trimmed; the diagonal is zero."""
    value = F.when(F.col("o") == 2, F.lit(None).cast("string")).otherwise(F.col("q").cast("string"))
    return C.clean_matrix(N.od(spark, d).select(F.concat(F.col("o"), F.lit("  ")).alias("o"), F.col("d").cast("string").alias("d"), value.alias("value")), fail=False)


def _heads(spark, d) -> DataFrame:
    return N.zones(spark, d).select(F.col("zone").alias("site"), F.col("lon").alias("x"), F.col("lat").alias("y"))


@query("P6_target_selection", N.with_sql("zones") + """, p AS (SELECT c_custkey AS id, 80 + (c_custkey * 37 % 1000) / 120 AS x, 26 + (c_custkey * 91 % 1000) / 250 AS y, c_acctbal AS n FROM customer),
 g AS (SELECT id, n, least(abs(x - 82.55::DOUBLE), abs(x - 85.75::DOUBLE)) AS edge, (SELECT min(sqrt(pow(p.x - lon, 2) + pow(p.y - lat, 2))) FROM zones) AS head FROM p)
 SELECT id, CASE WHEN edge > 0.5 THEN 'interior' WHEN n < 1000 THEN 'low' WHEN head < 0.3 THEN 'adjacent' ELSE 'primary' END AS class, CAST(CASE WHEN edge > 0.5 THEN 0 ELSE 1 END AS DOUBLE) AS weight, CAST(CASE WHEN edge > 0.5 THEN 100 WHEN n < 1000 THEN 4 WHEN head < 0.3 THEN 2 ELSE 1 END AS DOUBLE) AS variance FROM g""")
def p6(spark, d):
    """Counts near a boundary, large, and far from a head place are primary; weights and variance factors by class."""
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("id"), (80 + (k * 37 % 1000) / 120).alias("x"), (26 + (k * 91 % 1000) / 250).alias("y"), F.col("c_acctbal").alias("n"))
    edges = [((82.55, 0.0), (82.55, 90.0)), ((85.75, 0.0), (85.75, 90.0))]
    edge = F.least(*(E.segment_distance(F.col("x"), F.col("y"), *(F.lit(v) for ab in s for v in ab)) for s in edges))
    g = nearest(p, _heads(spark, d)).select("id", "n", edge.alias("edge"), F.col("distance").alias("head"))
    kind = F.when(F.col("edge") > 0.5, "interior").when(F.col("n") < 1000, "low").when(F.col("head") < 0.3, "adjacent").otherwise("primary")
    factor = F.create_map(*(F.lit(x) for kv in (("interior", 100.0), ("low", 4.0), ("adjacent", 2.0), ("primary", 1.0)) for x in kv))
    return g.select("id", kind.alias("class")).select("id", "class", F.when(F.col("class") == "interior", 0.0).otherwise(1.0).alias("weight"), factor[F.col("class")].alias("variance"))


# joins in stages


@query("J1_alignment_kept", "SELECT n_nationkey AS zone, n_name AS name, r_name AS aligned, CASE WHEN r_name IS NULL THEN 'missing' ELSE 'matched' END AS status FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2")
def j1(spark, d):
    right = table(spark, d, "region").where("r_regionkey <> 2")
    joined = table(spark, d, "nation").join(right, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select(F.col("n_nationkey").alias("zone"), F.col("n_name").alias("name"), F.col("r_name").alias("aligned"), F.when(F.col("r_name").isNull(), "missing").otherwise("matched").alias("status"))


FIT = "f AS (SELECT CAST(l_suppkey % 25 AS BIGINT) AS u, count(*) AS observed, sum(l_quantity) / 25 AS modelled FROM lineitem GROUP BY 1)"


def _fit(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 25).alias("u")).agg(F.count(F.lit(1)).alias("observed"), (F.sum("l_quantity") / 25).alias("modelled"))


@query("J2_mapping_fit", N.with_sql("roads") + f", {FIT} SELECT code, roads.u, observed, f.u AS u_target, round(modelled, 6) AS modelled FROM roads LEFT JOIN f ON roads.u = f.u")
def j2(spark, d):
    """Columns of both sides stay; those of the fit that clash get a suffix."""
    fit = _fit(spark, d).withColumnRenamed("u", "u_target")
    return N.roads(spark, d).join(fit, F.col("u") == F.col("u_target"), "left").select("code", "u", "observed", "u_target", r6("modelled").alias("modelled"))


@query("J3_links_fit", N.with_sql("counts") + " SELECT regexp_replace(code, '[^A-Z0-9]', '', 'g') AS code, n AS count, n % 3 = 0 AS used FROM counts WHERE n > 0")
def j3(spark, d):
    """The first fit row of a normalised code counts; links without one are not used."""
    links = N.counts(spark, d).where("n > 0").select(E.link_code(F.col("code")).alias("code"), F.col("n").alias("count"))
    fit = N.counts(spark, d).where("n > 0").select(E.link_code(F.col("code")).alias("code"), (F.col("n") % 3 == 0).alias("used"), F.explode(F.array(F.lit(1), F.lit(2))).alias("row_no"))
    fit = fit.groupBy("code").agg(F.min_by("used", "row_no").alias("used"))
    return links.join(fit, "code", "left").select("code", "count", F.coalesce("used", F.lit(False)).alias("used"))


@query("J6_label_nodes", "SELECT n_nationkey AS zone, r_name AS head FROM nation JOIN region ON n_regionkey = r_regionkey")
def j6(spark, d):
    """Every label has a node, or the join fails."""
    left = table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return C.joined_whole(left, table(spark, d, "region"), ["r_regionkey"], "labels").select(F.col("n_nationkey").alias("zone"), F.col("r_name").alias("head"))


@query("J12_zone_node", N.with_sql("zones") + """, p AS (SELECT s_suppkey AS id, 80 + (s_suppkey * 37 % 1000) / 120 AS x, 26 + (s_suppkey * 91 % 1000) / 250 AS y, s_nationkey % 20 AS zone, s_acctbal AS pop FROM supplier WHERE s_acctbal > 0),
 c AS (SELECT z.zone, id, row_number() OVER (PARTITION BY z.zone ORDER BY round(sqrt(pow(x - lon, 2) + pow(y - lat, 2)), 9), -pop, id) AS n FROM zones z JOIN p ON p.zone = z.zone),
 e AS (SELECT z.zone, id, row_number() OVER (PARTITION BY z.zone ORDER BY round(sqrt(pow(x - lon, 2) + pow(y - lat, 2)), 9), id) AS n FROM zones z CROSS JOIN p)
 SELECT z.zone, coalesce(c.id, e.id) AS node, CASE WHEN c.id IS NOT NULL THEN 'candidate' ELSE 'nearest' END AS method FROM zones z LEFT JOIN c ON c.zone = z.zone AND c.n = 1 LEFT JOIN e ON e.zone = z.zone AND e.n = 1""")
def j12(spark, d):
    """A zone's node: of its own candidates the nearest, then the largest, then the smallest; else the nearest of all."""
    k = F.col("s_suppkey")
    p = table(spark, d, "supplier").where("s_acctbal > 0").select(k.alias("id"), (80 + (k * 37 % 1000) / 120).alias("x"), (26 + (k * 91 % 1000) / 250).alias("y"), (F.col("s_nationkey") % 20).cast("long").alias("own"), F.col("s_acctbal").alias("pop"))
    z = N.zones(spark, d).select("zone", "lon", "lat")
    gap = F.round(F.sqrt(F.pow(F.col("x") - F.col("lon"), 2) + F.pow(F.col("y") - F.col("lat"), 2)), 9)
    own = z.join(p, F.col("zone") == F.col("own")).groupBy("zone").agg(F.min_by("id", F.struct(gap, -F.col("pop"), "id")).alias("node"))
    rest = z.join(own, "zone", "left_anti").select("zone", F.col("lon").alias("x"), F.col("lat").alias("y"))
    far = nearest(rest, p.select(F.col("id").alias("site"), "x", "y")).select("zone", F.col("site").alias("far"))
    return z.join(own, "zone", "left").join(far, "zone", "left").select("zone", F.coalesce("node", "far").alias("node"), F.when(F.col("node").isNotNull(), "candidate").otherwise("nearest").alias("method"))


@query("J13_station_counts", N.with_sql("roads") + """, s AS (SELECT s_suppkey AS id, (s_suppkey * 7 % 25) AS at, s_acctbal AS n FROM supplier WHERE s_acctbal > 0), m AS (SELECT u AS at, median(n) AS n FROM roads JOIN s ON s.at = roads.u GROUP BY 1), f AS (SELECT substr(code, 1, 3) AS route, median(m.n) AS n FROM roads JOIN m ON m.at = roads.u GROUP BY 1)
 SELECT code, round(coalesce(m.n, f.n, (SELECT median(n) FROM s)), 4) AS count, CASE WHEN m.n IS NOT NULL THEN 'station' WHEN f.n IS NOT NULL THEN 'route' ELSE 'default' END AS source FROM roads LEFT JOIN m ON m.at = roads.u LEFT JOIN f ON f.route = substr(code, 1, 3)""")
def j13(spark, d):
    """Counts of stations at a link, else the median of its route, else that of all stations."""
    s = table(spark, d, "supplier").where("s_acctbal > 0").select((F.col("s_suppkey") * 7 % 25).alias("u"), F.col("s_acctbal").alias("n"))
    roads = N.roads(spark, d).select("code", "u", F.substring("code", 1, 3).alias("route"))
    at = s.groupBy("u").agg(F.median("n").alias("m"))
    route = roads.join(at, "u").groupBy("route").agg(F.median("m").alias("f"))
    return roads.join(at, "u", "left").join(route, "route", "left").crossJoin(F.broadcast(s.agg(F.median("n").alias("g")))).select(
        "code", F.round(F.coalesce("m", "f", "g"), 4).alias("count"), F.when(F.col("m").isNotNull(), "station").when(F.col("f").isNotNull(), "route").otherwise("default").alias("source")
    )


@query("A12_map_groups", "SELECT l_suppkey AS link, round(0.75::DOUBLE * max(l_quantity) + 0.17::DOUBLE * avg(l_quantity) + 0.08::DOUBLE * max(l_discount), 6) AS score, min_by(l_returnflag, {'a': l_orderkey, 'b': l_linenumber}) AS first FROM lineitem GROUP BY 1")
def a12(spark, d):
    score = 0.75 * F.max("l_quantity") + 0.17 * F.avg("l_quantity") + 0.08 * F.max("l_discount")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("link")).agg(r6(score).alias("score"), F.min_by("l_returnflag", F.struct("l_orderkey", "l_linenumber")).alias("first"))


@query("A14_snap_quality", N.with_sql("zones") + ", g AS (SELECT c_custkey, (SELECT min(sqrt(pow(80 + (c_custkey * 37 % 1000) / 120 - lon, 2) + pow(26 + (c_custkey * 91 % 1000) / 250 - lat, 2))) FROM zones) AS gap FROM customer) SELECT round(max(gap), 6) AS most, round(avg(gap), 6) AS mean, count(*) FILTER (gap > 0.5) AS far FROM g")
def a14(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select((80 + (k * 37 % 1000) / 120).alias("x"), (26 + (k * 91 % 1000) / 250).alias("y"))
    g = nearest(p, _heads(spark, d)).select(F.col("distance").alias("gap"))
    return g.agg(r6(F.max("gap")).alias("most"), r6(F.avg("gap")).alias("mean"), F.count_if(F.col("gap") > 0.5).alias("far"))


@query("JS_properties_parsed", "SELECT event_type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || json_keys(props)[1])) AS kinds, CAST(sum(len(json_keys(props))) AS BIGINT) AS fields FROM events GROUP BY 1")
def js(spark, d):
    """The properties as maps: their fields counted, and the distinct values of the first one."""
    m = F.from_json("props", "map<string,string>")
    first = F.get(F.map_values(m), F.lit(0))
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(first).alias("kinds"), F.sum(F.size(F.map_keys(m))).alias("fields"))


# sinks: what is written is read back


def _written(spark, write) -> str:
    path = f"{shared_base(spark)}/roadloom-sink-{uuid.uuid4().hex}"
    write(path)
    return path


@query("K1_wide_csv", N.with_sql("od") + " SELECT CAST(o AS VARCHAR) AS o, CAST(d AS VARCHAR) AS d, q FROM od")
def k1(spark, d):
    """A matrix as CSV with a column for each label, and back into long form."""
    od = cut(N.od(spark, d))
    labels = [r.d for r in od.select("d").distinct().orderBy("d").collect()]  # one for each zone
    wide = od.groupBy("o").pivot("d", labels).agg(F.sum("q"))
    path = _written(spark, lambda p: wide.write.option("header", True).csv(p))
    back = spark.read.option("header", True).csv(path)
    return back.unpivot("o", [str(x) for x in labels], "d", "q").select("o", "d", F.col("q").cast("double").alias("q")).where("q is not null")


@query("K2_safe_names", "SELECT count(*) AS n, string_agg(k, ',' ORDER BY k) AS names FROM (VALUES ('Code'), ('code_2'), ('points')) t(k)")
def k2(spark, d):
    """Column names that differ whatever their case; arrays go out as JSON text."""
    df = N.roads(spark, d).select(F.col("code"), F.col("code").alias("x"), F.array("u", "v").alias("points"))
    names = C.unique_names(["Code", "code", "points"])
    safe = df.toDF(*names).withColumn("points", F.to_json("points"))
    path = _written(spark, lambda p: safe.write.parquet(p))
    return spark.createDataFrame([(len(names), ",".join(sorted(spark.read.parquet(path).columns)))], "n long, names string")


@query("K3_network_statistics", N.with_sql("edges", "roads") + " SELECT 'roads' AS stat, CAST(count(*) AS DOUBLE) AS value FROM roads UNION ALL SELECT 'km', sum(len) FROM roads UNION ALL SELECT 'nodes', count(DISTINCT u) FROM edges UNION ALL SELECT 'hours', round(sum(t), 6) FROM roads")
def k3(spark, d):
    roads, e = N.roads(spark, d), N.edges(spark, d)
    one = roads.agg(F.count(F.lit(1)).cast("double").alias("roads"), F.sum("len").alias("km"), F.round(F.sum("t"), 6).alias("hours")).crossJoin(e.agg(F.count_distinct("u").cast("double").alias("nodes")))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("stat"), F.col(k).alias("value")) for k in ("roads", "km", "nodes", "hours")))).alias("x")).select("x.*")


@query("K5_station_fit", K.CHAIN + """, st AS (SELECT s_suppkey AS station, s_suppkey * 7 % 30 AS spot, s_acctbal AS own FROM supplier), mp AS (SELECT station, own, code FROM st LEFT JOIN roads ON u = spot AND v = (u + 1) % 25),
 ft AS (SELECT v3.code, y, m * (SELECT scale FROM s2) AS f FROM v3)
SELECT station, mp.code, round(y, 4) AS count, round(f, 4) AS model, round(f - y, 4) AS error, CASE WHEN mp.code IS NULL THEN 'no link' WHEN y IS NULL THEN 'no count' WHEN own <= 0 THEN 'no value' WHEN abs(f - y) > y / 2 THEN 'large error' ELSE '' END AS warning FROM mp LEFT JOIN ft ON ft.code = mp.code""")
def k5(spark, d):
    """Stations with the link that they are mapped to, joined with the fit there, and what is amiss."""
    rows, scale = K.refined(K._targets(spark, d))
    fit = rows.select("code", F.col("y").alias("count"), (F.col("m") * scale).alias("model"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("station"), (F.col("s_suppkey") * 7 % 30).alias("u"), F.col("s_acctbal").alias("own"))
    ring = N.roads(spark, d).where("v = (u + 1) % 25").select("u", "code")
    at = s.join(ring, "u", "left").join(fit, "code", "left")
    off = F.col("model") - F.col("count")
    warning = F.when(F.col("code").isNull(), "no link").when(F.col("count").isNull(), "no count").when(F.col("own") <= 0, "no value").when(F.abs(off) > F.col("count") / 2, "large error").otherwise("")
    return at.select("station", "code", F.round("count", 4).alias("count"), F.round("model", 4).alias("model"), F.round(off, 4).alias("error"), warning.alias("warning"))


@query("K8_asset_list", N.with_sql("zones") + " SELECT zone, name, CASE WHEN zone % 12 = 0 THEN 'in operation' ELSE 'other' END AS status, row_number() OVER (ORDER BY CASE WHEN zone % 12 = 0 THEN 'in operation' ELSE 'other' END, name) AS place FROM zones WHERE zone % 6 = 0")
def k8(spark, d):
    z = N.zones(spark, d).where("zone % 6 = 0").select("zone", "name", F.when(F.col("zone") % 12 == 0, "in operation").otherwise("other").alias("status"))
    return z.withColumn("place", F.row_number().over(Window.orderBy("status", "name")).cast("long"))


@query("K9_audit_tables", N.with_sql("od", "roads") + " SELECT 'links' AS audit, count(*) AS n FROM roads UNION ALL SELECT 'pairs', count(*) FROM od")
def k9(spark, d):
    """Audit tables written side by side, and what was written."""
    out = None
    for name, df in (("links", N.roads(spark, d)), ("pairs", N.od(spark, d))):
        path = _written(spark, lambda p, df=df: df.write.parquet(p))
        row = spark.read.parquet(path).agg(F.lit(name).alias("audit"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


#: What the measures are, for the sheet of formulas.
FORMULAS = {
    "p1": "demand times added hours over the pairs whose path uses the link", "p2": "demand whose path uses the link",
    "s1": "people cut off from the largest part", "s2": "added hours to the nearest health facility per head",
    "e1": "loss of activity", "e2": "trade exposed", "i1": "added hours to the nearest airport per head", "i2": "share of people cut off from all airports",
}
ASSUMPTIONS = {
    "removal": "one link is removed at a time", "demand": "demand stays as it is", "routes": "the fastest path is taken",
    "scaling": "each measure is scaled to 0..1 over all links; equal values give 0",
}


def workbook(rows, scores, inputs: dict) -> dict:
    """The tables of a report by the name of their sheet: scores and measures by link (those columns that are there),
    inputs, weights, formulas and assumptions as texts and numbers."""
    spark = rows.sparkSession
    measures = {m: w for own in R.WITHIN.values() for m, w in own.items()}
    have = lambda df, names: df.select("link", *(c for c in names if c in df.columns))
    return {
        "scores": have(scores, [*R.DIMENSIONS, "score"]),
        "components": have(rows, measures),
        "inputs": spark.createDataFrame([(k, float(v)) for k, v in inputs.items()], "item string, value double"),
        "weights": spark.createDataFrame([(k, float(w)) for k, w in {**R.DIMENSIONS, **measures}.items()], "item string, value double"),
        "formulas": spark.createDataFrame([(k, m, FORMULAS[m]) for k, own in R.WITHIN.items() for m in own], "dimension string, term string, formula string"),
        "assumptions": spark.createDataFrame(list(ASSUMPTIONS.items()), "item string, text string"),
    }


_MEASURES = [m for own in R.WITHIN.values() for m in own]
_SHEETS = ", mm AS (SELECT * FROM ph1 LEFT JOIN so USING (link) LEFT JOIN ec USING (link) LEFT JOIN ic USING (link))" + " UNION ALL ".join(
    [f" SELECT 'scores' AS sheet, link AS item, '{c}' AS name, round({c}, 4) AS value FROM total" for c in [*R.DIMENSIONS, "score"]]
    + [f"SELECT 'components', link, '{m}', round(coalesce({m}, 0), 4) FROM mm" for m in _MEASURES]
    + [f"SELECT 'weights', '{k}', 'value', {w}::DOUBLE" for k, w in [*R.DIMENSIONS.items(), *((m, w) for own in R.WITHIN.values() for m, w in own.items())]]
    + [f"SELECT 'inputs', '{k}', 'value', {v}::DOUBLE" for k, v in (("penalty_h", R.PENALTY_H), ("penalty_times", R.PENALTY_TIMES), ("full_credit", R.FULL_CREDIT))]
)


@query("K7_workbook", R.COMPOSITE + _SHEETS)
def k7(spark, d):
    """The sheets of the report written as CSV, one folder each, and their numbers read back in long form."""
    rows = cut(R.measures(spark, d))
    sheets = workbook(rows, R.composite(rows), {"penalty_h": R.PENALTY_H, "penalty_times": R.PENALTY_TIMES, "full_credit": R.FULL_CREDIT})
    out = None
    for name, df in sheets.items():
        path = _written(spark, lambda p, df=df: df.write.option("header", True).csv(p))
        if name in ("formulas", "assumptions"):
            continue
        back = spark.read.schema(df.schema).option("header", True).csv(path)
        key, *numbers = back.columns
        long = back.unpivot(key, numbers, "name", "value").select(F.lit(name).alias("sheet"), F.col(key).alias("item"), "name", F.round("value", 4).alias("value"))
        out = long if out is None else out.unionByName(long)
    return out
