"""Calibration: targets grouped by alike incidence, the chain of scales and deviations, the fit table, the optimality of an estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions import exprs as E
from roadloom.operators import demand as D
from roadloom.operators import graph as G
from roadloom.operators.rank import rank
from roadloom.plans import routing as R
from roadloom.sources import network as N
from roadloom.sources.stored import cut, table

QUERIES, SQL = {}, {}

#: Floors and powers of the deviations of counts.
COUNT_CV, COUNT_FLOOR, DILUTION, LEAST_FLOW = 0.20, 1000.0, 0.5, 1e-6


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


r6 = lambda c: F.round(c, 6)

INCIDENCE = R.ON_PATH + """, inc AS (SELECT code, least(o, d) AS a, greatest(o, d) AS b, CAST(count(*) AS DOUBLE) AS p FROM onp GROUP BY 1, 2, 3), sup AS (SELECT code, count(*) AS n, sqrt(sum(p * p)) AS norm FROM inc GROUP BY code),
 sim AS (SELECT i.code AS x, j.code AS y, count(*) AS shr, sum(i.p * j.p) AS dot FROM inc i JOIN inc j USING (a, b) WHERE i.code < j.code GROUP BY 1, 2),
 ali AS (SELECT x, y, shr / CAST(s.n + t.n - shr AS DOUBLE) AS jaccard, dot / (s.norm * t.norm) AS cosine FROM sim JOIN sup s ON s.code = x JOIN sup t ON t.code = y)"""


def alike(incidence: DataFrame) -> DataFrame:
    """x, y, jaccard, cosine of targets (code) that share a pair: an equi-join on the pairs, never all targets with all."""
    sup = incidence.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("norm"))
    side = lambda k: incidence.select(F.col("code").alias(k), "a", "b", F.col("p").alias(f"p_{k}"))
    sim = side("x").join(side("y"), ["a", "b"]).where("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("both"), F.sum(F.col("p_x") * F.col("p_y")).alias("dot"))
    own = lambda k: sup.select(F.col("code").alias(k), F.col("n").alias(f"n_{k}"), F.col("norm").alias(f"norm_{k}"))
    sim = sim.join(own("x"), "x").join(own("y"), "y")
    return sim.select("x", "y", (F.col("both") / (F.col("n_x") + F.col("n_y") - F.col("both"))).alias("jaccard"), (F.col("dot") / (F.col("norm_x") * F.col("norm_y"))).alias("cosine"))


@query("J15_alike_targets", INCIDENCE + " SELECT x, y, round(jaccard, 6) AS jaccard, round(cosine, 6) AS cosine FROM ali")
def j15(spark, d):
    return alike(cut(R.gr10_incidence(spark, d))).select("x", "y", r6("jaccard").alias("jaccard"), r6("cosine").alias("cosine"))


GROUPED = INCIDENCE.replace("WITH ", "WITH RECURSIVE ", 1) + """, lnk AS (SELECT x, y FROM ali WHERE jaccard >= 0.3 AND cosine >= 0.3 UNION SELECT y, x FROM ali WHERE jaccard >= 0.3 AND cosine >= 0.3),
 walk AS (SELECT code AS x, code AS y FROM sup UNION SELECT w.x, l.y FROM walk w JOIN lnk l ON w.y = l.x), root AS (SELECT x AS code, min(y) AS root FROM walk GROUP BY x)"""


@query("A4_corridor_groups", GROUPED + " SELECT root, count(*) AS targets, median(n) AS observed, max(n) AS most, min(n) AS least, bool_or(n % 2 = 0) AS any_even, string_agg(code, '|' ORDER BY code) AS codes FROM root JOIN counts USING (code) GROUP BY root")
def a4(spark, d):
    """Targets of alike incidence, and of those alike to these, as one: median of the counts, extremes, flags, codes."""
    inc = cut(R.gr10_incidence(spark, d))
    close = cut(alike(inc).where("jaccard >= 0.3 and cosine >= 0.3").select(F.col("x").alias("u"), F.col("y").alias("v")))
    root = G.components(close.unionByName(close.select(F.col("v").alias("u"), F.col("u").alias("v"))), inc.select(F.col("code").alias("node")).distinct())
    rows = root.select(F.col("node").alias("code"), F.col("label").alias("root")).join(N.counts(spark, d), "code")
    return rows.groupBy("root").agg(
        F.count(F.lit(1)).alias("targets"), F.median("n").alias("observed"), F.max("n").alias("most"), F.min("n").alias("least"),
        F.bool_or(F.col("n") % 2 == 0).alias("any_even"), F.array_join(F.sort_array(F.collect_set("code")), "|").alias("codes"),
    )


@query("A4_group_incidence", GROUPED + " SELECT root, a, b, max(p) AS p FROM root JOIN inc USING (code) GROUP BY root, a, b")
def a4b(spark, d):
    """A group's share of a pair is the largest of its targets'."""
    inc = cut(R.gr10_incidence(spark, d))
    close = cut(alike(inc).where("jaccard >= 0.3 and cosine >= 0.3").select(F.col("x").alias("u"), F.col("y").alias("v")))
    root = G.components(close.unionByName(close.select(F.col("v").alias("u"), F.col("u").alias("v"))), inc.select(F.col("code").alias("node")).distinct())
    return root.select(F.col("node").alias("code"), F.col("label").alias("root")).join(inc, "code").groupBy("root", "a", "b").agg(F.max("p").alias("p"))


# the chain: seed scale, deviations, scale, deviations, scale, deviations

CHAIN = INCIDENCE + """, seed AS (SELECT o AS a, d AS b, q AS x FROM demand WHERE o < d), tgt0 AS (SELECT code, sum(p * x) AS m, count(*) AS pairs FROM inc JOIN seed USING (a, b) GROUP BY code), tgt AS (SELECT code, m, pairs, CAST(n AS DOUBLE) AS y FROM tgt0 JOIN counts USING (code) WHERE n > 0)"""


def _scale_sql(k: int, sigma: str) -> str:
    return f", s{k} AS (SELECT sum(m * y / pow({sigma}, 2)) / sum(m * m / pow({sigma}, 2)) AS scale FROM {'tgt' if k == 0 else f'v{k}'})"


def _sigma_sql(k: int, before: int) -> str:
    ratio = f"greatest(y, {LEAST_FLOW}::DOUBLE) / greatest(m * (SELECT scale FROM s{before}), {LEAST_FLOW}::DOUBLE)"
    base = f"greatest(sqrt(greatest(y, 1)), {COUNT_CV}::DOUBLE * greatest(y, {COUNT_FLOOR}::DOUBLE))"
    return f", v{k} AS (SELECT *, sqrt({base} * {base} * greatest(1, pow(pairs / greatest((SELECT avg(pairs) FROM tgt), 1), {DILUTION}::DOUBLE)) * greatest(1, abs(ln({ratio})))) AS sigma FROM tgt)"


CHAIN += _scale_sql(0, f"greatest(sqrt(y), {COUNT_CV}::DOUBLE * y)") + _sigma_sql(1, 0) + _scale_sql(1, "sigma") + _sigma_sql(2, 1) + _scale_sql(2, "sigma") + _sigma_sql(3, 2)


def _targets(spark, d) -> DataFrame:
    """code, m (the seed's flow), pairs, y (the count)."""
    seed = N.demand(spark, d).where("o < d").select(F.col("o").alias("a"), F.col("d").alias("b"), F.col("q").alias("x"))
    flows = R.gr10_incidence(spark, d).join(seed, ["a", "b"]).groupBy("code").agg(F.sum(F.col("p") * F.col("x")).alias("m"), F.count(F.lit(1)).alias("pairs"))
    return flows.join(N.counts(spark, d).where("n > 0").select("code", F.col("n").cast("double").alias("y")), "code")


def scale_of(rows: DataFrame, sigma) -> float:
    """The factor that fits m to y by weighted least squares; one that is not positive is an error."""
    found = rows.agg((F.sum(F.col("m") * F.col("y") / F.pow(sigma, F.lit(2))) / F.sum(F.col("m") * F.col("m") / F.pow(sigma, F.lit(2)))).alias("s")).head().s
    if found is None or not found > 0:
        raise ValueError(f"no positive scale: {found}")
    return found


def deviation(scale: float, mean_pairs: float):
    """The standard deviation of a count: its floors, wider where many pairs share it and where the model is far off."""
    y = F.col("y")
    base = F.greatest(F.sqrt(F.greatest(y, F.lit(1.0))), COUNT_CV * F.greatest(y, F.lit(COUNT_FLOOR)))
    dilution = F.greatest(F.lit(1.0), F.pow(F.col("pairs") / max(mean_pairs, 1.0), F.lit(DILUTION)))
    ratio = F.greatest(y, F.lit(LEAST_FLOW)) / F.greatest(F.col("m") * scale, F.lit(LEAST_FLOW))
    return F.sqrt(base * base * dilution * F.greatest(F.lit(1.0), F.abs(F.ln(ratio))))


def refined(targets: DataFrame) -> tuple[DataFrame, float]:
    """The targets with sigma after three rounds, and the scale of the prior. Between rounds only one number goes to the driver."""
    targets = cut(targets)
    mean = targets.agg(F.avg("pairs")).head()[0] or 1.0
    scale = scale_of(targets, F.greatest(F.sqrt("y"), COUNT_CV * F.col("y")))
    for _ in range(2):
        scale = scale_of(targets.withColumn("sigma", deviation(scale, mean)), F.col("sigma"))
    return targets.withColumn("sigma", deviation(scale, mean)), scale


@query("M10_refined_deviations", CHAIN + " SELECT code, round((SELECT scale FROM s2), 6) AS scale, round(m * (SELECT scale FROM s2), 4) AS prior, round(sigma, 4) AS sigma FROM v3")
def m10(spark, d):
    rows, scale = refined(_targets(spark, d))
    return rows.select("code", r6(F.lit(scale)).alias("scale"), F.round(F.col("m") * scale, 4).alias("prior"), F.round("sigma", 4).alias("sigma"))


@query("M12_fit_table", CHAIN + """, fin AS (SELECT c.code, c.n AS y, v3.m * (SELECT scale FROM s2) AS f, v3.sigma, v3.pairs FROM counts c LEFT JOIN v3 USING (code) WHERE c.n > 0)
SELECT code, coalesce(pairs, 0) AS pairs, CASE WHEN pairs IS NULL THEN 'no path' WHEN (f <= 1 OR f / y <= 0.01::DOUBLE) AND y >= 1000 THEN 'down-weighted' ELSE 'target' END AS status, round(coalesce(f, 0) - y, 4) AS error, round((coalesce(f, 0) - y) / y, 6) AS share, round(sqrt(2 * pow(coalesce(f, 0) - y, 2) / (coalesce(f, 0) + y)), 6) AS geh, round((f - y) / sigma, 6) AS residual FROM fin""")
def m12(spark, d):
    """Every counted link: whether a path supports it, its status, errors, GEH and standardised residual."""
    rows, scale = refined(_targets(spark, d))
    fit = N.counts(spark, d).where("n > 0").select("code", F.col("n").cast("double").alias("y")).join(rows.select("code", (F.col("m") * scale).alias("f"), "sigma", "pairs"), "code", "left")
    f, y = F.coalesce("f", F.lit(0.0)), F.col("y")
    status = F.when(F.col("pairs").isNull(), "no path").when(((F.col("f") <= 1) | (F.col("f") / y <= 0.01)) & (y >= 1000), "down-weighted").otherwise("target")
    return fit.select("code", F.coalesce("pairs", F.lit(0)).alias("pairs"), status.alias("status"), F.round(f - y, 4).alias("error"), r6((f - y) / y).alias("share"), r6(E.geh(f, y)).alias("geh"), r6((F.col("f") - y) / F.col("sigma")).alias("residual"))


@query("M12_incidence_rank")
def m12_rank(spark, d):
    """How many of the counted links tell something that the others don't: rows, columns and rank of the incidence."""
    inc = cut(R.gr10_incidence(spark, d).select("code", F.concat_ws("-", "a", "b").alias("pair"), F.col("p").cast("long").alias("value")))
    found = rank(inc.select(F.col("code").alias("row"), F.col("pair").alias("col"), "value"))
    return inc.agg(F.count_distinct("code").alias("targets"), F.count_distinct("pair").alias("pairs")).withColumn("rank", F.lit(found).cast("long"))


@query("A3_fit_errors", CHAIN + " SELECT count(*) AS n, round(sqrt(avg(pow(m * (SELECT scale FROM s2) - y, 2))), 4) AS rmse, round(avg(abs(m * (SELECT scale FROM s2) - y)), 4) AS mae, count(*) FILTER (abs(m * (SELECT scale FROM s2) - y) <= 0.5::DOUBLE * y) AS within_50 FROM tgt")
def a3(spark, d):
    rows, scale = refined(_targets(spark, d))
    miss = F.abs(F.col("m") * scale - F.col("y"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(miss * miss)), 4).alias("rmse"), F.round(F.avg(miss), 4).alias("mae"), F.count_if(miss <= 0.5 * F.col("y")).alias("within_50"))


def estimated(spark, d) -> D.Fit:
    """Demand of pairs from counts: the scaled seed as prior, counts of the links on their paths, deviations after three rounds."""
    targets, scale = refined(_targets(spark, d))
    pair = F.concat_ws("-", "a", "b").alias("pair")
    prior = N.demand(spark, d).where("o < d and q > 0").select(F.col("o").alias("a"), F.col("d").alias("b"), (F.col("q") * scale).alias("q")).select(pair, "q")
    inc = R.gr10_incidence(spark, d).select(pair, F.col("code").alias("target"), "p")
    return D.entropy_least_squares(prior, inc, targets.select(F.col("code").alias("target"), "y", "sigma"))


@query("M11_estimate")
def m11(spark, d):
    """Pairs with prior and estimate, and how near the fit is to its optimum: objective, projected gradient, whether it converged."""
    fit = estimated(spark, d)
    rows = fit.rows.select("pair", F.round("prior", 4).alias("prior"), F.round("estimate", 4).alias("estimate"))
    return rows.withColumns({"objective": F.lit(round(fit.objective, 3)), "gradient": F.lit(fit.gradient), "iterations": F.lit(fit.iterations), "converged": F.lit(fit.converged)})


@query("M6_pair_vector", N.with_sql("od") + " SELECT least(o, d) AS a, greatest(o, d) AS b, sum(q) / 2 AS x FROM od WHERE o <> d GROUP BY 1, 2")
def m6(spark, d):
    """A matrix as one number for each unordered pair: half the sum of both directions."""
    return N.od(spark, d).where("o <> d").groupBy(F.least("o", "d").alias("a"), F.greatest("o", "d").alias("b")).agg((F.sum("q") / 2).alias("x"))


GIVEN_SQL = """, given AS (SELECT CAST(c_nationkey AS BIGINT) AS o, CAST(s_nationkey AS BIGINT) AS d, avg(l_discount) AS c, o_orderstatus AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 4)"""


@query("M14_impedance_choice", N.with_sql("nodes") + ", " + N.skim_sql() + GIVEN_SQL + " SELECT 'there' AS matrix, o, d, round(c, 6) AS c, 'given' AS source FROM given WHERE kind = 'F' UNION ALL SELECT 'empty', o, d, round(c, 6), 'skim' FROM skim WHERE o < 25 AND d < 25")
def m14(spark, d):
    """The first impedance source that has cells: a given matrix, else the skim of the network. Once with a matrix of the finished orders,
    once with one of orders of a status that none has."""
    e = R.N.edges(spark, d)
    skim = G.shortest(e, e.select(F.col("u").alias("o"), F.col("u").alias("node"), F.lit(0.0).alias("c")).distinct()).select("o", F.col("node").alias("d"), r6("c").alias("c")).where("o < 25 and d < 25")
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    ends = [F.col("c_nationkey").cast("long").alias("o"), F.col("s_nationkey").cast("long").alias("d")]
    given = cut(lines.groupBy(*ends, F.col("o_orderstatus").alias("kind")).agg(r6(F.avg("l_discount")).alias("c")))
    out = None
    for matrix, kind in (("there", "F"), ("empty", "none")):
        sources = [("given", given.where(F.col("kind") == kind).drop("kind")), ("skim", skim)]
        name, cells = next((n, df) for n, df in sources if not df.isEmpty())
        rows = cells.select(F.lit(matrix).alias("matrix"), "o", "d", "c", F.lit(name).alias("source"))
        out = rows if out is None else out.unionByName(rows)
    return out


def without_or_with(spark, d, counted) -> DataFrame:
    """o, d, q: the seed as it is where no link is counted, else scaled to the counts."""
    targets = cut(_targets(spark, d).where(counted))
    scale = 1.0 if targets.isEmpty() else refined(targets)[1]
    return N.demand(spark, d).where("q > 0").select("o", "d", (F.col("q") * scale).alias("q"))


@query("M13_degenerate", CHAIN + " SELECT 'none' AS counts, o, d, round(q, 4) AS q FROM demand WHERE q > 0 UNION ALL SELECT 'all', o, d, round(q * (SELECT scale FROM s2), 4) FROM demand WHERE q > 0")
def m13(spark, d):
    """Without counts the seed is the estimate: once without any count above a number that none reaches, once with all."""
    none, every = without_or_with(spark, d, "y > 1e15"), without_or_with(spark, d, "y > 0")
    q = F.round("q", 4).alias("q")
    return none.select(F.lit("none").alias("counts"), "o", "d", q).unionByName(every.select(F.lit("all").alias("counts"), "o", "d", q))
