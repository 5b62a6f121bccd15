"""A road network, its zones, demand and counts, derived from the trade tables; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import table

SPEED_SHARE = 0.4  # of the design speed

SQL = {
    "zones": """zones AS (
  SELECT CAST(n_nationkey AS BIGINT) AS zone, n_name AS name, CAST(n_regionkey AS BIGINT) AS region,
         80 + 1.7::DOUBLE * (n_nationkey % 5) AS lon, 26.3::DOUBLE + 0.9::DOUBLE * (n_nationkey // 5) AS lat,
         coalesce(population, 0) AS population, coalesce(activity, 0) AS activity
  FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS population, sum(greatest(c_acctbal, 0) + 1) AS activity
                         FROM customer GROUP BY 1) ON c_nationkey = n_nationkey)""",
    "roads": """roads AS (
  SELECT CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, CAST(len AS DOUBLE) AS len, CAST(design AS DOUBLE) AS design,
         printf('NH%02d-%03d', CAST(u AS INT), CAST(v AS INT)) AS code, len / (0.4::DOUBLE * design) AS t
  FROM (SELECT n_nationkey AS u, (n_nationkey + 1) % 25 AS v, 10 + (37 * n_nationkey) % 50 AS len, 20 * (1 + n_nationkey % 4) AS design FROM nation
        UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25, 25 + (53 * n_nationkey) % 70, 60 FROM nation WHERE n_nationkey % 3 = 0
        UNION ALL SELECT * FROM (VALUES (3, 25, 12, 40), (25, 26, 9, 20), (27, 28, 15, 40)) x(a, b, c, d)))""",
    "edges": "edges AS (SELECT u, v, len, t, code FROM roads UNION ALL SELECT v, u, len, t, code FROM roads)",
    "nodes": "nodes AS (SELECT DISTINCT u AS node FROM edges)",
    "od": """od AS (
  SELECT CAST(c_nationkey AS BIGINT) AS o, CAST(s_nationkey AS BIGINT) AS d, sum(l_quantity) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)""",
    "demand": """demand AS (
  SELECT o, d, (q + coalesce(r, 0)) / 2 AS q FROM (
    SELECT o, d, max(q) AS q, max(r) AS r FROM (
      SELECT o, d, q, NULL AS r FROM od UNION ALL SELECT d, o, 0, q FROM od) GROUP BY o, d) WHERE o <> d)""",
    "counts": """counts AS (
  SELECT code, count(l_orderkey) AS n, avg(l_extendedprice) AS v FROM roads LEFT JOIN lineitem ON l_suppkey % 25 = u GROUP BY code)""",
}
NEEDS = {"edges": ["roads"], "nodes": ["edges"], "demand": ["od"], "counts": ["roads"]}


def with_sql(*names: str) -> str:
    """A WITH clause that defines the named tables and those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(SQL[n] for n in order)


def skim_sql(rounds: int = 5, weight: str = "t", table: str = "edges") -> str:
    """Least weights between all nodes by min-plus squaring; the last table is `skim` (o, d, c)."""
    out = [f"d0 AS (SELECT u AS o, v AS d, min({weight}) AS c FROM {table} GROUP BY 1, 2 UNION ALL SELECT node, node, 0 FROM nodes)"]
    for k in range(1, rounds + 1):
        name = "skim" if k == rounds else f"d{k}"
        out.append(f"{name} AS (SELECT a.o, b.d, min(a.c + b.c) AS c FROM d{k - 1} a JOIN d{k - 1} b ON a.d = b.o GROUP BY 1, 2)")
    return ", ".join(out)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("population"), F.sum(F.greatest("c_acctbal", F.lit(0.0)) + 1).alias("activity")
    )
    return table(spark, sf_dir, "nation").join(people, "n_nationkey", "left").select(
        k.cast("long").alias("zone"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").cast("long").alias("region"),
        (80 + 1.7 * (k % 5)).alias("lon"),
        (26.3 + 0.9 * F.floor(k / 5)).alias("lat"),
        F.coalesce("population", F.lit(0)).alias("population"),
        F.coalesce("activity", F.lit(0.0)).alias("activity"),
    )


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per road: u, v, len, design, code, t."""
    k = F.col("n_nationkey").cast("long")
    nation = table(spark, sf_dir, "nation")
    ring = nation.select(k.alias("u"), ((k + 1) % 25).alias("v"), (10 + (37 * k) % 50).alias("len"), (20 * (1 + k % 4)).alias("design"))
    chords = nation.where(k % 3 == 0).select(k.alias("u"), ((k + 7) % 25).alias("v"), (25 + (53 * k) % 70).alias("len"), F.lit(60).alias("design"))
    ends = spark.createDataFrame([(3, 25, 12, 40), (25, 26, 9, 20), (27, 28, 15, 40)], "u long, v long, len long, design long")
    every = ring.unionByName(chords).unionByName(ends)
    return every.select(
        "u", "v", F.col("len").cast("double").alias("len"), F.col("design").cast("double").alias("design"),
        F.format_string("NH%02d-%03d", "u", "v").alias("code"), (F.col("len") / (SPEED_SHARE * F.col("design"))).alias("t"),
    )


def both_ways(roads_: DataFrame) -> DataFrame:
    """Every road as two directed edges, in one scan."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b"))))
    other = [c for c in roads_.columns if c not in ("u", "v")]
    return roads_.select(ends.alias("e"), *other).select(F.col("e.a").alias("u"), F.col("e.b").alias("v"), *other)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_ways(roads(spark, sf_dir))


def od(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by nation of customer and of supplier; aggregated by key before the dimension joins."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sums = lines.groupBy("o_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return (
        sums.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("c_nationkey").cast("long").alias("o"), F.col("s_nationkey").cast("long").alias("d"))
        .agg(F.sum("q").alias("q"))
    )


def symmetrised(matrix: DataFrame) -> DataFrame:
    """Half the sum of a matrix (o, d, q) and its transpose, without the diagonal: one aggregation, no join."""
    cells = F.explode(F.array(F.struct("o", "d", "q"), F.struct(F.col("d").alias("o"), F.col("o").alias("d"), F.col("q"))))
    return matrix.where("o <> d").select(cells.alias("x")).groupBy("x.o", "x.d").agg((F.sum("x.q") / 2).alias("q"))


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symmetrised(od(spark, sf_dir))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n (lines) and v (their mean price) by road code."""
    lines = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 25).alias("u")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("v")
    )
    return roads(spark, sf_dir).drop("v").join(lines, "u", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"), "v")
