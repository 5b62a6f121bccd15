"""One network from layers: lines noded where they share vertices, the longest of parallel pieces, and places of another layer
tied to their nearest node. Nodes, edges and ties are tables made by joins and aggregates on keys; no node list is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import exprs as E
from roadloom.sources.stored import cut

from .nearest import nearest_km
from .prefix import numbered

ROAD, ACCESS = "road", "airport_access"  # fixed values: types of edges
LEAST_KM = 1e-9


def _key(p: Column, digits: int) -> Column:
    # adding zero makes one of both zeros
    return F.struct((F.bround(p["x"], digits) + 0.0).alias("x"), (F.bround(p["y"], digits) + 0.0).alias("y"))


def pieces(lines: DataFrame, digits: int) -> DataFrame:
    """id, segment (from 0), a, b (its end points), km: lines (id, pts, km) split at every vertex that another line has too.

    Vertices are equal if they round to the same place. A piece has its share of the line's official km by its own length; pieces of no
    length go. Lines without two points, km or id take no part."""
    n = F.size("pts")
    own = lines.where("id is not null and km is not null and size(pts) > 1").select("id", "pts", F.col("km").cast("double").alias("km"))
    steps = F.zip_with(F.slice("pts", 1, n - 1), F.slice("pts", 2, n - 1), lambda a, b: E.distance_km(a["x"], a["y"], b["x"], b["y"]))
    points = own.select("id", "km", n.alias("n"), F.posexplode(F.arrays_zip("pts", F.concat(F.array(F.lit(0.0)), steps).alias("step"))).alias("i", "v"))
    points = points.select("id", "km", "n", "i", F.col("v.pts").alias("p"), F.col("v.step").alias("step")).withColumn("key", _key(F.col("p"), digits))
    points = cut(points)
    shared = points.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key", F.lit(True).alias("shared"))
    along = Window.partitionBy("id").orderBy("i")
    marked = points.join(shared, "key", "left").withColumns({"way": F.sum("step").over(along), "whole": F.sum("step").over(Window.partitionBy("id"))})
    stops = marked.where((F.col("i") == 0) | (F.col("i") == F.col("n") - 1) | F.col("shared"))
    ahead = lambda c: F.lead(c).over(along)
    parts = stops.select(
        "id", (F.row_number().over(along) - 1).alias("segment"), F.col("p").alias("a"), ahead("p").alias("b"),
        ((ahead("way") - F.col("way")) / F.greatest("whole", F.lit(LEAST_KM)) * F.col("km")).alias("km"),
    )
    return parts.where("b is not null and km > 0")


def network(lines: DataFrame, digits: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, y, name) and road edges (u, v, km, id, segment), u < v.

    Nodes are places to some digits, numbered from 0 in the order in which lines reach them, and lie where the first one does; their names J001,
    J002, ... go from west to east. Pieces that come back to their node are no edges; of those between the same nodes the
    longest stays, the first of equal ones."""
    parts = cut(pieces(lines, digits))
    ends = parts.select(F.explode(F.array(*(F.struct(F.struct("id", "segment", F.lit(k).alias("end")).alias("at"), F.col(c).alias("p")) for k, c in enumerate(("a", "b"))))).alias("e"))
    first = ends.select("e.at", "e.p").withColumn("key", _key(F.col("p"), digits)).groupBy("key").agg(F.min(F.struct("at", "p")).alias("m"))
    placed = cut(numbered(first.select("key", "m.at", F.col("m.p.x").alias("x"), F.col("m.p.y").alias("y")), ["at"], place="node"))
    named = numbered(placed.select("node", "x", "y"), ["x", "y", "node"], place="n")
    nodes = named.select("node", "x", "y", F.concat(F.lit("J"), _three(F.col("n") + 1)).alias("name"))
    at = lambda name: placed.select(F.col("key").alias(f"key_{name}"), F.col("node").alias(name))
    met = parts.withColumns({f"key_{c}": _key(F.col(c), digits) for c in ("a", "b")}).drop("a", "b").join(at("a"), "key_a").join(at("b"), "key_b").where("a <> b")
    u, v = F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")
    longest = met.groupBy(u, v).agg(F.max("km").alias("most"))
    kept = met.select(u, v, "km", "id", "segment").join(longest, ["u", "v"]).where("km = most").groupBy("u", "v").agg(F.min(F.struct("id", "segment", "km")).alias("m"))
    return nodes, kept.select("u", "v", "m.km", "m.id", "m.segment")


def _three(n: Column) -> Column:
    """At least three digits."""
    text = n.cast("string")
    return F.when(n < 1000, F.lpad(text, 3, "0")).otherwise(text)


def tied(places: DataFrame, nodes: DataFrame, prefix: str = "AP") -> DataFrame:
    """The columns of places (id, x, y, ...) with name, node, km: each with its nearest node, ties to the smaller one. Names number the
    places from west to east; those without coordinates take no part."""
    own = places.where("x is not null and y is not null")
    own = cut(numbered(own, ["x", "y", "id"], place="_n").withColumn("name", F.concat(F.lit(prefix), _three(F.col("_n") + 1))).drop("_n"))
    return nearest_km(own, nodes.select(F.col("node").alias("site"), "x", "y")).withColumnRenamed("site", "node")


def multimodal(lines: DataFrame, places: DataFrame, digits: int = 5) -> DataFrame:
    """kind, u, v, km, id, segment: roads and the ties of places in one table of edges; nodes are text, numbers of roads and names of
    places. Air routes, which join every pair of places, aren't written out: their length follows from both ends."""
    nodes, roads = network(lines, digits)
    nodes = cut(nodes)
    text = lambda c: F.col(c).cast("string").alias(c)
    roads = roads.select(F.lit(ROAD).alias("kind"), text("u"), text("v"), "km", F.col("id").cast("string").alias("id"), "segment")
    ties = tied(places, nodes).select(F.lit(ACCESS).alias("kind"), F.col("node").cast("string").alias("u"), F.col("name").alias("v"), "km", F.col("id").cast("string").alias("id"), F.lit(0).alias("segment"))
    return roads.unionByName(ties)
