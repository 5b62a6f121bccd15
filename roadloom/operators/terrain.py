"""Elevation and terrain of lines from the contours around them.

Lines meet contours by an equi-join on grid cells: a segment has the cells that its strip of `reach` covers, column by column, so their
number grows with its length and not with its box. Lines of one geometry are searched once, contours of one geometry are one row with
the sum of their levels, so copies never multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions import exprs as E
from roadloom.sources.stored import cut

from .nearest import nearest

# Codes of the source and the classes they mean, and what a terrain is said to come from.
SOURCE_CODES = {"P": "Plain", "R": "Rolling", "M": "Mountainous", "S": "Steep"}
FROM_SOURCE, FROM_CONTOURS = "source_NH_layer", "contour_default"


def _pairs(pts: str) -> Column:
    n = F.size(pts) - 1
    return F.zip_with(F.slice(pts, 1, n), F.slice(pts, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _segments(lines: DataFrame, name: str, ends: tuple[str, str, str, str], size: float, reach: float) -> DataFrame:
    """name, the ends of every segment and a cell that it has, a row each."""
    rows = lines.select(name, F.explode(_pairs("pts")).alias("s"))
    rows = rows.select(name, *(F.col(f"s.{at}").alias(e) for at, e in zip(("a.x", "a.y", "b.x", "b.y"), ends, strict=True)))
    return rows.withColumn("cell", F.explode(cells(ends, size, reach)))


def cells(ends: tuple[str, str, str, str], size: float, reach: float) -> Column:
    """The cells (i, j) that hold every point within `reach` of a segment."""
    ax, ay, bx, by = (F.col(e) for e in ends)
    left, right = F.least(ax, bx), F.greatest(ax, bx)
    low, high = F.when(ax <= bx, ay).otherwise(by), F.when(ax <= bx, by).otherwise(ay)

    def rows(i: Column) -> Column:
        # the part of the segment that lies near the column; one of no width counts as a whole
        share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - left) / (right - left)))
        y = lambda x: F.when(right > left, low + share(x) * (high - low))
        first, last = F.coalesce(y(i * size - reach), low), F.coalesce(y((i + 1) * size + reach), high)
        js = F.sequence(F.floor((F.least(first, last) - reach) / size), F.floor((F.greatest(first, last) + reach) / size))
        return F.transform(js, lambda j: F.struct(i.alias("i"), j.alias("j")))

    columns = F.sequence(F.floor((left - reach) / size), F.floor((right + reach) / size))
    return F.flatten(F.transform(columns, rows))


def segments_distance(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> Column:
    """Between two segments in the plane: 0 where they cross, else from an end of one to the other."""
    p, q = [F.col(c) for c in a], [F.col(c) for c in b]
    side = lambda s, x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
    across = lambda s, t: side(s, t[0], t[1]) * side(s, t[2], t[3]) < 0
    ends = [E.segment_distance(s[k], s[k + 1], *t) for s, t in ((p, q), (q, p)) for k in (0, 2)]
    return F.when(across(p, q) & across(q, p), F.lit(0.0)).otherwise(F.least(*ends))


def _size(s: Column) -> Column:
    return F.sqrt(F.pow(s["b"]["x"] - s["a"]["x"], 2) + F.pow(s["b"]["y"] - s["a"]["y"], 2))


def centre(pts: str) -> dict[str, Column]:
    """x, y: the middles of the segments weighted by their lengths, the first point of a line without length."""
    whole = F.aggregate(_pairs(pts), F.lit(0.0), lambda t, s: t + _size(s))
    part = lambda c: F.aggregate(_pairs(pts), F.lit(0.0), lambda t, s: t + _size(s) * (s["a"][c] + s["b"][c]) / 2)
    return {c: F.when(whole > 0, part(c) / whole).otherwise(F.element_at(pts, 1)[c]) for c in ("x", "y")}


def halfway(pts: str) -> dict[str, Column]:
    """x, y: the point at half the length of a line."""
    half = F.aggregate(_pairs(pts), F.lit(0.0), lambda t, s: t + _size(s)) / 2
    start = F.struct(F.lit(0.0).alias("way"), F.element_at(pts, 1)["x"].cast("double").alias("x"), F.element_at(pts, 1)["y"].cast("double").alias("y"))

    def on(t: Column, s: Column) -> Column:
        share = F.when(_size(s) > 0, F.least(F.lit(1.0), (half - t["way"]) / _size(s))).otherwise(0.0)
        at = lambda c: F.when(t["way"] < half, s["a"][c] + share * (s["b"][c] - s["a"][c])).otherwise(t[c])
        return F.struct((t["way"] + _size(s)).alias("way"), at("x").alias("x"), at("y").alias("y"))

    found = F.aggregate(_pairs(pts), start, on)
    return {c: found[c] for c in ("x", "y")}


def around(lines: DataFrame, contours: DataFrame, reach: float, size: float | None = None) -> DataFrame:
    """pts, level: the mean level of the contours within `reach` of each geometry of lines; geometries without any are missing.

    contours: pts, level. Null levels don't count."""
    size = size or 2 * reach
    shapes = cut(lines.select("pts").distinct().withColumn("line", F.monotonically_increasing_id()))
    own = contours.where("level is not null and not isnan(level)").groupBy("pts").agg(F.sum("level").alias("sum"), F.count(F.lit(1)).alias("n"))
    own = cut(own.withColumn("contour", F.monotonically_increasing_id()))
    a, b = ("ax", "ay", "bx", "by"), ("cx", "cy", "dx", "dy")
    met = _segments(shapes, "line", a, size, reach).join(_segments(own, "contour", b, size, 0.0), "cell").where(segments_distance(a, b) <= reach)
    pairs = met.select("line", "contour").distinct()
    means = pairs.join(own.select("contour", "sum", "n"), "contour").groupBy("line").agg((F.sum("sum") / F.sum("n")).alias("level"))
    return means.join(shapes, "line").select("pts", "level")


def classified(level: Column, breaks: dict[str, tuple[float, float]]) -> Column:
    """The first class whose range, its upper end excluded, holds the level; the last one for any other, NaN included."""
    out = F.lit(list(breaks)[-1])
    for name, (lo, hi) in reversed(breaks.items()):
        out = F.when(~F.isnan(level) & (level >= lo) & (level < hi), name).otherwise(out)
    return out


def assigned(edges: DataFrame, contours: DataFrame, reach: float, breaks: dict[str, tuple[float, float]], default: str) -> DataFrame:
    """The columns of edges (with pts, source_code) with elevation_m, terrain, terrain_source and how (source, direct, nearest, default).

    A code of the source decides alone and leaves the elevation null. Else it is the mean of the levels of contours (id, pts, level)
    within `reach`; without any, the level of the contour whose centre is nearest to the edge's halfway point (ties to the smaller
    id); a null level there gives a null elevation and the last class. Without contours, and for edges without two points, it
    is the default. Contours without two points take no part; repeated edges are answered each."""
    contours = cut(contours.where("size(pts) > 1").select("id", "pts", F.col("level").cast("double").alias("level")))
    code = F.upper(F.trim(F.coalesce("source_code", F.lit(""))))
    known = F.coalesce(*(F.when(code == k, v) for k, v in SOURCE_CODES.items()))
    shapes = cut(edges.where(known.isNull() & (F.size("pts") > 1)).select("pts").distinct())
    direct = cut(around(shapes, contours, reach))
    left = shapes.join(direct, "pts", "left_anti").select("pts", *(c.alias(n) for n, c in halfway("pts").items()))
    sites = contours.select(F.struct("id", "level").alias("site"), *(c.alias(n) for n, c in centre("pts").items()))
    near = nearest(left, sites).select("pts", F.coalesce("site.level", F.lit(float("nan"))).alias("level"), F.lit("nearest").alias("how"))
    found = direct.select("pts", "level", F.lit("direct").alias("how")).unionByName(near).withColumnRenamed("pts", "_shape")
    own = edges.withColumn("_known", known)
    met = own.join(found, own["_known"].isNull() & (own["pts"] == found["_shape"]), "left")
    how = F.when(F.col("_known").isNotNull(), "source").otherwise(F.coalesce("how", F.lit("default")))
    terrain = F.coalesce("_known", F.when(F.col("level").isNotNull(), classified(F.col("level"), breaks)), F.lit(default))
    return met.select(
        *(own[c] for c in edges.columns), F.nanvl("level", F.lit(None).cast("double")).alias("elevation_m"), terrain.alias("terrain"),
        F.when(F.col("_known").isNotNull(), FROM_SOURCE).otherwise(FROM_CONTOURS).alias("terrain_source"), how.alias("how"),
    )
