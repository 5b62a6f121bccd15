"""The k nearest sites (points or segments) of every point, exactly, by joins down a packed tree of boxes.

Sites are ordered along a curve that keeps near ones near, LEAF of them are a leaf, FAN consecutive nodes one node of the next
level, each with the box around its sites: however sites crowd together, no node is larger than another. All points go down level by
level. A point knows a distance within which k sites lie for sure (the far corners of the boxes it holds), and drops every box that is
farther than that. So a point meets few boxes a level, and no pair of a point and a far site is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import exprs as E
from roadloom.sources.stored import cut

from .prefix import numbered

LEAF, FAN = 16, 16
#: Digits to which distances are equal.
DIGITS = 9
BITS = 20
SHAPE = ["ax", "ay", "bx", "by"]


def _spread(c: Column) -> Column:
    """The bits of a number below 2**BITS, each followed by a zero."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def _curve(sites: DataFrame) -> Column:
    """A place on the curve for the middle of each site."""
    x, y = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    lo_x, hi_x, lo_y, hi_y = sites.agg(F.min(x), F.max(x), F.min(y), F.max(y)).head()
    cell = lambda c, lo, hi: F.floor((c - F.lit(lo)) / F.lit((hi - lo) or 1.0) * (2**BITS - 1)).cast("long")
    return F.lit(0).cast("long") if lo_x is None else _spread(cell(x, lo_x, hi_x)).bitwiseOR(F.shiftleft(_spread(cell(y, lo_y, hi_y)), 1))


def _gap(lo: str, hi: str, at: str, kids: Column) -> tuple[Column, Column]:
    """Along one axis: to the nearest point of a box, and to its farthest."""
    near = F.greatest(kids[lo] - F.col(at), F.col(at) - kids[hi], F.lit(0.0))
    return near, F.greatest(F.abs(kids[lo] - F.col(at)), F.abs(kids[hi] - F.col(at)))


def _norm(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def nearest(points: DataFrame, sites: DataFrame, k: int = 1) -> DataFrame:
    """The columns of points (with x, y) with site, distance and place (from 1): the k nearest sites, all if there are fewer.

    sites: site (any type that can be ordered) and either x, y or ax, ay, bx, by, a segment. Distances are in the plane and rounded to DIGITS;
    ties go to the smaller site. Rows with a null coordinate or site take no part."""
    if "x" in sites.columns:
        sites = sites.select("site", *(F.col(c[1]).alias(c) for c in SHAPE))
    sites = sites.select("site", *(F.col(c).cast("double").alias(c) for c in SHAPE)).dropna()
    # of sites in one place only the first k can be among the nearest
    if k == 1:
        sites = sites.groupBy(*SHAPE).agg(F.min("site").alias("site"))
    else:
        sites = sites.withColumn("copy", F.row_number().over(Window.partitionBy(*SHAPE).orderBy("site"))).where(F.col("copy") <= k).drop("copy")
    sites = cut(sites)
    sites = numbered(sites.withColumn("curve", _curve(sites)), ["curve", *SHAPE, "site"])
    sites = cut(sites.select(F.floor(F.col("place") / LEAF).alias("leaf"), "site", *SHAPE))

    low, high = (lambda a, b: F.min(F.least(a, b))), (lambda a, b: F.max(F.greatest(a, b)))
    levels = [sites.groupBy(F.col("leaf").alias("node")).agg(low("ax", "bx").alias("x1"), low("ay", "by").alias("y1"), high("ax", "bx").alias("x2"), high("ay", "by").alias("y2"), F.count(F.lit(1)).alias("n"))]
    levels[0] = cut(levels[0])
    size = levels[0].count()
    while size > FAN:
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("node"))
        levels.append(cut(up.agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.sum("n").alias("n"))))
        size = -(-size // FAN)

    held = points.where("x is not null and y is not null").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    own = Window.partitionBy("x", "y")
    for level in reversed(levels):
        kids = level.groupBy(F.floor(F.col("node") / FAN).alias("parent")).agg(F.collect_list(F.struct("node", "x1", "y1", "x2", "y2", "n")).alias("kids"))
        box = F.col("b")
        # the top level is one row of at most FAN boxes
        met = held.crossJoin(F.broadcast(kids)) if level is levels[-1] else held.join(kids, "parent")
        each = met.select("x", "y", F.explode("kids").alias("b"))
        (near_x, far_x), (near_y, far_y) = _gap("x1", "x2", "x", box), _gap("y1", "y2", "y", box)
        each = each.select("x", "y", box["node"].alias("parent"), box["n"].alias("n"), _norm(near_x, near_y).alias("near"), _norm(far_x, far_y).alias("far"))
        if k == 1:
            reach = F.min("far").over(own)
        else:
            each = each.withColumn("sum", F.sum("n").over(own.orderBy("far").rangeBetween(Window.unboundedPreceding, 0)))
            reach = F.min(F.when(F.col("sum") >= k, F.col("far"))).over(own)
        # fewer than k sites in all: every box stays
        held = each.withColumn("reach", reach).where(F.col("near") <= F.coalesce("reach", F.lit(float("inf"))) + 10.0 ** (1 - DIGITS)).select("x", "y", "parent")
    leaves = sites.groupBy(F.col("leaf").alias("parent")).agg(F.collect_list(F.struct("site", *SHAPE)).alias("own"))
    each = held.join(leaves, "parent").select("x", "y", F.explode("own").alias("s"))
    distance = F.round(E.segment_distance(F.col("x"), F.col("y"), *(F.col("s")[c] for c in SHAPE)), DIGITS)
    each = each.select("x", "y", F.struct(distance.alias("distance"), F.col("s.site").alias("site")).alias("m"))
    if k == 1:
        best = each.groupBy("x", "y").agg(F.min("m").alias("m")).withColumn("place", F.lit(1))
    else:
        best = each.withColumn("place", F.row_number().over(own.orderBy("m"))).where(F.col("place") <= k)
    found = best.select("x", "y", "m.site", "m.distance", "place")
    return points.join(found, [points["x"].cast("double") == found["x"], points["y"].cast("double") == found["y"]]).select(*(points[c] for c in points.columns), "site", "distance", "place")


def nearest_km(points: DataFrame, sites: DataFrame, first: int = 4) -> DataFrame:
    """The columns of points (with x, y, in degrees) with site and km: the nearest of sites (site, x, y) by `exprs.distance_km`, ties to
    the smaller site.

    The plane in which longitudes are shortened as at the latitude farthest from the equator never makes a distance longer. So the
    nearest of k sites there is the nearest of all if the k-th is no nearer in the plane; points for which it isn't are asked again
    with four times as many sites, until all are had."""
    sites = cut(sites.select("site", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna().groupBy("x", "y").agg(F.min("site").alias("site")))
    spots = cut(points.where("x is not null and y is not null").select(F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).distinct())
    far = sites.select("y").unionByName(spots.select(F.col("py").alias("y"))).agg(F.max(F.abs("y")).alias("y"), F.count(F.lit(1))).head().y
    whole, shrink = sites.count(), F.cos(F.radians(F.lit(far if far is not None else 0.0)))
    if not whole:
        return points.limit(0).crossJoin(sites.limit(0).select("site")).withColumn("km", F.lit(0.0))
    flat = sites.select(F.struct("site", F.col("x").alias("sx"), F.col("y").alias("sy")).alias("site"), (F.col("x") * shrink).alias("x"), "y")
    left, k, done = spots, min(first, whole), []
    while True:
        near = nearest(left.select("px", "py", (F.col("px") * shrink).alias("x"), F.col("py").alias("y")), flat, k)
        km = F.round(E.distance_km(F.col("px"), F.col("py"), F.col("site.sx"), F.col("site.sy")), DIGITS)
        best = near.groupBy("px", "py").agg(F.min(F.struct(km.alias("km"), F.col("site.site").alias("site"))).alias("m"), F.max("distance").alias("reach"))
        # a little more than rounding, so that equal distances are asked again too
        best = cut(best.withColumn("sure", F.lit(k >= whole) | (F.col("m.km") < E.KM_PER_DEGREE * F.col("reach") - 1e-6)))
        done.append(best.where("sure"))
        open_ = best.where("not sure")
        if open_.isEmpty():
            break
        left, k = open_.select("px", "py"), min(4 * k, whole)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    met = points.join(found, [points["x"].cast("double") == found["px"], points["y"].cast("double") == found["py"]])
    return met.select(*(points[c] for c in points.columns), "m.site", "m.km")
