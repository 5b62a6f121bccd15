"""Points put onto lines: each projected on its nearest line, and the lines split there, in the order of the points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.sources.stored import cut

from .nearest import nearest
from .prefix import numbered


def node_key(x: Column, y: Column, digits: int) -> Column:
    """Nodes are places rounded to some digits, as text."""
    part = lambda c: F.format_string(f"%.{digits}f", F.bround(c, digits) + 0.0)
    return F.concat_ws(" ", part(x), part(y))


def measured(lines: DataFrame) -> DataFrame:
    """code, k, ax, ay, bx, by, from (way along the line to the segment), size, whole, u, v of every segment of lines (code, pts), where
    u and v are the ends of the line."""
    n = F.size("pts")
    pairs = F.zip_with(F.slice("pts", 1, n - 1), F.slice("pts", 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    sized = F.transform(pairs, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.sqrt(F.pow(s["b"]["x"] - s["a"]["x"], 2) + F.pow(s["b"]["y"] - s["a"]["y"], 2)).alias("size")))
    # a line's own vertices: the way to each is a sum over the ones before
    ways = F.transform(F.sequence(F.lit(1), F.size("sized")), lambda j: F.aggregate(F.slice("sized", 1, j - 1), F.lit(0.0), lambda t, s: t + s["size"]))
    rows = lines.where(n > 1).select("code", "pts", sized.alias("sized")).select("code", "pts", "sized", ways.alias("ways"))
    whole = F.element_at("ways", -1) + F.element_at("sized", -1)["size"]
    rows = rows.select("code", whole.alias("whole"), F.element_at("pts", 1).alias("u"), F.element_at("pts", -1).alias("v"), F.posexplode(F.arrays_zip("sized", "ways")).alias("k", "s"))
    part = F.col("s.sized")
    return rows.select(
        "code", "k", part["a"]["x"].alias("ax"), part["a"]["y"].alias("ay"), part["b"]["x"].alias("bx"), part["b"]["y"].alias("by"),
        F.col("s.ways").alias("from"), part["size"].alias("size"), "whole", "u", "v",
    )


def projected(points: DataFrame, lines: DataFrame, digits: int = 6) -> DataFrame:
    """The columns of points (with id, x, y) with code, at (way along the line), whole, distance, node, u, v: the nearest point of the
    nearest line, ties to the smaller code and the earlier segment. A way that ends nearer than the rounding to an end is at that end."""
    parts = cut(measured(lines))
    found = nearest(points, parts.select(F.struct("code", "k").alias("site"), "ax", "ay", "bx", "by"))
    found = found.withColumns({"code": F.col("site.code"), "k": F.col("site.k")}).drop("site", "place").join(parts, ["code", "k"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / size))).otherwise(0.0)
    found = found.withColumn("t", t).withColumns({"px": F.col("ax") + F.col("t") * dx, "py": F.col("ay") + F.col("t") * dy, "at": F.col("from") + F.col("t") * F.col("size")})
    ends = {c: node_key(F.col(c)["x"], F.col(c)["y"], digits) for c in ("u", "v")}
    found = found.withColumn("node", node_key(F.col("px"), F.col("py"), digits)).withColumns(ends)
    # no length on one side: the end itself
    node = F.when(F.col("at") <= 0, F.col("u")).when(F.col("at") >= F.col("whole"), F.col("v")).otherwise(F.col("node"))
    return found.select(*points.columns, "code", "at", "whole", "distance", node.alias("node"), "u", "v")


def split(points: DataFrame, lines: DataFrame, digits: int = 6, carried: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (columns of points, code, distance, node, is_new) and edges (u, v, code, part, length, carried columns of lines) in both
    directions, after every point in the order of its id was put onto its nearest line.

    Of points that fall on one node of a line the first makes the node where it lies, the others use it, and so does one at an end of
    the line. What a point splits is the piece that earlier points have left; together that is the line cut at all first
    points, so nothing has to go one by one, and lines with very many points are cut by many tasks."""
    on = cut(projected(points, lines, digits))
    inner = on.where((F.col("node") != F.col("u")) & (F.col("node") != F.col("v")))
    first = inner.groupBy("code", "node").agg(F.min_by("at", "id").alias("at"), F.min("id").alias("by"))
    nodes = on.join(first.select("code", "node", "by"), ["code", "node"], "left")
    nodes = nodes.select(*points.columns, "code", "distance", "node", F.coalesce(F.col("by") == F.col("id"), F.lit(False)).alias("is_new"))

    whole = measured(lines).where("k = 0").select("code", "whole", *(node_key(F.col(c)["x"], F.col(c)["y"], digits).alias(c) for c in ("u", "v")))
    ends = F.array(F.struct(F.lit(0.0).alias("at"), F.lit(0).alias("kind"), F.col("u").alias("node")), F.struct(F.col("whole").alias("at"), F.lit(2).alias("kind"), F.col("v").alias("node")))
    stops = whole.select("code", F.explode(ends).alias("s")).select("code", "s.*").unionByName(first.select("code", "at", F.lit(1).alias("kind"), "node"))
    stops = cut(numbered(stops, ["at", "kind", "node"], ["code"]))
    to = stops.select("code", (F.col("place") - 1).alias("place"), F.col("at").alias("to_at"), F.col("node").alias("to_node"))
    pieces = stops.join(to, ["code", "place"]).select("code", F.col("place").alias("part"), F.col("node").alias("u"), F.col("to_node").alias("v"), (F.col("to_at") - F.col("at")).alias("length"))
    pieces = pieces.join(lines.select("code", *(carried or [])), "code")
    both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
    return nodes, pieces.select(both, "code", "part", "length", *(carried or [])).select("e.u", "e.v", "code", "part", "length", *(carried or []))


def noded(lines: DataFrame, size: float, tolerance: float = 1e-6, carried: list[str] | None = None) -> DataFrame:
    """code, part, pieces, length, pts and carried columns: lines (code, pts) split wherever another line meets them in a point.

    Candidates are segments whose boxes touch a common cell of a grid. Nothing is cut nearer than the tolerance to a line's own
    end, so ends that lines share stay as they are; two lines that run along each other for a way aren't split by one another."""
    s = cut(measured(lines))
    low, high = (lambda a, b: F.floor(F.least(a, b) / size)), (lambda a, b: F.floor(F.greatest(a, b) / size))
    cells = F.flatten(F.transform(F.sequence(low("ax", "bx"), high("ax", "bx")), lambda i: F.transform(F.sequence(low("ay", "by"), high("ay", "by")), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    own = s.select("code", "k", "ax", "ay", "bx", "by", "from", "size", "whole", F.explode(cells).alias("cell"))
    other = own.select("cell", *(F.col(c).alias(f"o_{c}") for c in ("code", "k", "ax", "ay", "bx", "by", "from", "size", "whole")))
    pairs = own.join(other, "cell").where("code < o_code").drop("cell").dropDuplicates(["code", "k", "o_code", "o_k"])
    dx, dy, ox, oy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("o_bx") - F.col("o_ax"), F.col("o_by") - F.col("o_ay")
    gx, gy = F.col("o_ax") - F.col("ax"), F.col("o_ay") - F.col("ay")
    den = dx * oy - dy * ox
    near = 1e-12 * F.greatest(F.col("size") * F.col("o_size"), F.lit(1e-12))
    along = lambda x, y: (x * dx + y * dy) / (F.col("size") * F.col("size"))
    start, stop = along(gx, gy), along(gx + ox, gy + oy)
    shared = F.least(F.greatest(start, stop), F.lit(1.0)) - F.greatest(F.least(start, stop), F.lit(0.0))
    beside = (F.abs(den) <= near) & (F.abs(gx * dy - gy * dx) <= 1e-9 * F.col("size")) & (shared * F.col("size") > tolerance)
    t, q = F.when(F.abs(den) > near, (gx * oy - gy * ox) / den), F.when(F.abs(den) > near, (gx * dy - gy * dx) / den)
    inside = lambda c: (c >= -1e-9) & (c <= 1 + 1e-9)
    pairs = cut(pairs.select("code", "o_code", "from", "size", "whole", "o_from", "o_size", "o_whole", "ax", "ay", t.alias("t"), q.alias("q"), beside.alias("beside"), dx.alias("dx"), dy.alias("dy")))
    alike = pairs.where("beside").select("code", "o_code").distinct()
    met = pairs.where(inside(F.col("t")) & inside(F.col("q"))).join(alike, ["code", "o_code"], "left_anti")
    at = F.struct((F.col("ax") + F.col("t") * F.col("dx")).alias("x"), (F.col("ay") + F.col("t") * F.col("dy")).alias("y"))
    sides = F.array(F.struct("code", (F.col("from") + F.col("t") * F.col("size")).alias("at"), "whole"), F.struct(F.col("o_code").alias("code"), (F.col("o_from") + F.col("q") * F.col("o_size")).alias("at"), F.col("o_whole").alias("whole")))
    cuts = met.select(F.explode(sides).alias("s"), at.alias("p")).select("s.code", F.round("s.at", 6).alias("at"), "s.whole", "p")
    cuts = cuts.where((F.col("at") > tolerance) & (F.col("at") < F.col("whole") - tolerance)).groupBy("code", "at").agg(F.min("p").alias("p"))
    ends = s.where("k = 0").select("code", F.explode(F.array(F.struct(F.lit(0.0).alias("at"), F.col("u").alias("p")), F.struct(F.col("whole").alias("at"), F.col("v").alias("p")))).alias("e")).select("code", "e.*")
    stops = cut(numbered(ends.unionByName(cuts), ["at"], ["code"], total="stops"))
    to = stops.select("code", (F.col("place") - 1).alias("place"), F.col("at").alias("to_at"), F.col("p").alias("to_p"))
    bends = s.where("k > 0").groupBy("code").agg(F.sort_array(F.collect_list(F.struct(F.col("from").alias("at"), F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("p")))).alias("bends"))
    between = F.filter("bends", lambda b: (b["at"] > F.col("at") + tolerance) & (b["at"] < F.col("to_at") - tolerance))
    pts = F.concat(F.array("p"), F.coalesce(F.transform(between, lambda b: b["p"]), F.array().cast("array<struct<x:double,y:double>>")), F.array("to_p"))
    rows = stops.join(to, ["code", "place"]).join(bends, "code", "left")
    rows = rows.select("code", F.col("place").alias("part"), (F.col("stops") - 1).alias("pieces"), (F.col("to_at") - F.col("at")).alias("length"), pts.alias("pts"))
    return rows.join(lines.select("code", *carried), "code") if carried else rows
