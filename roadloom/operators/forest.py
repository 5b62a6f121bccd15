"""Trees in graphs of any size by rounds of joins: spanning forests, ranks along chains, bridges and what they cut off.

Nothing here is searched from every node and no component is gathered: a round handles all nodes at once, and the number of
rounds grows with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.sources.stored import Rounds, cut

from .prefix import numbered, running


def list_ranks(links: DataFrame, total: str | None = None, rings: bool = False) -> DataFrame:
    """item, last, steps of chains given as (item, next; null at an end): the end of each item's chain and the number of
    links to it; with `total`, the sum of that column over the item and those after it as well. Every item has at most one
    next and one before it. A round quadruples how far an item sees.

    With `rings` chains may close; the items of such have a null `last`, and `low` is the least item of their ring."""
    linked, low = F.col("next").isNotNull(), rings
    rounds = Rounds(links.sparkSession)
    state = links.select("item", "next", F.coalesce("next", "item").alias("last"), linked.cast("long").alias("steps"), (F.col(total) if total else F.lit(0)).alias("sum"), *([F.col("item").alias("low")] if low else []))
    state = rounds.keep(state, linked)
    items, seen = rounds.open, 1
    # an item that saw as many links as there are and no end is on a ring
    while rounds.open and not (rings and seen > items):
        to = state.select(F.col("item").alias("next"), F.col("next").alias("after"), F.col("last").alias("end"), F.col("steps").alias("more"), F.col("sum").alias("plus"), *([F.col("low").alias("less")] if low else []))
        going = state.where("next is not null")
        for _ in range(3):  # the same side each time: it is dealt once
            steps, sums = (F.col(c) + F.coalesce(plus, F.lit(0)) for c, plus in (("steps", "more"), ("sum", "plus")))
            least = [F.least("low", F.coalesce("less", "low")).alias("low")] if low else []
            going = going.join(to, "next", "left").select("item", F.col("after").alias("next"), F.coalesce("end", "last").alias("last"), steps.alias("steps"), sums.alias("sum"), *least)
        state = rounds.keep(state.where("next is null").unionByName(going), linked)
        seen *= 4
    last = F.when(~linked, F.col("last")).alias("last") if rings else F.col("last")
    return state.select("item", last, "steps", *([F.col("sum").alias(total)] if total else []), *(["low"] if low else []))


def spanning(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v, id; undirected, one row each) of a spanning forest, and (node, part) with a name for each component.

    Every part takes its first edge to another part, in an order of the ids; parts that are joined get one name by
    pointer jumping. The number of parts at least halves in a round."""
    order = F.struct(F.xxhash64("id").alias("h"), "id", "u", "v")
    spark = edges.sparkSession
    parts, chosen = nodes.select("node", F.col("node").alias("part")), edges.select("u", "v", "id").limit(0)
    state, some = Rounds(spark), F.lit(True)
    left = state.keep(edges.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b"), order.alias("edge")), some)
    while state.open:
        both = left.select(F.explode(F.array(F.struct(F.col("a").alias("part"), F.col("b").alias("to")), F.struct(F.col("b").alias("part"), F.col("a").alias("to")))).alias("x"), "edge")
        best = cut(both.groupBy(F.col("x.part").alias("part")).agg(F.min(F.struct("edge", "x.to")).alias("m")).select("part", "m.to", "m.edge"))
        chosen = chosen.unionByName(best.select("edge").distinct().select("edge.u", "edge.v", "edge.id"))
        # of two parts that chose the same edge the smaller is the root
        back = best.select(F.col("part").alias("to"), F.col("edge").alias("their"))
        root = (F.col("edge") == F.col("their")) & (F.col("part") < F.col("to"))
        names = best.join(back, "to", "left").select("part", F.when(root, F.col("part")).otherwise(F.col("to")).alias("to"))
        jumps = Rounds(spark)
        while True:
            up = names.select(F.col("part").alias("to"), F.col("to").alias("next"))
            twice = names.select("part", "to").join(up, "to").select("part", F.col("next").alias("to"))
            thrice = twice.join(up, "to").select("part", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
            names = jumps.keep(thrice, F.col("moved"))
            if not jumps.open:
                break
        name = names.select("part", F.col("to").alias("name"))
        parts = parts.join(name, "part", "left").select("node", F.coalesce("name", "part").alias("part"))
        side = lambda c: name.select(F.col("part").alias(c), F.col("name").alias(f"new_{c}"))
        left = state.keep(left.join(side("a"), "a").join(side("b"), "b").where("new_a <> new_b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b"), "edge"), some)
    return cut(chosen), cut(parts)


def tours(tree: DataFrame, parts: DataFrame) -> DataFrame:
    """Arcs (u, v, id, part, place) in the order of a walk around each tree, from place 0: both directions of every edge."""
    arcs = tree.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("a"), "id").select("a.u", "a.v", "id")
    arcs = numbered(arcs, ["v"], ["u"], total="degree")
    # after (x, u) comes the arc of u that follows (u, x)
    follow = arcs.select("u", F.col("place").alias("turn"), F.col("v").alias("w"))
    walk = arcs.withColumn("turn", (F.col("place") + 1) % F.col("degree")).join(follow, ["u", "turn"])
    root = parts.groupBy("part").agg(F.min("node").alias("root"))
    at = parts.join(root, "part")
    walk = walk.join(at.withColumnRenamed("node", "u"), "u")
    # the walk around a tree starts at the first arc of its root: the last arc before it has no next
    ends = (F.col("u") == F.col("root")) & (F.col("turn") == 0)
    links = walk.select(F.struct(F.col("v").alias("u"), F.col("u").alias("v")).alias("item"), F.when(~ends, F.struct("u", F.col("w").alias("v"))).alias("next"))
    ranked = list_ranks(links)
    sizes = parts.groupBy("part").agg((2 * F.count(F.lit(1)) - 3).alias("last_place"))
    ranked = ranked.select("item.u", "item.v", "steps").join(arcs.select("u", "v", "id"), ["u", "v"]).join(parts.withColumnRenamed("node", "u"), "u").join(sizes, "part")
    return cut(ranked.select("u", "v", "id", "part", (F.col("last_place") - F.col("steps")).alias("place")))


def bridges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, inside, outside of every edge whose removal parts a component: the weights (node, weight) of its two sides.

    Edges (u, v, id) are undirected, one row each; loops are no bridges, and of two edges between the same nodes
    neither is one. Edges outside a spanning forest get two random labels of 64 bits; an edge of the forest is a bridge if the
    labels of the edges that leave its subtree cancel, that is if none leaves it (up to a chance of 2**-128)."""
    edges = edges.where("u <> v")
    tree, parts = spanning(edges, nodes)
    extra = edges.join(tree.select("id", "u", "v"), ["id", "u", "v"], "left_anti")
    marks = extra.select(F.explode(F.array("u", "v")).alias("node"), F.xxhash64("id", "u", "v").alias("x"), F.xxhash64(F.lit(977), "v", "id", "u").alias("y"))
    marks = marks.groupBy("node").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    zero = F.lit(0).cast("long")
    known = nodes.select("node", "weight").join(marks, "node", "left").select("node", "weight", F.coalesce("x", zero).alias("x"), F.coalesce("y", zero).alias("y"))
    walk = tours(tree, parts)
    back = walk.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("place").alias("back"))
    walk = walk.join(back, ["u", "v"]).withColumn("down", F.col("place") < F.col("back"))
    # an arc downwards stands for the node that it enters
    walk = walk.join(known.withColumnRenamed("node", "v"), "v")
    own = lambda c: F.when(F.col("down"), F.col(c)).otherwise(F.lit(0).cast(nodes.schema["weight"].dataType if c == "weight" else "long"))
    walk = walk.select("part", "place", "back", "down", "id", *(own(c).alias(c) for c in ("weight", "x", "y")))
    walk = running(walk, "place", {"sum": "weight"}, ["part"])
    walk = cut(running(walk, "place", {"xs": "x", "ys": "y"}, ["part"], how=F.bit_xor, joined=lambda a, b: a.bitwiseXOR(b)))
    end = walk.where("not down").select("part", F.col("place").alias("back"), F.col("sum").alias("to_sum"), F.col("xs").alias("to_xs"), F.col("ys").alias("to_ys"))
    total = known.join(parts, "node").groupBy("part").agg(F.sum("weight").alias("total"))
    cancel = lambda c: F.col(f"to_{c}s").bitwiseXOR(F.col(f"{c}s")).bitwiseXOR(F.col(c)) == 0
    inside = F.col("to_sum") - F.col("sum") + F.col("weight")
    return walk.where("down").join(end, ["part", "back"]).where(cancel("x") & cancel("y")).join(total, "part").select("id", inside.alias("inside"), (F.col("total") - inside).alias("outside"))


def contracted(edges: DataFrame) -> DataFrame:
    """link, place, u, v, id of every edge (u, v, id; undirected): chains of edges between junctions in order.

    A node with other than two edges is a junction; a ring without one is broken at its smallest node. A link runs from the
    smaller of its ends, at equal ends by the smaller neighbour, and links are numbered in that order from 1. Of edges between the same
    nodes each counts; loops take no part."""
    edges = edges.where("u <> v")
    arcs = edges.select("id", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("a"))
    arcs = cut(arcs.select(F.struct("a.u", "a.v", "id").alias("item")))
    ends = arcs.groupBy(F.col("item.u").alias("at")).agg(F.count(F.lit(1)).alias("degree"), F.min("item").alias("one"), F.max("item").alias("two"))
    # at a node of two edges the way goes on by the other one
    passing = ends.where("degree = 2").select("at", "one", "two")
    ways = arcs.join(passing, F.col("item.v") == F.col("at"), "left")
    ways = cut(ways.select("item", F.when(F.col("one.id") == F.col("item.id"), F.col("two")).otherwise(F.col("one")).alias("next")))
    ranked = cut(list_ranks(ways, rings=True))
    open_, closed = ranked.where("last is not null").drop("low"), ranked.where("last is null")
    # a ring ends at its smallest node
    broken = closed.join(ways, "item").select("item", F.when(F.col("item.v") != F.col("low.u"), F.col("next")).alias("next"))
    ranked = open_ if closed.isEmpty() else cut(open_.unionByName(list_ranks(broken)))
    back = ranked.select(F.struct(F.col("item.v").alias("u"), F.col("item.u").alias("v"), F.col("item.id").alias("id")).alias("item"), F.col("last").alias("first"), F.col("steps").alias("place"))
    both = ranked.join(back, "item")
    start = F.struct(F.col("first.v").alias("at"), F.col("first.u").alias("to"), F.col("first.id").alias("id"))
    end = F.struct(F.col("last.v").alias("at"), F.col("last.u").alias("to"), F.col("last.id").alias("id"))
    # of the two ways along a link the one from the smaller end stays
    forward = cut(both.withColumns({"start": start, "end": end}).where(F.col("start") < F.col("end")))
    links = numbered(forward.select("start").distinct(), ["start"])
    return forward.join(links.withColumnRenamed("place", "n"), "start").select((F.col("n") + 1).alias("link"), F.col("place").cast("int").alias("place"), F.col("item.u").alias("u"), F.col("item.v").alias("v"), F.col("item.id").alias("id"))
