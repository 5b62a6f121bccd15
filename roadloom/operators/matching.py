"""Labels that choose places in turn, without going one by one: proposals of all at once, each place holding the first in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.sources.stored import Rounds, cut

from .nearest import nearest
from .prefix import numbered

#: Nearest areas that a label knows at first; whoever has tried all of its own gets four times as many.
KNOWN = 4


def attached(labels: DataFrame, areas: DataFrame) -> DataFrame:
    """label, area, distance, shared: each label with an area of its own, as near as can be.

    labels: label, x, y; areas: area, x, y. Labels choose in order of the distance to their nearest area (ties: label),
    each the nearest area still free (ties: area), or its nearest one, shared, if none is free. Rows with a null take no part; without
    areas there are no rows; a label that repeats chooses as often.

    In a round every label without an area proposes to the nearest one that nobody before it in turn holds; an area holds the
    first of those who proposed. A holder is only ever replaced by one before it, so what is held in the end is what going one by
    one gives. Labels beyond the number of areas find none free, and share."""
    labels, areas = (df.select(k, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna() for k, df in (("label", labels), ("area", areas)))
    sites = cut(areas.select(F.col("area").alias("site"), "x", "y"))
    turn = nearest(labels, sites).select("label", "x", "y", F.col("site").alias("area"), "distance")
    turn = cut(numbered(turn, ["distance", "label", "x", "y"], place="rank"))
    free = sites.select("site").distinct().count()
    own, late = turn.where(F.col("rank") < free), turn.where(F.col("rank") >= free)
    wanted = own.count()

    def known(rows: DataFrame, k: int) -> DataFrame:
        return nearest(rows.select("rank", "x", "y"), sites, k).select("rank", "place", F.col("site").alias("area"), "distance")

    k, spark = KNOWN, labels.sparkSession
    lists = cut(known(own, k)) if wanted else None
    held_rounds, asked_rounds = Rounds(spark), Rounds(spark)
    held = held_rounds.keep(own.select("area", "rank", "distance").limit(0))
    while wanted:
        waiting = own.select("rank").join(held.select("rank"), "rank", "left_anti")
        open_ = lists.join(waiting, "rank").join(held.select("area", F.col("rank").alias("first")), "area", "left").where(F.col("first").isNull() | (F.col("first") > F.col("rank")))
        asked = open_.groupBy("rank").agg(F.min(F.struct("place", "area", "distance")).alias("m")).select("m.area", "rank", "m.distance")
        asked = asked_rounds.keep(asked, F.lit(True))
        if not asked_rounds.open:
            k *= 4
            lists = cut(lists.join(waiting, "rank", "left_anti").unionByName(known(own.join(waiting, "rank", "left_semi"), k)))
            continue
        every = held.unionByName(asked).groupBy("area").agg(F.min(F.struct("rank", "distance")).alias("m"))
        held = held_rounds.keep(every.select("area", "m.rank", "m.distance"), F.lit(True))
        if held_rounds.open == wanted:
            break
    mine = held.join(own.select("rank", "label"), "rank").select("label", "area", "distance", F.lit(False).alias("shared"))
    return mine.unionByName(late.select("label", "area", "distance", F.lit(True).alias("shared")))
