"""Graph operators on edge tables (u, v, weight): shortest weights, components, removal of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.sources.stored import cut


def lightest(edges: DataFrame, weight: str = "t") -> DataFrame:
    """One edge of each ordered pair of nodes, the one of least weight (ties: smallest code)."""
    least = edges.where(F.col(weight) > 0).groupBy("u", "v").agg(F.min(F.struct(weight, "code", "len")).alias("e"))
    return least.select("u", "v", f"e.{weight}", "e.code", "e.len")


def shortest(edges: DataFrame, seeds: DataFrame, weight: str = "t", group: list[str] | None = None, banned: str | None = None) -> DataFrame:
    """Least weights from seeds (group columns, node, c): a row (group, node, c) per reachable node.

    Rounds of relaxation from the nodes that the last round improved, over all groups (origins, removed links) at once. A
    group's `banned` column names the code of edges it may not use. Rounds end when nothing improves, after as
    many as the longest shortest path has edges."""
    group = group or ["o"]
    key = [*group, "node"]
    state = cut(seeds.select(*key, "c").groupBy(*key).agg(F.min("c").alias("c")).withColumn("new", F.lit(True)))
    steps = edges.select(F.col("u").alias("node"), F.col("v").alias("next"), F.col(weight).alias("w"), "code")
    while True:
        reached = state.where("new").join(steps, "node")
        if banned:
            reached = reached.where(F.col("code") != F.col(banned))
        reached = reached.select(*group, F.col("next").alias("node"), (F.col("c") + F.col("w")).alias("c"), F.lit(True).alias("new"))
        # of equal weights the one that was there stays
        best = state.select(*key, "c", F.lit(False).alias("new")).unionByName(reached).groupBy(*key).agg(F.min(F.struct("c", "new")).alias("b"))
        state = cut(best.select(*key, "b.c", "b.new"))
        if state.where("new").isEmpty():
            return state.select(*key, "c")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, by rounds of neighbours' minima and of labels' labels."""
    state = cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = edges.join(state.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        hooked = state.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("m", "label")).alias("to"))
        jump = hooked.groupBy(F.col("label").alias("to")).agg(F.min("to").alias("far"))
        new = cut(hooked.join(jump, "to", "left").select("node", F.least("to", F.coalesce("far", "to")).alias("label"), F.col("label").alias("was")))
        state = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return state

