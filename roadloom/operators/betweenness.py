"""How much of the shortest paths from some nodes to others each edge carries, equal paths sharing evenly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.sources.stored import Rounds, cut

from . import paths as P

#: Weights of paths are equal within this.
EQUAL = 1e-9


def _waves(first: DataFrame, steps: DataFrame) -> DataFrame:
    """s, node, n: what reaches each node over all ways along steps (s, node, to), a number of steps a round."""
    wave, every = cut(first.select("s", "node", "n")), []
    while True:
        every.append(wave)
        # a store of its own for each wave: they are summed at the end
        held = Rounds(first.sparkSession)
        wave = held.keep(wave.join(steps, ["s", "node"]).groupBy("s", F.col("to").alias("node")).agg(F.sum("n").alias("n")), F.lit(True))
        if not held.open:
            break
    out = every[0]
    for w in every[1:]:
        out = out.unionByName(w)
    return out.groupBy("s", "node").agg(F.sum("n").alias("n"))


def betweenness(edges: DataFrame, sources: DataFrame, targets: DataFrame, weight: str = "t") -> DataFrame:
    """code, share: summed over sources s and targets t <> s (node), the part of the shortest paths from s to t that use an edge
    (directed u, v, weight, code; the edges of a code are summed).

    Counts of paths go out from the sources over the edges that lie on shortest paths, a step of all paths a round; what the
    targets ask for comes back the same way. Rounds are as many as the longest shortest path has edges; no path is listed."""
    none = F.lit(None)
    cases = sources.select(F.col("node").cast("string").alias("case"), F.array(F.col("node").cast("long")).alias("seeds"), none.cast("array<string>").alias("banned"), none.cast("array<long>").alias("targets"))
    far = cut(P.searched(edges.select("u", "v", F.col(weight).alias("w"), "code"), cases.distinct()).select(F.col("case").cast("long").alias("s"), "node", "c"))
    a, b = far.toDF("s", "u", "cu"), far.toDF("s", "v", "cv")
    w: Column = F.col(weight)
    tight = edges.where(w > 0).join(a, "u").join(b, ["s", "v"]).where(F.abs(F.col("cu") + w - F.col("cv")) <= EQUAL).select("s", "u", "v", "code")
    tight = cut(tight)
    start = far.where("node = s").select("s", "node", F.lit(1.0).alias("n"))
    counts = cut(_waves(start, tight.select("s", F.col("u").alias("node"), F.col("v").alias("to"))))
    asked = counts.join(targets.select("node").distinct(), "node").where("node <> s").select("s", "node", (1 / F.col("n")).alias("n"))
    back = _waves(asked, tight.select("s", F.col("v").alias("node"), F.col("u").alias("to")))
    share = tight.join(counts.toDF("s", "u", "out"), ["s", "u"]).join(back.toDF("s", "v", "in"), ["s", "v"])
    return share.groupBy("code").agg(F.sum(F.col("out") * F.col("in")).alias("share"))
