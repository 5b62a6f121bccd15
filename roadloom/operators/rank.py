"""The rank of a sparse matrix of any size, by elimination in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.sources.stored import Rounds, cut

#: A prime below 2**31: products of two remainders fit 64 bits.
PRIME = 2_147_483_647


def rank(cells: DataFrame) -> int:
    """cells: row, col, value (whole numbers; of one place summed). Entries are remainders by a prime, so that sums are exact; the rank
    by remainders is that of the numbers unless the prime divides the minors that tell it.

    Every row leads with its first column. Where several rows lead with one column the first stays, and the others are freed of
    that column by it. All columns are worked on at once; rounds end when no two rows lead with one column, and what is left
    then are as many rows as the rank."""
    rounds = Rounds(cells.sparkSession)
    value = F.pmod(F.sum("value"), F.lit(PRIME)).alias("value")
    left = rounds.keep(cells.groupBy("row", "col").agg(value).where("value <> 0"))
    while True:
        heads = left.groupBy("row").agg(F.min("col").alias("lead"))
        first = heads.groupBy("lead").agg(F.min("row").alias("pivot"))
        rest = cut(heads.join(first, "lead").where(F.col("row") != F.col("pivot")))
        if rest.isEmpty():
            return heads.count()
        at = lambda name: left.select(F.col("row").alias(name), F.col("col").alias("lead"), F.col("value").alias(f"of_{name}"))
        # row times the pivot's lead, less the pivot times the row's lead: the leading column cancels
        rest = rest.join(at("row"), ["row", "lead"]).join(at("pivot"), ["pivot", "lead"])
        # rows that stay are taken as they are
        own = left.join(rest.select("row", "of_pivot"), "row", "left").select("row", "col", (F.col("value") * F.coalesce("of_pivot", F.lit(1)) % PRIME).alias("value"))
        less = rest.select("row", "pivot", "of_row").join(left.withColumnRenamed("row", "pivot"), "pivot")
        less = less.select("row", "col", (PRIME - F.col("value") * F.col("of_row") % PRIME).alias("value"))
        left = rounds.keep(own.unionByName(less).groupBy("row", "col").agg(value).where("value <> 0"))
