"""Row numbers and running sums of tables of any size: no window without a partition, no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.sources.stored import cut

#: Rows whose running sums one task makes.
BLOCK = 1 << 16


def numbered(df: DataFrame, order: list, by: list[str] | None = None, place: str = "place", total: str | None = None, keep=cut) -> DataFrame:
    """The rows with their place (from 0) in the order within `by`, and the number of rows there as `total`.

    Rows are dealt by ranges of (by, order), a group of any size to as many tasks as it needs; what is summed up over
    tasks is a row for each task and group. Ties keep any order, so `order` should tell all rows apart that differ."""
    by = by or []
    keys = [*by, *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the upper bits are the task, the lower 33 the row in it
    dealt = keep(dealt.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33).alias("_task")
    sums = dealt.groupBy(task, *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    before = F.sum("_n").over(whole.orderBy("_task")) - F.col("_n")
    sums = sums.select("_task", *by, (F.col("_first") - before).alias("_from"), *([F.sum("_n").over(whole).alias(total)] if total else []))
    same = F.col("_task") == F.shiftright("_at", 33)
    for c in by:
        sums = sums.withColumnRenamed(c, f"_by_{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = dealt.join(sums, same)
    return out.select(*df.columns, (F.col("_at") - F.col("_from")).alias(place), *([total] if total else []))


def running(df: DataFrame, place: str, values: dict[str, str], by: list[str] | None = None, how=F.sum, joined=None, block: int = BLOCK) -> DataFrame:
    """The rows with running totals {new column: column} up to each row's place (whole numbers from 0, each once within
    `by`), itself included. Blocks of places are summed side by side; the totals of blocks before are added."""
    by = by or []
    joined = joined or (lambda a, b: a + b)
    key = [*by, "_block"]
    rows = df.withColumn("_block", F.floor(F.col(place) / block))
    within = Window.partitionBy(*key).orderBy(place)
    rows = rows.withColumns({new: how(F.col(c)).over(within) for new, c in values.items()})
    totals = rows.groupBy(*key).agg(*(how(F.col(c)).alias(f"_sum_{new}") for new, c in values.items()))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"_sum_{new}": how(f"_sum_{new}").over(earlier) for new in values})
    for c in by:
        totals = totals.withColumnRenamed(c, f"_by_{c}")
    same = F.col("_block") == F.col("_b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = rows.join(totals.withColumnRenamed("_block", "_b"), same)
    plus = lambda new: F.when(F.col(f"_sum_{new}").isNull(), F.col(new)).otherwise(joined(F.col(f"_sum_{new}"), F.col(new)))
    return out.select(*df.columns, *(plus(new).alias(new) for new in values))
