"""Contracts of inputs: column names, matrices, zones; what is wrong comes back as rows, or as an error on request."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_name(name: str) -> str:
    """Lower-case letters and digits alone."""
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def renamed(df: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """The canonical columns, each from the first of its aliases that the table has, in any case and punctuation; those that
    are missing are null. A required one that is missing is an error that names what was tried and what there is."""
    there: dict[str, str] = {}
    for c in df.columns:
        there.setdefault(plain_name(c), c)
    out = []
    for name, tried in aliases.items():
        found = next((there[plain_name(t)] for t in (name, *tried) if plain_name(t) in there), None)
        if found is None and name in required:
            raise ValueError(f"no column for {name}: tried {[name, *tried]}, found {df.columns}")
        out.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def unique_names(names: Sequence[str], most: int = 55) -> list[str]:
    """Names that differ whatever the case, none longer than a bound: later ones get a number."""
    out: list[str] = []
    for name in names:
        short, k = name[:most], 1
        while short.lower() in {x.lower() for x in out}:
            k += 1
            short = f"{name[: most - len(str(k)) - 1]}_{k}"
        out.append(short)
    return out


def matrix_faults(cells: DataFrame) -> DataFrame:
    """Checks of a labelled matrix in long form (o, d, value as text): check, n (how often it is broken).

    Cells are read once for the cells' own checks and once by label; nothing is pivoted."""
    o, d, value = F.trim("o"), F.trim("d"), F.col("value").try_cast("double")
    own = cells.agg(
        F.count_if(value.isNull()).alias("not a number"),
        F.count_if(value.isin(float("inf"), float("-inf")) | F.isnan(value)).alias("not finite"),
        F.count_if(value < -1e-9).alias("negative"),
        F.count_if((o == d) & (value != 0)).alias("diagonal"),
        (F.count(F.lit(1)) - F.count_distinct(o, d)).alias("repeated"),
    )
    names = ["not a number", "not finite", "negative", "diagonal", "repeated"]
    rows = own.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("n")) for n in names))).alias("x")).select("x.*")
    sides = cells.select(F.explode(F.array(F.struct(o.alias("label"), F.lit(1).alias("row"), F.lit(0).alias("column")), F.struct(d.alias("label"), F.lit(0).alias("row"), F.lit(1).alias("column")))).alias("x")).select("x.*")
    labels = sides.groupBy("label").agg(F.max("row").alias("row"), F.max("column").alias("column"))
    sums = labels.agg(F.sum(1 - F.col("column")).alias("a"), F.sum(1 - F.col("row")).alias("b"))
    more = sums.select(F.explode(F.array(F.struct(F.lit("row without column").alias("check"), F.col("a").alias("n")), F.struct(F.lit("column without row").alias("check"), F.col("b").alias("n")))).alias("x")).select("x.*")
    return rows.unionByName(more)


def clean_matrix(cells: DataFrame, fail: bool = True) -> DataFrame:
    """o, d, value of a matrix in long form: labels trimmed, rows and columns without any value dropped, a zero diagonal.
    What then breaks a check is an error."""
    told = cells.select(F.trim("o").alias("o"), F.trim("d").alias("d"), "value")
    rows = told.where("value is not null").select("o").distinct()
    columns = told.where("value is not null").select("d").distinct()
    kept = told.join(rows, "o", "left_semi").join(columns, "d", "left_semi")
    kept = kept.withColumn("value", F.when(F.col("o") == F.col("d"), F.lit("0")).otherwise(F.col("value")))
    if fail and (broken := matrix_faults(kept).where("n > 0").collect()):
        raise ValueError("matrix: " + ", ".join(f"{r.check} ({r.n})" for r in sorted(broken)))
    return kept.select("o", "d", F.col("value").try_cast("double").alias("value"))


def zones(rows: DataFrame, numbers: Sequence[str], fail: bool = True) -> DataFrame:
    """Rows whose zone_id is a whole number, as text; names trimmed; the named columns as numbers or null. Ids that repeat are an error."""
    id_ = F.trim(F.col("zone_id").cast("string"))
    kept = rows.where(id_.rlike("^[0-9]+$")).withColumns({"zone_id": id_.cast("long").cast("string"), "name": F.trim("name")} | {c: F.col(c).cast("string").try_cast("double") for c in numbers})
    if fail and (twice := kept.groupBy("zone_id").count().where("count > 1").limit(5).collect()):
        raise ValueError(f"zone ids repeat: {[r.zone_id for r in twice]}")
    return kept


def joined_whole(left: DataFrame, right: DataFrame, on: list[str], what: str) -> DataFrame:
    """An inner join that loses no row of the left side: rows without a partner are an error that names some of them."""
    if lost := left.join(right, on, "left_anti").select(*on).limit(5).collect():
        raise ValueError(f"{what}: no partner for {[tuple(r) for r in lost]}")
    return left.join(right, on)


def weights(values: Mapping[str, float]) -> dict[str, float]:
    """Shares of a sum, negatives counting as 0; as they are if nothing is positive."""
    clamped = {k: max(0.0, float(v)) for k, v in values.items()}
    total = sum(clamped.values())
    return {k: v / total for k, v in clamped.items()} if total > 0 else dict(values)


def bool_text(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("yes", "y", "true", "t", "1", "on"), F.lit(False))
