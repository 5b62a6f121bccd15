"""Helpers that the operators share: the shared folder, stored intermediate tables, words."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.sources.stored import discard, shared_base

#: Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = re.compile("[^\x20\x09-\x0d]+")
SPACES = "[\\x20\\x09-\\x0D]+"
#: A null id counts as larger than every other id.
NULL_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    Operators start here, so this is also where Arrow batches are bounded: a task holds a few MB of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{8 << 20}b")
    return f"{shared_base(spark)}/roadloom-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str = "table", root: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: computed once, lineage cut, and any
    executor may be lost afterwards."""
    spark = df.sparkSession
    path = f"{root or shared_dir(spark)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, root: str, *names: str) -> None:
    """Delete stored tables that nothing reads any more."""
    for name in names:
        discard(spark, f"{root}/{name}")


def folded(docs: DataFrame, *own: str) -> DataFrame:
    """The own columns, and all others in one named _rest, so that no name can clash with an operator's."""
    rest = [c for c in docs.columns if c not in own]
    return docs.select(*own, (F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(0)).alias("_rest"))


def unfolded(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from rows that were folded."""
    own = set(df.columns)
    return df.select(*(F.col(c) if c in ("doc_id", "text", "lang") and c in own else F.col("_rest").getField(c).alias(c) for c in docs.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
