"""Tables in and out: parquet scans, and intermediate tables in the shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, as it is written there: a path without scheme
    belongs to the cluster's default file system. Only a session on one machine gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        base = "file:///tmp/checkpoints"
    return base.rstrip("/")


def tasks(spark: SparkSession, rows: int | None, each: int = 1 << 22) -> int:
    """A number of partitions of about `each` rows, not below the session's: for joins whose rows are many more than the bytes
    read by them tell, by which Spark puts partitions together."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // each))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: the lineage of a loop is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_base(spark)}/roadloom-loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Stored states of a loop; a round's predecessor goes once the round is written. `open` is the number of rows of the last
    state for which `watch` held, counted while it was written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n, self.open = spark, f"{shared_base(spark)}/roadloom-loop-{uuid.uuid4().hex}", 0, 0

    def keep(self, df: DataFrame, watch: Column | None = None) -> DataFrame:
        self.n += 1
        if watch is not None:
            seen = Observation()
            df = df.observe(seen, F.count_if(watch).alias("open"))
        df.write.parquet(f"{self.root}/{self.n}")
        if watch is not None:
            self.open = seen.get["open"]
        if self.n > 1:
            discard(self.spark, f"{self.root}/{self.n - 1}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")
