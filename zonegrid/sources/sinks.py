"""Parquet sinks and their read-back.

Written tables go to the shared folder named by ``spark.checkpoint.dir``
(never a machine-local temp folder), so they also cut lineage: a lost
executor re-reads the written files instead of recomputing from the trips.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path


def run_path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def write_aggregate_checkpoint(cells: DataFrame, path: str) -> None:
    """The zone x bin aggregate, partitioned by month for pruning. Rows are first
    gathered by month in pieces of the session's advisory partition size (small months
    together, large ones cut), so that the files of a month follow its size and not the
    number of tasks."""
    (cells.withColumn("month_key", F.date_format("Time_Bin", "yyyy-MM")).hint("rebalance", "month_key")
     .write.mode("overwrite").option("compression", "snappy")
     .partitionBy("month_key").parquet(path))


def read_aggregate_checkpoint(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if months:
        df = df.where(F.col("month_key").isin(*months))
    return df


def write_splits(df: DataFrame, path: str) -> None:
    """Train and test in one write, partitioned by ``split``, snappy, rows clustered
    by (Zone, Time_Bin) inside each file; files of the advisory partition size, as above."""
    (df.hint("rebalance", "split").sortWithinPartitions("split", "Zone", "Time_Bin")
     .write.mode("overwrite").option("compression", "snappy")
     .partitionBy("split").parquet(path))


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read the feature table (one side is pruned at the partition level)."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)
