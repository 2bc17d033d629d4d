"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonegrid.session import ensure_checkpoint_dir

#: Rows of one Arrow batch. Texts are whole and may be long, so batches are
#: kept short: memory of a Python worker is this many texts, not a partition.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for the session's Python functions."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def col(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(doc: str, text: str) -> Column:
    """A hash of id and text: equal for equal rows only, whether or not they have an id."""
    return F.xxhash64(col(doc).isNull(), col(doc), col(text))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared checkpoint folder (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = "/".join([base, "zonegrid-llm", f"{name}-{os.getpid()}-{uuid.uuid4().hex}"])
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
