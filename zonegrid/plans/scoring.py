"""Scoring job: land validated requests, then feature, score and decorate them.

Validation output is written once to the shared folder, partitioned by
``valid``: rejects stay queryable as their own table, scoring reads only the
``valid=true`` partition (partition pruning, no predicate over the parse
expressions), and a lost executor re-reads files instead of re-parsing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import surge
from ..ml import explain
from ..operators import matrix
from ..operators import requests as R
from ..sources.sinks import run_path

_LANDED: dict[tuple[str, str], str] = {}


def land_validated(validated: DataFrame, path: str) -> None:
    validated.write.mode("overwrite").option("compression", "snappy").partitionBy("valid").parquet(path)


def read_landed(spark: SparkSession, path: str, valid: bool | None = True) -> DataFrame:
    df = spark.read.parquet(path)
    if valid is not None:
        df = df.where(F.col("valid") == F.lit(valid))
    return df.select(*R.VALIDATED_COLUMNS)


def landed_requests(spark: SparkSession, key: str, build) -> str:
    """Path of the landed validation table for ``key`` (built once per session)."""
    k = (spark.sparkContext.applicationId, key)
    path = _LANDED.get(k)
    if path is None or not _exists(spark, path):
        path = run_path(spark, "validated")
        land_validated(build(), path)
        _LANDED[k] = path
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def score_valid(valid: DataFrame, model, features: list[str], calibration: dict, leaves: list[list[float]]) -> DataFrame:
    """R7, the one scoring body of the job, the stream and the query: prediction, level,
    confidence, error band with its nominal level, recommendation, defaults used."""
    aligned = R.align_to_manifest(R.request_features(valid), features)
    scored = explain.with_leaves(model).transform(matrix.assemble(aligned, features, label=None))
    pred = F.col("prediction")
    p10, p90 = calibration.get("p10"), calibration.get("p90")
    known = p10 is not None and p90 is not None
    number = lambda c: (c if known else F.lit(None)).cast("double")
    return explain.tree_dispersion(scored, leaves).select(
        "request_id", pred.alias("prediction"), surge.surge_level(pred).alias("surge_level"),
        F.col("confidence_text").alias("confidence"),
        number(pred + F.lit(p10)).alias("band_lower"), number(pred + F.lit(p90)).alias("band_upper"),
        number(F.lit(fixed.ERROR_BAND_LEVEL)).alias("band_level"),
        surge.recommendation(pred, F.col("precip")).alias("recommendation"), "defaults_used")
