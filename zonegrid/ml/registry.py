"""Model registry: versioned artifacts, registry records, run log.

Artifacts are Spark ML saves under ``<base>/models/version=<utc stamp>``;
"latest" is the record with the greatest ``trained_at`` (no copy needed).
Records and runs are append-only Parquet tables under the shared folder.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY_SCHEMA = (
    "version string, trained_at timestamp_ntz, artifact string, model_type string, "
    "features array<string>, target string, train_samples long, test_samples long, n_trees int, "
    "metrics map<string,double>, calibration map<string,double>, data map<string,string>, "
    "params map<string,string>"
)
RUNS_SCHEMA = ("run_id string, logged_at timestamp_ntz, params map<string,string>, "
               "metrics map<string,double>, tags map<string,string>")


def utc_stamp() -> tuple[str, dt.datetime]:
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return now.strftime("%Y%m%d_%H%M%S_%f"), now


def save_model(model, base: str, version: str) -> str:
    path = f"{base.rstrip('/')}/models/version={version}"
    model.write().overwrite().save(path)
    return path


def append_record(spark: SparkSession, base: str, record: dict) -> None:
    row = [tuple(record.get(f.split()[0]) for f in REGISTRY_SCHEMA.split(", "))]
    (spark.createDataFrame(row, REGISTRY_SCHEMA).write.mode("append").parquet(f"{base.rstrip('/')}/registry"))


def registry(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/registry")


def latest(records: DataFrame) -> DataFrame:
    """The newest record (``max_by`` over trained_at: one pass, no sort)."""
    return records.agg(F.max_by(F.struct(*records.columns), F.col("trained_at")).alias("r")).select("r.*")


def json_safe_metrics(df: DataFrame, col: str = "metrics") -> DataFrame:
    """NaN / infinite metric values become NULL."""
    clean = F.transform_values(col, lambda _k, v: F.when(F.isnan(v) | (F.abs(v) == F.lit(math.inf)), F.lit(None))
                               .otherwise(v))
    return df.withColumn(col, clean)


def log_run(spark: SparkSession, base: str, params: dict, metrics: dict, n_features: int,
            tags: dict | None = None) -> str:
    """Params as strings, finite metrics only, n_features tag and ``tags``."""
    run_id, now = utc_stamp()
    row = [(run_id, now, {k: str(v) for k, v in params.items()},
            {k: float(v) for k, v in metrics.items()}, {"n_features": str(n_features)} | (tags or {}))]
    df = spark.createDataFrame(row, RUNS_SCHEMA).withColumn(
        "metrics", F.map_filter("metrics", lambda _k, v: ~F.isnan(v) & (F.abs(v) != F.lit(math.inf))))
    df.write.mode("append").parquet(f"{base.rstrip('/')}/training_runs")
    return run_id


def runs(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/training_runs")
