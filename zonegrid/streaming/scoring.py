"""Scoring as a Structured Streaming job (file source of landed request bodies).

Scoring is stateless, so each micro-batch runs the batch path through
``foreachBatch``: validate -> land (partitioned by ``valid``) -> features ->
the scoring body of ``plans.scoring`` -> write. Outputs go to
``<out>/batch_id=<n>`` with overwrite, so a replayed batch after a failure
rewrites the same folder (idempotent, exactly-once with the checkpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import requests as R
from ..plans.scoring import land_validated, read_landed, score_valid

BODY_SCHEMA = "request_id string, body string"


def start(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str, model, features: list[str],
          calibration: dict, leaves: list[list[float]], available_now: bool = True):
    """Start the stream; returns the StreamingQuery."""
    stream = spark.readStream.schema(BODY_SCHEMA).parquet(source_dir)
    out = out_dir.rstrip("/")

    def each(batch: DataFrame, batch_id: int) -> None:
        landed = f"{out}/_validated/batch_id={batch_id}"
        land_validated(R.validate(batch), landed)
        valid = read_landed(batch.sparkSession, landed, valid=True)
        (score_valid(valid, model, features, calibration, leaves)
         .write.mode("overwrite").parquet(f"{out}/scored/batch_id={batch_id}"))

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_scored(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir.rstrip('/')}/scored")
