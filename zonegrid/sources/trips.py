"""Trip sources: scan, standardise to one schema, bag-union."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed

SOURCE_RENAMES = {"yellow": fixed.YELLOW_RENAMES, "fhvhv": {}}


def standardize(df: DataFrame, source_type: str) -> DataFrame:
    """Rename a source to the standard trip schema and keep only its 4 columns.

    The projection is pushed into the Parquet scan, so the other columns are
    never read. Ids are widened to long so both sources union cleanly.
    """
    renames = SOURCE_RENAMES[source_type]
    source_of = {v: k for k, v in renames.items() if k in df.columns}  # standard -> source name
    present = set(df.columns)
    missing = [c for c in fixed.TRIP_COLUMNS if source_of.get(c, c) not in present]
    if missing:
        raise ValueError(f"{source_type} source lacks columns {missing}")
    pickup, dropoff, pu, do = fixed.TRIP_COLUMNS
    src = lambda c: F.col(source_of.get(c, c))
    return df.select(
        src(pickup).cast("timestamp_ntz").alias(pickup),
        src(dropoff).cast("timestamp_ntz").alias(dropoff),
        src(pu).cast("long").alias(pu),
        src(do).cast("long").alias(do),
    )


def read_source(spark: SparkSession, paths: str | list[str], source_type: str) -> DataFrame | None:
    """Scan one source (a glob of monthly files); None when nothing matches."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        return None
    try:
        df = spark.read.parquet(*paths)
    except AnalysisException as e:  # PATH_NOT_FOUND / UNABLE_TO_INFER_SCHEMA
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return standardize(df, source_type)


def union_sources(frames: Iterable[DataFrame | None]) -> DataFrame:
    """UNION ALL of the standardised sources; fail when there is none."""
    frames = [f for f in frames if f is not None]
    if not frames:
        raise ValueError("there is no trip source to read")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_trips(spark: SparkSession, data_dir: str) -> DataFrame:
    """Both sources of a data folder, standardised and unioned."""
    d = data_dir.rstrip("/")
    return union_sources([
        read_source(spark, f"{d}/yellow_tripdata_*.parquet", "yellow"),
        read_source(spark, f"{d}/fhvhv_tripdata_*.parquet", "fhvhv"),
    ])
