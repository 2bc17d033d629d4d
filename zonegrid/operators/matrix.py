"""Model inputs: feature list by type, null drop, feature vector."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.calendar import add_cyclical_features
from .weather import join_weather


def model_feature_names(df: DataFrame) -> list[str]:
    """Numeric/boolean columns minus the exclusions, sorted by code point."""
    names = {f.name for f in df.schema.fields
             if isinstance(f.dataType, (T.NumericType, T.BooleanType))
             and f.name not in fixed.EXCLUDE_FROM_X}
    return sorted(names)


def drop_incomplete(df: DataFrame, features: list[str]) -> DataFrame:
    """Drop rows with a null *or NaN* feature or target."""
    return df.dropna(subset=[*features, fixed.TARGET])


def training_table(split_rows: DataFrame, weather_15: DataFrame, station: str = fixed.DEFAULT_STATION) -> DataFrame:
    """Filtered feature rows + weather + hour/day features (training-time columns)."""
    return add_cyclical_features(join_weather(split_rows, weather_15, station), "Time_Bin")


def training_matrix(split_rows: DataFrame, weather_15: DataFrame,
                    station: str = fixed.DEFAULT_STATION) -> tuple[DataFrame, list[str]]:
    t = training_table(split_rows, weather_15, station)
    feats = model_feature_names(t)
    return drop_incomplete(t, feats), feats


def assemble(df: DataFrame, features: list[str], label: str | None = fixed.TARGET) -> DataFrame:
    """Feature vector in manifest order (+ ``label`` double when present)."""
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    casted = df.withColumns({c: F.col(f"`{c}`").cast("double") for c in features})
    out = va.transform(casted)
    if label is not None and label in df.columns:
        out = out.withColumn("label", F.col(f"`{label}`").cast("double"))
    return out
