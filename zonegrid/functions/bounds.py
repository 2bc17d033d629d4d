"""UI bounds: the bounds table, partial overrides, clamping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed

BOUNDS_SCHEMA = "field string, min double, max double, step double"
# request field -> validated (snake_case) column
FIELD_COLUMNS = {
    "zoneId": "zone_id", "supplyElasticity": "supply_elasticity", "lagDER15": "lag_der_15",
    "lagDER30": "lag_der_30", "demandVelocity": "demand_velocity",
    "lagDemandVelocity15": "lag_demand_velocity_15", "temp": "temp", "precip": "precip",
    "hour": "hour", "dayOfWeek": "day_of_week",
}


def default_bounds(der_lower: float, der_upper: float) -> list[tuple]:
    """The bounds table; DER rows take their limits from the outlier config."""
    out = []
    for name, lo, hi, step in fixed.UI_BOUNDS:
        if lo is None:
            lo, hi = der_lower, der_upper
        out.append((name, float(lo), float(hi), None if step is None else float(step)))
    return out


def bounds_frame(spark: SparkSession, der_lower: float, der_upper: float) -> DataFrame:
    return spark.createDataFrame(default_bounds(der_lower, der_upper), BOUNDS_SCHEMA)


def merge_bounds(defaults: DataFrame, override: DataFrame) -> DataFrame:
    """Per field: the override when it has both min and max, its step falling
    back to the default step; otherwise the default. Int fields keep no step."""
    o = override.select(F.col("field"), F.col("min").alias("o_min"), F.col("max").alias("o_max"),
                        F.col("step").alias("o_step"))
    use = F.col("o_min").isNotNull() & F.col("o_max").isNotNull()
    is_int = F.col("field").isin(*fixed.INT_UI_FIELDS)
    return defaults.join(o, "field", "left").select(
        "field",
        F.when(use, F.col("o_min")).otherwise(F.col("min")).alias("min"),
        F.when(use, F.col("o_max")).otherwise(F.col("max")).alias("max"),
        F.when(is_int, F.lit(None).cast("double"))
        .when(use, F.coalesce(F.col("o_step"), F.col("step"))).otherwise(F.col("step")).alias("step"),
    )


def clamp(x: Column, lo: float, hi: float) -> Column:
    """x within [lo, hi]; NULL stays NULL (``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), x)))


def js_round(x: Column) -> Column:
    """JavaScript ``Math.round``: floor(x + 0.5)."""
    return F.floor(x + F.lit(0.5))


def clamp_requests(validated: DataFrame, bounds: list[tuple]) -> DataFrame:
    """Clamp every request field to its bounds; int fields are then rounded."""
    by_field = {b[0]: b for b in bounds}
    cols = [F.col("request_id")]
    for name, col in FIELD_COLUMNS.items():
        _, lo, hi, _step = by_field[name]
        c = clamp(F.col(col).cast("double"), lo, hi)
        cols.append((js_round(c).cast("long") if name in fixed.INT_UI_FIELDS else c).alias(name))
    return validated.select(*cols)
