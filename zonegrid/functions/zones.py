"""Zone hint flags (F4, F5): literal membership, evaluated in codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed


def airport_flag(zone: Column) -> Column:
    return zone.cast("long").isin(*fixed.AIRPORT_ZONES).cast("int")


def manhattan_core_flag(zone: Column) -> Column:
    z = zone.cast("long")
    cond = z.isin(*fixed.MANHATTAN_CORE_EXTRA)
    for lo, hi in fixed.MANHATTAN_CORE_RANGES:
        cond = cond | z.between(lo, hi)
    return cond.cast("int")


def zone_hint_columns(zone_col: str = "Zone") -> dict[str, Column]:
    z = F.col(zone_col)
    return {"is_airport_zone": airport_flag(z), "is_manhattan_core": manhattan_core_flag(z)}


def add_zone_hint_features(df: DataFrame, zone_col: str = "Zone") -> DataFrame:
    return df.withColumns(zone_hint_columns(zone_col))
