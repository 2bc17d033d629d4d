"""Per-zone time-series features (W1-W8): target, lags, velocity, rolling stats.

Offsets count *observed* rows (empty bins are not filled), like the original.
All windows share one partitioning and one sort. Zones are windowed in
(zone, chunk) pieces with a halo of 3 earlier rows and 1 later row (see
:mod:`zonegrid.operators.halo`), so the result is exact and no zone is ever
held by a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.calendar import calendar_and_rush_columns
from ..functions.zones import zone_hint_columns
from . import halo

TARGET = fixed.TARGET
SERIES_COLUMNS = [
    "Target_DER_t+15", "Lag_DER_t-15", "Lag_DER_t-30", "DemandVelocity_t",
    "Lag_DemandVelocity_t-15", "DER_rolling_mean_1h", "DER_rolling_std_1h",
]
FEATURE_TABLE_COLUMNS = [
    "Zone", "Time_Bin", "ActiveRequests", "AvailableDriversProxy", "SupplyElasticity", "DER_t",
    *SERIES_COLUMNS,
    "month", "month_sin", "month_cos", "is_rush_hour", "is_holiday", "is_airport_zone",
    "is_manhattan_core",
]
ROLL_ROWS = 4  # one hour of 15-minute bins


def series_features(cells: DataFrame, chunk_days: int | None = 7, which=None) -> DataFrame:
    """Add the W1-W7 columns (or the subset ``which``) to a (Zone, Time_Bin) table."""
    data, part = halo.chunked(cells, ["Zone"], "Time_Bin", chunk_days, before=ROLL_ROWS - 1, after=1)
    w = Window.partitionBy(*part).orderBy("Time_Bin")
    roll = w.rowsBetween(-(ROLL_ROWS - 1), Window.currentRow)
    der = F.col("DER_t")
    a = F.col("ActiveRequests")
    exprs = {
        "Target_DER_t+15": F.lead(der, 1).over(w),
        "Lag_DER_t-15": F.lag(der, 1).over(w),
        "Lag_DER_t-30": F.lag(der, 2).over(w),
        "DemandVelocity_t": a - F.lag(a, 1).over(w),
        "Lag_DemandVelocity_t-15": F.lag(a, 1).over(w) - F.lag(a, 2).over(w),
        "DER_rolling_mean_1h": F.avg(der).over(roll),
        "DER_rolling_std_1h": F.coalesce(F.stddev_samp(der).over(roll), F.lit(0.0)),
    }
    names = SERIES_COLUMNS if which is None else [c for c in SERIES_COLUMNS if c in which]
    out = data.select(*cells.columns, *[exprs[n].alias(n) for n in names], "_own").where(F.col("_own"))
    return out.select(*cells.columns, *names)


def feature_table(cells: DataFrame, holidays=fixed.DEFAULT_HOLIDAYS, chunk_days: int | None = 7) -> DataFrame:
    """The whole per-row feature composition of the original pipeline."""
    out = series_features(cells, chunk_days)
    extra = {**calendar_and_rush_columns("Time_Bin", holidays), **zone_hint_columns("Zone")}
    return out.select(*[extra[c].alias(c) if c in extra else F.col(f"`{c}`") for c in FEATURE_TABLE_COLUMNS])
