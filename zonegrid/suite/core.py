"""Core and series queries: sources, binning, counts, imbalance, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import add_calendar_and_rush_features
from ..functions.zones import add_zone_hint_features
from ..operators import bins, series
from .base import (BASE, FEATURE_COLS, FEATURE_DOUBLES, P, SQL_CALENDAR_COLS, SQL_FEATURES,
                   SQL_SERIES, SQL_ZONE_COLS, cte, final_sql, per_session, register, rounded, trips)
from ..sources import testdata as td


@per_session
def cells(spark, sf_dir):
    return bins.imbalance(trips(spark, sf_dir), P.bin_minutes, P.supply_time)


@register("trips_union", final_sql(
    cte(td.SQL_TRIPS, "result AS (SELECT * FROM trips)"),
    ["pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID"]))
def q_trips_union(spark, sf_dir):
    return trips(spark, sf_dir)


@register("time_bins", final_sql(
    cte(td.SQL_TRIPS, """result AS (
      SELECT pickup_datetime, PULocationID, time_bucket(INTERVAL 15 MINUTE, pickup_datetime) AS Time_Bin
      FROM trips)"""),
    ["pickup_datetime", "PULocationID", "Time_Bin"]))
def q_time_bins(spark, sf_dir):
    t = trips(spark, sf_dir)
    return t.select("pickup_datetime", "PULocationID",
                    bins.time_bin(F.col("pickup_datetime"), P.bin_minutes).alias("Time_Bin"))


@register("demand", final_sql(
    cte(*BASE, "result AS (SELECT Time_Bin, Zone, n AS ActiveRequests FROM de)"),
    ["Time_Bin", "Zone", "ActiveRequests"]))
def q_demand(spark, sf_dir):
    return bins.demand_counts(trips(spark, sf_dir), P.bin_minutes)


@register("supply", final_sql(
    cte(*BASE, "result AS (SELECT Time_Bin, Zone, n AS AvailableDriversProxy FROM su)"),
    ["Time_Bin", "Zone", "AvailableDriversProxy"]))
def q_supply(spark, sf_dir):
    return bins.supply_counts(trips(spark, sf_dir), P.bin_minutes)


_IMB_COLS = ["Zone", "Time_Bin", "ActiveRequests", "AvailableDriversProxy", "SupplyElasticity", "DER_t"]
_IMB_SQL = final_sql(cte(*BASE, "result AS (SELECT * FROM imb)"), _IMB_COLS, FEATURE_DOUBLES)


@register("imbalance", _IMB_SQL)
def q_imbalance(spark, sf_dir):
    return rounded(cells(spark, sf_dir))


@register("imbalance_outer", _IMB_SQL)
def q_imbalance_outer(spark, sf_dir):
    return rounded(bins.imbalance_outer(trips(spark, sf_dir), P.bin_minutes))


_TL = ["Zone", "Time_Bin", "DER_t", "Target_DER_t+15", "Lag_DER_t-15", "Lag_DER_t-30"]


@register("target_lags", final_sql(cte(*BASE, SQL_SERIES, "result AS (SELECT * FROM ser)"), _TL, FEATURE_DOUBLES))
def q_target_lags(spark, sf_dir):
    out = series.series_features(cells(spark, sf_dir), P.series_chunk_days,
                                 which={"Target_DER_t+15", "Lag_DER_t-15", "Lag_DER_t-30"})
    return rounded(out.select(*[F.col(f"`{c}`") for c in _TL]))


_VEL = ["Zone", "Time_Bin", "ActiveRequests", "DemandVelocity_t", "Lag_DemandVelocity_t-15"]


@register("velocity", final_sql(cte(*BASE, SQL_SERIES, "result AS (SELECT * FROM ser)"), _VEL, FEATURE_DOUBLES))
def q_velocity(spark, sf_dir):
    out = series.series_features(cells(spark, sf_dir), P.series_chunk_days,
                                 which={"DemandVelocity_t", "Lag_DemandVelocity_t-15"})
    return rounded(out.select(*[F.col(f"`{c}`") for c in _VEL]))


_ROLL = ["Zone", "Time_Bin", "DER_t", "DER_rolling_mean_1h", "DER_rolling_std_1h"]


@register("rolling", final_sql(cte(*BASE, SQL_SERIES, "result AS (SELECT * FROM ser)"), _ROLL, FEATURE_DOUBLES))
def q_rolling(spark, sf_dir):
    out = series.series_features(cells(spark, sf_dir), P.series_chunk_days,
                                 which={"DER_rolling_mean_1h", "DER_rolling_std_1h"})
    return rounded(out.select(*[F.col(f"`{c}`") for c in _ROLL]))


_CAL = ["Zone", "Time_Bin", "month", "month_sin", "month_cos", "is_rush_hour", "is_holiday"]


@register("calendar", final_sql(
    cte(*BASE, f"result AS (SELECT Zone, Time_Bin, {SQL_CALENDAR_COLS} FROM imb)"), _CAL, FEATURE_DOUBLES))
def q_calendar(spark, sf_dir):
    c = cells(spark, sf_dir).select("Zone", "Time_Bin")
    return rounded(add_calendar_and_rush_features(c, "Time_Bin", P.holidays).select(*_CAL))


_ZF = ["Zone", "Time_Bin", "is_airport_zone", "is_manhattan_core"]


@register("zone_flags", final_sql(
    cte(*BASE, f"result AS (SELECT Zone, Time_Bin, {SQL_ZONE_COLS} FROM imb)"), _ZF))
def q_zone_flags(spark, sf_dir):
    c = cells(spark, sf_dir).select("Zone", "Time_Bin")
    return add_zone_hint_features(c, "Zone").select(*_ZF)


@per_session
def feature_table(spark, sf_dir):
    return series.feature_table(cells(spark, sf_dir), P.holidays, P.series_chunk_days)


@register("feature_table", final_sql(
    cte(*BASE, SQL_SERIES, SQL_FEATURES, "result AS (SELECT * FROM feat)"), FEATURE_COLS, FEATURE_DOUBLES))
def q_feature_table(spark, sf_dir):
    return rounded(feature_table(spark, sf_dir))
