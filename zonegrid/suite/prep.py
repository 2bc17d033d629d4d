"""Split / quality / sink / weather / training-matrix queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .. import fixed
from ..functions.calendar import add_cyclical_features
from ..operators import matrix, split, weather
from ..sources import sinks
from ..sources import testdata as td
from .base import (BASE, FEATURE_COLS, FEATURE_DOUBLES, P, SQL_FEATURES, SQL_SERIES, cte, final_sql,
                   per_session, register, rounded)
from .core import cells, feature_table

SQL_SPLIT = f"""
spl AS (
  SELECT *, CASE WHEN Time_Bin < TIMESTAMP '{P.split_date}' THEN 'train'
                 WHEN Time_Bin >= TIMESTAMP '{P.split_date}' THEN 'test' END AS split
  FROM feat),
kept AS (
  SELECT * FROM spl
  WHERE split IS NOT NULL AND "Target_DER_t+15" IS NOT NULL
    AND DER_t BETWEEN {P.der_outlier_lower} AND {P.der_outlier_upper}
    AND "Target_DER_t+15" BETWEEN {P.der_outlier_lower} AND {P.der_outlier_upper})"""

SQL_WEATHER_15 = """
wobs AS (SELECT station, ts, temp, precip, lead(ts) OVER (PARTITION BY station ORDER BY ts) AS nxt
         FROM weather_hourly WHERE ts IS NOT NULL),
wrng AS (SELECT station, temp, precip,
           CASE WHEN time_bucket(INTERVAL 15 MINUTE, ts) = ts THEN ts
                ELSE time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE END AS s,
           time_bucket(INTERVAL 15 MINUTE,
                       coalesce(nxt - INTERVAL 1 MICROSECOND, ts + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND)) AS e
         FROM wobs),
w15 AS (SELECT station, unnest(generate_series(s, e, INTERVAL 15 MINUTE)) AS Time_Bin, temp, precip
        FROM wrng WHERE s <= e)"""

SQL_JOINED = """
joined AS (
  SELECT kept.*, w15.temp, w15.precip FROM kept LEFT JOIN w15 ON kept.Time_Bin = w15.Time_Bin),
cyc AS (
  SELECT *, CAST(hour(Time_Bin) AS INTEGER) AS hour,
         sin(2 * pi() * hour(Time_Bin) / 24) AS hour_sin,
         cos(2 * pi() * hour(Time_Bin) / 24) AS hour_cos,
         CAST(isodow(Time_Bin) - 1 AS INTEGER) AS day_of_week,
         CASE WHEN isodow(Time_Bin) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend
  FROM joined)"""

MODEL_FEATURES = [
    "DER_rolling_mean_1h", "DER_rolling_std_1h", "DemandVelocity_t", "Lag_DER_t-15", "Lag_DER_t-30",
    "Lag_DemandVelocity_t-15", "SupplyElasticity", "Zone", "day_of_week", "hour_cos", "hour_sin",
    "is_airport_zone", "is_holiday", "is_manhattan_core", "is_rush_hour", "is_weekend", "month",
    "month_cos", "month_sin", "precip", "temp",
]
CYC_DOUBLES = FEATURE_DOUBLES | {"temp", "precip", "hour_sin", "hour_cos"}
SQL_MATRIX = "mat AS (SELECT * FROM cyc WHERE " + " AND ".join(
    f'"{c}" IS NOT NULL AND NOT isnan(CAST("{c}" AS DOUBLE))' for c in [*MODEL_FEATURES, fixed.TARGET]) + ")"

PREP = [*BASE, SQL_SERIES, SQL_FEATURES, SQL_SPLIT]


@per_session
def split_rows(spark, sf_dir):
    return split.split_filtered(feature_table(spark, sf_dir), P)


@per_session
def weather_15(spark, sf_dir, align="exact"):
    hourly = td.weather_hourly(td.table(spark, sf_dir, "events"))
    return weather.upsample(hourly, align, P.series_chunk_days)


@per_session
def training_rows(spark, sf_dir):
    """(filtered feature rows + weather + hour/day features, null-free, 21 features)."""
    return matrix.training_matrix(split_rows(spark, sf_dir), weather_15(spark, sf_dir))


@register("split_counts", final_sql(cte(*PREP, """result AS (
    SELECT split, count(*) AS n_rows, count("Target_DER_t+15") AS n_with_target,
           count(*) FILTER (WHERE "Target_DER_t+15" IS NOT NULL
                AND DER_t BETWEEN {lo} AND {hi} AND "Target_DER_t+15" BETWEEN {lo} AND {hi}) AS n_kept
    FROM spl WHERE split IS NOT NULL GROUP BY split)""".format(lo=P.der_outlier_lower, hi=P.der_outlier_upper)),
    ["split", "n_rows", "n_with_target", "n_kept"]))
def q_split_counts(spark, sf_dir):
    return split.split_counts(feature_table(spark, sf_dir), P)


_SPLIT_COLS = [*FEATURE_COLS, "split"]


@register("split_filtered", final_sql(cte(*PREP, "result AS (SELECT * FROM kept)"), _SPLIT_COLS, FEATURE_DOUBLES))
def q_split_filtered(spark, sf_dir):
    return rounded(split_rows(spark, sf_dir))


@register("split_active", final_sql(cte(*PREP, "result AS (SELECT * FROM kept WHERE ActiveRequests >= 2)"),
                                   _SPLIT_COLS, FEATURE_DOUBLES))
def q_split_active(spark, sf_dir):
    """P10 with a threshold that drops rows."""
    return rounded(split.split_filtered(feature_table(spark, sf_dir), replace(P, min_active_requests=2)))


@register("quality_audit", final_sql(cte(*PREP, """result AS (
    SELECT split, count(*) AS n_rows, count(Time_Bin) AS n_time, '' AS missing_columns,
           count(*) > 0 AND count(Time_Bin) > 0 AS ok
    FROM kept GROUP BY split)"""), ["split", "n_rows", "n_time", "missing_columns", "ok"]))
def q_quality_audit(spark, sf_dir):
    return split.quality_audit(split_rows(spark, sf_dir), "split")


@register("agg_roundtrip", final_sql(cte(*BASE, """result AS (
    SELECT *, strftime(Time_Bin, '%Y-%m') AS month_key FROM imb)"""),
    ["Zone", "Time_Bin", "ActiveRequests", "AvailableDriversProxy", "SupplyElasticity", "DER_t", "month_key"],
    FEATURE_DOUBLES))
def q_agg_roundtrip(spark, sf_dir):
    path = sinks.run_path(spark, "aggregated")
    sinks.write_aggregate_checkpoint(cells(spark, sf_dir), path)
    return rounded(sinks.read_aggregate_checkpoint(spark, path))


@register("weather_hourly", final_sql(cte(td.SQL_WEATHER_HOURLY, "result AS (SELECT * FROM weather_hourly)"),
                                      ["station", "ts", "temp", "precip"], {"temp", "precip"}))
def q_weather_hourly(spark, sf_dir):
    return rounded(td.weather_hourly(td.table(spark, sf_dir, "events")))


@register("weather_upsample", final_sql(cte(td.SQL_WEATHER_HOURLY, SQL_WEATHER_15, "result AS (SELECT * FROM w15)"),
                                        ["station", "Time_Bin", "temp", "precip"], {"temp", "precip"}))
def q_weather_upsample(spark, sf_dir):
    return rounded(weather_15(spark, sf_dir))


SQL_WEATHER_STRETCHED = """
ws AS (SELECT station, ts AS ts0, temp, precip,
              row_number() OVER (PARTITION BY station ORDER BY ts) - 1 AS i,
              count(*) OVER (PARTITION BY station) AS n,
              min(ts) OVER (PARTITION BY station) AS t0, max(ts) OVER (PARTITION BY station) AS t1
       FROM weather_hourly WHERE ts IS NOT NULL),
wst AS (SELECT station, temp, precip,
               CASE WHEN n > 1 THEN t0 + to_microseconds((i * (epoch_us(t1 + INTERVAL 1 HOUR) - epoch_us(t0))) // (n - 1))
                    ELSE ts0 END AS ts
        FROM ws),
wso AS (SELECT station, ts, temp, precip, lead(ts) OVER (PARTITION BY station ORDER BY ts) AS nxt FROM wst),
wsr AS (SELECT station, temp, precip,
               CASE WHEN time_bucket(INTERVAL 15 MINUTE, ts) = ts THEN ts
                    ELSE time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE END AS s,
               time_bucket(INTERVAL 15 MINUTE, coalesce(nxt - INTERVAL 1 MICROSECOND, ts)) AS e
        FROM wso),
result AS (SELECT station, unnest(generate_series(s, e, INTERVAL 15 MINUTE)) AS Time_Bin, temp, precip
           FROM wsr WHERE s <= e)"""


@register("weather_upsample_stretched", final_sql(cte(td.SQL_WEATHER_HOURLY, SQL_WEATHER_STRETCHED),
                                                  ["station", "Time_Bin", "temp", "precip"], {"temp", "precip"}))
def q_weather_upsample_stretched(spark, sf_dir):
    """Parity mode of the original placement: n values spread evenly over [first, last + 1h]."""
    return rounded(weather_15(spark, sf_dir, "stretched"))


_JOIN_COLS = [*_SPLIT_COLS, "temp", "precip"]


@register("weather_join", final_sql(cte(*PREP, td.SQL_WEATHER_HOURLY, SQL_WEATHER_15, SQL_JOINED,
                                        "result AS (SELECT * FROM joined)"), _JOIN_COLS, CYC_DOUBLES))
def q_weather_join(spark, sf_dir):
    return rounded(weather.join_weather(split_rows(spark, sf_dir), weather_15(spark, sf_dir)).select(*_JOIN_COLS))


@register("weather_window", final_sql(cte(td.SQL_WEATHER_WINDOW, SQL_WEATHER_15, "result AS (SELECT * FROM w15)"),
                                      ["station", "Time_Bin", "temp", "precip"], {"temp", "precip"}))
def q_weather_window(spark, sf_dir):
    """S7 with a date window that leaves out some of the observations."""
    hourly = weather.in_window(td.weather_hourly(td.table(spark, sf_dir, "events")), "2024-01-05", "2024-01-20")
    return rounded(weather.upsample(hourly, "exact", P.series_chunk_days).select("station", "Time_Bin", "temp", "precip"))


@register("weather_by_place", final_sql(cte(*PREP, td.SQL_WEATHER_STATIONS, SQL_WEATHER_15, """
    zn AS (SELECT Zone, 40.5 + Zone / 500 AS lat, -74.2 + (Zone % 20) / 40 AS lon FROM (SELECT DISTINCT Zone FROM kept)),
    near AS (SELECT Zone, CASE WHEN
        pow(lat - 40.64, 2) + pow((lon + 73.78) * cos(radians(lat)), 2)
        <= pow(lat - 40.78, 2) + pow((lon + 74.17) * cos(radians(lat)), 2) THEN 'east' ELSE 'west' END AS station FROM zn),
    result AS (SELECT kept.*, w15.temp, w15.precip FROM kept JOIN near USING (Zone)
               LEFT JOIN w15 ON w15.station = near.station AND w15.Time_Bin = kept.Time_Bin)"""), _JOIN_COLS, CYC_DOUBLES))
def q_weather_by_place(spark, sf_dir):
    """J2 with two stations: each zone has the weather of the nearer one."""
    events, rows = td.table(spark, sf_dir, "events"), split_rows(spark, sf_dir)
    grid = weather.upsample(td.weather_by_station(events), "exact", P.series_chunk_days)
    places = weather.nearest_stations(td.zone_positions(rows), list(td.STATIONS))
    return rounded(weather.join_weather(rows, grid, by_zone=places).select(*_JOIN_COLS))


_CYC_COLS = [*_JOIN_COLS, "hour", "hour_sin", "hour_cos", "day_of_week", "is_weekend"]


@register("cyclical", final_sql(cte(*PREP, td.SQL_WEATHER_HOURLY, SQL_WEATHER_15, SQL_JOINED,
                                    "result AS (SELECT * FROM cyc)"), _CYC_COLS, CYC_DOUBLES))
def q_cyclical(spark, sf_dir):
    joined = weather.join_weather(split_rows(spark, sf_dir), weather_15(spark, sf_dir))
    return rounded(add_cyclical_features(joined, "Time_Bin").select(*_CYC_COLS))


_MAT_COLS = ["split", "Time_Bin", *MODEL_FEATURES, fixed.TARGET]


@register("training_matrix", final_sql(cte(*PREP, td.SQL_WEATHER_HOURLY, SQL_WEATHER_15, SQL_JOINED, SQL_MATRIX,
                                           "result AS (SELECT * FROM mat)"), _MAT_COLS, CYC_DOUBLES))
def q_training_matrix(spark, sf_dir):
    rows, feats = training_rows(spark, sf_dir)
    assert feats == MODEL_FEATURES, feats
    return rounded(rows.select(*[F.col(f"`{c}`") for c in _MAT_COLS]))
