"""Request and decoration queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import bounds as B
from ..functions import surge
from ..functions.calendar import add_cyclical_features
from ..operators import metrics, requests as R, weather
from ..sources import requests as reqsrc
from ..sources import testdata as td
from ..plans.scoring import landed_requests, read_landed
from ..sources.sinks import run_path
from .base import P, cte, final_sql, per_session, register, rounded
from .core import feature_table
from .evaluate import MAT, SQL_PRED, persistence
from .prep import PREP, SQL_JOINED, SQL_WEATHER_15, split_rows, weather_15

CYC = [*PREP, td.SQL_WEATHER_HOURLY, SQL_WEATHER_15, SQL_JOINED]


@per_session
def cyc_rows(spark, sf_dir):
    return add_cyclical_features(weather.join_weather(split_rows(spark, sf_dir), weather_15(spark, sf_dir)),
                                 "Time_Bin")


_BODIES: dict = {}


def landed_bodies(spark, sf_dir):
    """Request bodies as they land (JSON text files' content), derived from the
    feature rows once per session and written to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BODIES:
        path = run_path(spark, "request-bodies")
        reqsrc.request_bodies(cyc_rows(spark, sf_dir)).write.mode("overwrite").parquet(path)
        _BODIES[key] = path
    return spark.read.parquet(_BODIES[key])


def validated(spark, sf_dir):
    return R.validate(landed_bodies(spark, sf_dir))


def valid_requests(spark, sf_dir):
    """Valid requests from the landed validation table (see plans.scoring)."""
    path = landed_requests(spark, f"requests:{sf_dir}", lambda: validated(spark, sf_dir))
    return read_landed(spark, path, valid=True)


_FLOATS = ["supply_elasticity", "lag_der_15", "lag_der_30", "demand_velocity", "lag_demand_velocity_15",
           "temp", "precip", "der_rolling_mean_1h", "der_rolling_std_1h"]

SQL_REQUESTS = """
req AS (
  SELECT CAST(Zone AS VARCHAR) || '-' || strftime(Time_Bin, '%Y%m%d%H%M') AS request_id,
         CAST((Zone * 7 + (hour(Time_Bin) * 60 + minute(Time_Bin)) // 15) % 20 AS INTEGER) AS c, *
  FROM cyc),
val AS (
  SELECT request_id, c,
    CAST(CASE c WHEN 0 THEN 264 WHEN 1 THEN 0 WHEN 2 THEN 161 WHEN 18 THEN 161 ELSE Zone END AS BIGINT) AS zone_id,
    SupplyElasticity AS supply_elasticity, "Lag_DER_t-15" AS lag_der_15, "Lag_DER_t-30" AS lag_der_30,
    DemandVelocity_t AS demand_velocity, "Lag_DemandVelocity_t-15" AS lag_demand_velocity_15,
    CASE WHEN c IN (3, 19) THEN NULL ELSE temp END AS temp,
    CASE c WHEN 4 THEN 'NaN'::DOUBLE WHEN 5 THEN 'Infinity'::DOUBLE ELSE precip END AS precip,
    CAST(CASE c WHEN 6 THEN 24 WHEN 7 THEN -1 WHEN 8 THEN 7 WHEN 9 THEN NULL WHEN 10 THEN 7 ELSE hour END AS INTEGER) AS hour,
    CAST(CASE WHEN c = 11 THEN 7 ELSE day_of_week END AS INTEGER) AS day_of_week,
    CAST(CASE c WHEN 12 THEN 13 WHEN 13 THEN NULL ELSE month END AS INTEGER) AS month,
    CASE WHEN c = 14 THEN NULL ELSE is_holiday = 1 END AS is_holiday,
    CASE WHEN c = 15 THEN NULL ELSE DER_rolling_mean_1h END AS der_rolling_mean_1h,
    CASE WHEN c = 16 THEN NULL ELSE DER_rolling_std_1h END AS der_rolling_std_1h
  FROM req),
rs AS (
  SELECT *, list_filter([
    CASE WHEN supply_elasticity IS NULL THEN 'supplyElasticity: field required'
         WHEN NOT isfinite(supply_elasticity) THEN 'supplyElasticity: must be a finite number' END,
    CASE WHEN lag_der_15 IS NULL THEN 'lagDER15: field required'
         WHEN NOT isfinite(lag_der_15) THEN 'lagDER15: must be a finite number' END,
    CASE WHEN lag_der_30 IS NULL THEN 'lagDER30: field required'
         WHEN NOT isfinite(lag_der_30) THEN 'lagDER30: must be a finite number' END,
    CASE WHEN demand_velocity IS NULL THEN 'demandVelocity: field required'
         WHEN NOT isfinite(demand_velocity) THEN 'demandVelocity: must be a finite number' END,
    CASE WHEN lag_demand_velocity_15 IS NULL THEN 'lagDemandVelocity15: field required'
         WHEN NOT isfinite(lag_demand_velocity_15) THEN 'lagDemandVelocity15: must be a finite number' END,
    CASE WHEN c = 19 THEN 'temp: must be a number' WHEN temp IS NULL THEN 'temp: field required'
         WHEN NOT isfinite(temp) THEN 'temp: must be a finite number' END,
    CASE WHEN precip IS NULL THEN 'precip: field required'
         WHEN NOT isfinite(precip) THEN 'precip: must be a finite number' END,
    CASE WHEN c = 9 THEN 'hour: must be an integer' WHEN hour IS NULL THEN 'hour: field required'
         WHEN hour NOT BETWEEN 0 AND 23 THEN 'hour: must be between 0 and 23' END,
    CASE WHEN day_of_week IS NULL THEN 'dayOfWeek: field required'
         WHEN day_of_week NOT BETWEEN 0 AND 6 THEN 'dayOfWeek: must be between 0 and 6' END,
    CASE WHEN c = 18 THEN 'zoneId: must be an integer' WHEN zone_id NOT BETWEEN 1 AND 263 THEN 'zoneId: must be between 1 and 263' END,
    CASE WHEN month NOT BETWEEN 1 AND 12 THEN 'month: must be between 1 and 12' END
  ], lambda x: x IS NOT NULL) AS reasons
  FROM val),
validated AS (
  SELECT request_id, len(reasons) = 0 AS valid, reasons, zone_id, supply_elasticity, lag_der_15, lag_der_30,
         demand_velocity, lag_demand_velocity_15, temp, precip, hour, day_of_week, month, is_holiday,
         der_rolling_mean_1h, der_rolling_std_1h
  FROM rs)"""


@register("validate_requests", final_sql(cte(*CYC, SQL_REQUESTS, "result AS (SELECT * FROM validated)"),
                                         R.VALIDATED_COLUMNS, set(_FLOATS)))
def q_validate_requests(spark, sf_dir):
    return rounded(validated(spark, sf_dir))


_RF_DOUBLES = set(R.INFERENCE_FEATURES)
SQL_REQ_FEATURES = """
rf AS (
  SELECT request_id,
    supply_elasticity AS SupplyElasticity, lag_der_15 AS "Lag_DER_t-15", lag_der_30 AS "Lag_DER_t-30",
    demand_velocity AS DemandVelocity_t, lag_demand_velocity_15 AS "Lag_DemandVelocity_t-15",
    temp, precip,
    sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos,
    CAST(day_of_week AS DOUBLE) AS day_of_week,
    CASE WHEN day_of_week >= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_weekend,
    coalesce(der_rolling_mean_1h, lag_der_15) AS DER_rolling_mean_1h,
    coalesce(der_rolling_std_1h, 0.0) AS DER_rolling_std_1h,
    CAST(least(greatest(coalesce(month, 1), 1), 12) AS DOUBLE) AS month,
    sin(2 * pi() * (least(greatest(coalesce(month, 1), 1), 12) - 1) / 12) AS month_sin,
    cos(2 * pi() * (least(greatest(coalesce(month, 1), 1), 12) - 1) / 12) AS month_cos,
    CASE WHEN hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 19 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_rush_hour,
    CASE WHEN coalesce(is_holiday, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_holiday,
    CASE WHEN zone_id IN (1, 132, 138, 244) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_airport_zone,
    CASE WHEN zone_id BETWEEN 4 AND 12 OR zone_id BETWEEN 43 AND 81
              OR zone_id IN (161, 162, 163, 164, 170, 186, 234, 237) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_manhattan_core,
    CAST(zone_id AS DOUBLE) AS Zone,
    list_filter([CASE WHEN month IS NULL THEN 'month' END, CASE WHEN is_holiday IS NULL THEN 'isHoliday' END,
                 CASE WHEN der_rolling_mean_1h IS NULL THEN 'derRollingMean1h' END,
                 CASE WHEN der_rolling_std_1h IS NULL THEN 'derRollingStd1h' END], lambda x: x IS NOT NULL) AS defaults_used
  FROM validated WHERE valid)"""


@register("request_features", final_sql(cte(*CYC, SQL_REQUESTS, SQL_REQ_FEATURES, "result AS (SELECT * FROM rf)"),
                                        ["request_id", *R.INFERENCE_FEATURES, "defaults_used"], _RF_DOUBLES))
def q_request_features(spark, sf_dir):
    return rounded(R.request_features(valid_requests(spark, sf_dir)))


def _sql_level(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 0.8 THEN 'Low Demand' WHEN {x} < 1.2 THEN 'Normal' "
            f"WHEN {x} < 1.5 THEN 'Moderate Surge' WHEN {x} < 2.0 THEN 'High Surge' ELSE 'Extreme Surge' END")


@register("surge_level", final_sql(cte(*PREP, f"""result AS (
    SELECT Zone, Time_Bin, DER_t, {_sql_level('DER_t')} AS surge_level,
           {_sql_level('"Target_DER_t+15"')} AS target_level FROM feat)"""),
    ["Zone", "Time_Bin", "DER_t", "surge_level", "target_level"], {"DER_t"}))
def q_surge_level(spark, sf_dir):
    f = feature_table(spark, sf_dir)
    return rounded(f.select("Zone", "Time_Bin", "DER_t", surge.surge_level(F.col("DER_t")).alias("surge_level"),
                            surge.surge_level(F.col("`Target_DER_t+15`")).alias("target_level")))


@register("surge_level_rolling", final_sql(cte(*PREP, f"""result AS (
    SELECT Zone, Time_Bin, DER_rolling_mean_1h, {_sql_level('DER_rolling_mean_1h')} AS surge_level FROM feat)"""),
    ["Zone", "Time_Bin", "DER_rolling_mean_1h", "surge_level"], {"DER_rolling_mean_1h"}))
def q_surge_level_rolling(spark, sf_dir):
    """Levels of the rolling mean, which takes values between the whole ratios."""
    mean = F.col("DER_rolling_mean_1h")
    return rounded(feature_table(spark, sf_dir).select("Zone", "Time_Bin", mean,
                                                       surge.surge_level(mean).alias("surge_level")))


_SQL_RECO = """CASE WHEN DER_t IS NULL THEN NULL
  WHEN DER_t < 0.8 THEN 'Supply exceeds demand. Consider reducing active driver incentives.'
  WHEN DER_t < 1.2 THEN 'Balanced market conditions. Maintain current operations.'
  WHEN DER_t < 1.5 THEN 'Moderate demand pressure. Consider 1.2-1.4x surge pricing.'
  WHEN DER_t < 2.0 THEN 'Activate surge pricing (1.5-1.8x) and send driver alerts.'
       || CASE WHEN precip > 1 THEN ' Rain detected - expect sustained high demand.' ELSE '' END
  ELSE 'Extreme surge conditions. Implement maximum pricing (2.0x+) and emergency driver activation.' END"""


@register("recommendation", final_sql(cte(*CYC, f"result AS (SELECT Zone, Time_Bin, DER_t, precip, {_SQL_RECO} AS recommendation FROM joined)"),
                                      ["Zone", "Time_Bin", "DER_t", "precip", "recommendation"], {"DER_t", "precip"}))
def q_recommendation(spark, sf_dir):
    j = weather.join_weather(split_rows(spark, sf_dir), weather_15(spark, sf_dir))
    return rounded(j.select("Zone", "Time_Bin", "DER_t", "precip",
                            surge.recommendation(F.col("DER_t"), F.col("precip")).alias("recommendation")))


@register("recommendation_rolling", final_sql(cte(*CYC, f"""result AS (
    SELECT Zone, Time_Bin, DER_rolling_mean_1h, precip,
           {_SQL_RECO.replace('DER_t', 'DER_rolling_mean_1h')} AS recommendation FROM joined)"""),
    ["Zone", "Time_Bin", "DER_rolling_mean_1h", "precip", "recommendation"], {"DER_rolling_mean_1h", "precip"}))
def q_recommendation_rolling(spark, sf_dir):
    """F10 on the rolling mean, whose values reach every branch, the rain text too."""
    j = weather.join_weather(split_rows(spark, sf_dir), weather_15(spark, sf_dir))
    mean = F.col("DER_rolling_mean_1h")
    return rounded(j.select("Zone", "Time_Bin", mean, "precip",
                            surge.recommendation(mean, F.col("precip")).alias("recommendation")))


@register("error_band", final_sql(cte(*MAT, SQL_PRED, """
    cal AS (SELECT quantile_cont(y_true - y_pred, 0.1) AS p10, quantile_cont(y_true - y_pred, 0.9) AS p90
            FROM pred WHERE split = 'test'),
    result AS (SELECT Zone, Time_Bin, y_pred, y_pred + p10 AS lower, y_pred + p90 AS upper, CAST(0.8 AS DOUBLE) AS nominal_level
               FROM pred, cal WHERE split = 'test')"""),
    ["Zone", "Time_Bin", "y_pred", "lower", "upper", "nominal_level"], {"y_pred", "lower", "upper", "nominal_level"}))
def q_error_band(spark, sf_dir):
    test = persistence(spark, sf_dir).where(F.col("split") == "test")
    cal = metrics.residual_calibration(test).first()  # one row: the model's calibration record
    return rounded(test.select("Zone", "Time_Bin", *surge_band(cal)))


def surge_band(cal) -> list:
    """prediction + p10 / p90 of holdout residuals; NULL when uncalibrated."""
    p10 = None if cal is None else cal["p10"]
    p90 = None if cal is None else cal["p90"]
    pred = F.col("y_pred")
    ok = p10 is not None and p90 is not None
    return [pred.alias("y_pred"),
            (pred + F.lit(p10) if ok else F.lit(None).cast("double")).alias("lower"),
            (pred + F.lit(p90) if ok else F.lit(None).cast("double")).alias("upper"),
            F.lit(0.8 if ok else None).cast("double").alias("nominal_level")]


_CLAMP_COLS = ["request_id", *B.FIELD_COLUMNS]


# The bounds of the original's form, with the outlier limits of the test parameters.
SQL_BOUNDS = """
bnd(field, min, max, step) AS (VALUES
  ('zoneId', 1.0::DOUBLE, 263.0::DOUBLE, NULL::DOUBLE), ('hour', 0.0, 23.0, NULL), ('dayOfWeek', 0.0, 6.0, NULL),
  ('supplyElasticity', 0.0, 10.0, 0.05), ('lagDER15', 0.01, 15.0, 0.05), ('lagDER30', 0.01, 15.0, 0.05),
  ('demandVelocity', -200.0, 200.0, 1.0), ('lagDemandVelocity15', -200.0, 200.0, 1.0),
  ('temp', -30.0, 45.0, 0.5), ('precip', 0.0, 50.0, 0.1))"""


def _sql_clamp() -> str:
    parts = []
    for name, col in B.FIELD_COLUMNS.items():
        lo, hi = (f"(SELECT {end} FROM bnd WHERE field = '{name}')" for end in ("min", "max"))
        c = f"CASE WHEN {col} IS NOT NULL THEN least({hi}, greatest({lo}, CAST({col} AS DOUBLE))) END"
        parts.append(f"CAST(floor({c} + 0.5) AS BIGINT) AS {name}" if name in ("zoneId", "hour", "dayOfWeek")
                     else f"{c} AS {name}")
    return ", ".join(parts)


@register("clamp_requests", final_sql(cte(*CYC, SQL_REQUESTS, SQL_BOUNDS,
                                          f"result AS (SELECT request_id, {_sql_clamp()} FROM validated WHERE valid)"),
                                      _CLAMP_COLS, set(B.FIELD_COLUMNS) - {"zoneId", "hour", "dayOfWeek"}))
def q_clamp_requests(spark, sf_dir):
    v = valid_requests(spark, sf_dir)
    return rounded(B.clamp_requests(v, B.default_bounds(P.der_outlier_lower, P.der_outlier_upper)))


@register("clamp_all", final_sql(cte(*CYC, SQL_REQUESTS, SQL_BOUNDS,
                                     f"result AS (SELECT request_id, {_sql_clamp()} FROM validated)"),
                                 _CLAMP_COLS, set(B.FIELD_COLUMNS) - {"zoneId", "hour", "dayOfWeek"}))
def q_clamp_all(spark, sf_dir):
    """F13 over every typed request, so that values beyond the bounds and nulls occur."""
    path = landed_requests(spark, f"requests:{sf_dir}", lambda: validated(spark, sf_dir))
    return rounded(B.clamp_requests(read_landed(spark, path, valid=None),
                                    B.default_bounds(P.der_outlier_lower, P.der_outlier_upper)))


# request field -> training-table column, for bounds observed in the data
OBSERVED = {"supplyElasticity": "SupplyElasticity", "lagDER15": "Lag_DER_t-15", "lagDER30": "Lag_DER_t-30",
            "demandVelocity": "DemandVelocity_t", "lagDemandVelocity15": "Lag_DemandVelocity_t-15",
            "temp": "temp", "precip": "precip"}


def observed_bounds(rows):
    """Override table from the data: observed min/max per numeric field."""
    aggs = []
    for name, col in OBSERVED.items():
        aggs += [F.min(F.col(f"`{col}`")).alias(f"{name}__min"), F.max(F.col(f"`{col}`")).alias(f"{name}__max")]
    stack = ", ".join(f"'{n}', `{n}__min`, `{n}__max`" for n in OBSERVED)
    observed = rows.agg(*aggs).selectExpr(f"stack({len(OBSERVED)}, {stack}) AS (field, min, max)")
    # A hundred steps over the temperatures; precipitation is bounded below only.
    return observed.select(
        "field", "min", F.when(F.col("field") != "precip", F.col("max")).alias("max"),
        F.when(F.col("field") == "temp", (F.col("max") - F.col("min")) / 100).alias("step"))


def _sql_bounds_merge() -> str:
    obs = " UNION ALL ".join(
        f"SELECT '{n}' AS field, min(\"{c}\") AS o_min, {'NULL' if n == 'precip' else f'max(\"{c}\")'} AS o_max, "
        + (f"(max(\"{c}\") - min(\"{c}\")) / 100" if n == "temp" else "CAST(NULL AS DOUBLE)") + " AS o_step FROM cyc"
        for n, c in OBSERVED.items())
    return f"""
    ovr AS ({obs}),
    result AS (
      SELECT d.field,
        CASE WHEN o.o_min IS NOT NULL AND o.o_max IS NOT NULL THEN o.o_min ELSE d.min END AS min,
        CASE WHEN o.o_min IS NOT NULL AND o.o_max IS NOT NULL THEN o.o_max ELSE d.max END AS max,
        CASE WHEN d.field IN ('zoneId', 'hour', 'dayOfWeek') THEN CAST(NULL AS DOUBLE)
             WHEN o.o_min IS NOT NULL AND o.o_max IS NOT NULL THEN coalesce(o.o_step, d.step)
             ELSE d.step END AS step
      FROM bnd d LEFT JOIN ovr o ON d.field = o.field)"""


@register("bounds_merge", final_sql(cte(*CYC, SQL_BOUNDS, _sql_bounds_merge()), ["field", "min", "max", "step"],
                                    {"min", "max", "step"}))
def q_bounds_merge(spark, sf_dir):
    defaults = B.bounds_frame(spark, P.der_outlier_lower, P.der_outlier_upper)
    return rounded(B.merge_bounds(defaults, observed_bounds(cyc_rows(spark, sf_dir))))


@register("factor_tags", final_sql(cte(*CYC, SQL_REQUESTS, """result AS (
    SELECT request_id, list_filter([
      CASE WHEN precip > 1 THEN 'Rain impact' END,
      CASE WHEN hour BETWEEN 7 AND 9 THEN 'Morning rush' END,
      CASE WHEN hour BETWEEN 17 AND 19 THEN 'Evening rush' END,
      CASE WHEN demand_velocity > 20 THEN 'High velocity' END,
      CASE WHEN supply_elasticity < 0.5 THEN 'Low supply' END], lambda x: x IS NOT NULL) AS tags
    FROM validated WHERE valid)"""), ["request_id", "tags"]))
def q_factor_tags(spark, sf_dir):
    v = valid_requests(spark, sf_dir)
    return v.select("request_id", surge.factor_tags(F.col("precip"), F.col("hour"), F.col("demand_velocity"),
                                                    F.col("supply_elasticity")).alias("tags"))


@register("factor_tags_hourly", final_sql(cte(*CYC, """hrs AS (
      SELECT date_trunc('hour', Time_Bin) AS ts, sum(ActiveRequests) AS requests, min(SupplyElasticity) AS elasticity,
             max(precip) AS precip FROM joined GROUP BY 1),
    result AS (SELECT ts, list_filter([
      CASE WHEN precip > 1 THEN 'Rain impact' END,
      CASE WHEN hour(ts) BETWEEN 7 AND 9 THEN 'Morning rush' END,
      CASE WHEN hour(ts) BETWEEN 17 AND 19 THEN 'Evening rush' END,
      CASE WHEN velocity > 20 THEN 'High velocity' END,
      CASE WHEN elasticity < 0.5 THEN 'Low supply' END], lambda x: x IS NOT NULL) AS tags
      FROM (SELECT *, (requests - lag(requests) OVER (ORDER BY ts)) * 24 AS velocity FROM hrs))"""), ["ts", "tags"]))
def q_factor_tags_hourly(spark, sf_dir):
    """F16 per hour over all zones, with the change of requests per day as velocity, so
    that all tags occur. The window runs over one row an hour."""
    j = weather.join_weather(split_rows(spark, sf_dir), weather_15(spark, sf_dir))
    hours = j.groupBy(F.date_trunc("hour", "Time_Bin").cast("timestamp_ntz").alias("ts")).agg(
        F.sum("ActiveRequests").alias("requests"), F.min("SupplyElasticity").alias("elasticity"),
        F.max("precip").alias("precip"))
    velocity = (F.col("requests") - F.lag("requests").over(W.orderBy("ts"))) * 24
    return hours.withColumn("velocity", velocity).select(
        "ts", surge.factor_tags(F.col("precip"), F.hour("ts"), F.col("velocity"), F.col("elasticity")).alias("tags"))
