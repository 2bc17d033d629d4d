"""Scoring requests as they land: one JSON body per request.

The test request table is derived from the training-time feature rows (so it
grows with the data): every row becomes a camelCase request, and a selector
``c = (Zone * 7 + minute_of_day / 15) % 20`` corrupts some of them the ways a
client can (out-of-range ids and hours, missing or non-finite numbers, hours
as text, snake_case field names, missing optional fields, a null zone, numbers
written as Java literals).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed


def _num(c: Column) -> Column:
    """A JSON number as VARIANT (missing when NULL)."""
    return F.when(c.isNotNull(), F.parse_json(c.cast("string")))


def selector() -> Column:
    mod = F.hour("Time_Bin") * 60 + F.minute("Time_Bin")
    return ((F.col("Zone") * 7 + F.floor(mod / 15)) % 20).cast("int")


def request_bodies(rows: DataFrame) -> DataFrame:
    """(request_id, body) from rows holding the training-time feature columns."""
    c = F.col("_c")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    fields = {
        "zoneId": F.when(c == 0, F.lit(264)).when(c == 1, F.lit(0)).when(c == 2, F.lit(None))
        .otherwise(F.col("Zone")),
        "supplyElasticity": F.col("SupplyElasticity"),
        "lagDER15": F.col("`Lag_DER_t-15`"),
        "lagDER30": F.col("`Lag_DER_t-30`"),
        "demandVelocity": F.col("DemandVelocity_t"),
        "lagDemandVelocity15": F.col("`Lag_DemandVelocity_t-15`"),
        "temp": F.when(c == 3, F.lit(None))
        .when((c == 19) & (F.col("hour") % 2 == 0), F.parse_json(F.lit('"1.0d"')))
        .when(c == 19, F.parse_json(F.lit('"0x10p0"'))).otherwise(_num(F.col("temp"))),
        "precip": F.when(c == 4, nan).when(c == 5, inf).otherwise(F.col("precip")),
        "hour": F.when(c == 6, _num(F.lit(24))).when(c == 7, _num(F.lit(-1)))
        .when(c == 8, _num(F.lit("7.9"))).when(c == 9, F.parse_json(F.lit('"7.9"')))
        .when(c == 10, F.parse_json(F.lit('"7"'))).otherwise(_num(F.col("hour"))),
        "dayOfWeek": F.when(c == 11, F.lit(7)).otherwise(F.col("day_of_week")),
        "month": F.when(c == 12, F.lit(13)).when(c == 13, F.lit(None)).otherwise(F.col("month")),
        "isHoliday": F.when(c == 14, F.lit(None)).otherwise(F.col("is_holiday") == 1),
        "derRollingMean1h": F.when(c == 15, F.lit(None)).otherwise(F.col("DER_rolling_mean_1h")),
        "derRollingStd1h": F.when(c == 16, F.lit(None)).otherwise(F.col("DER_rolling_std_1h")),
    }
    snake = dict(fixed.REQUEST_FLOAT_FIELDS + tuple((a, b) for a, b, *_ in fixed.REQUEST_INT_FIELDS)
                 + fixed.REQUEST_OPTIONAL_FIELDS)
    camel_body = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    snake_body = F.to_json(F.struct(*[v.alias(snake[k]) for k, v in fields.items()]))
    # ``to_json`` leaves null fields out; a null zone is written by hand.
    null_zone = F.concat(F.lit('{"zoneId":null,'), F.substr(
        F.to_json(F.struct(*[v.alias(k) for k, v in fields.items() if k != "zoneId"])), F.lit(2)))
    return rows.withColumn("_c", selector()).select(
        F.concat_ws("-", F.col("Zone").cast("string"), F.date_format("Time_Bin", "yyyyMMddHHmm")).alias("request_id"),
        F.when(c == 17, snake_body).when(c == 18, null_zone).otherwise(camel_body).alias("body"),
    )
