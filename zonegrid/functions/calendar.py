"""Calendar features as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rush_hour_flag(hour: Column) -> Column:
    cond = None
    for lo, hi in fixed.RUSH_HOURS:
        c = hour.between(lo, hi)
        cond = c if cond is None else (cond | c)
    return cond.cast("int")


def month_angle_cols(month: Column) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * (month - 1) / 12
    return F.sin(angle), F.cos(angle)


def hour_angle_cols(hour: Column) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * hour / 24
    return F.sin(angle), F.cos(angle)


def holiday_flag(ts: Column, holidays) -> Column:
    """1 when the calendar date of ``ts`` is in the holiday list (dates do not recur)."""
    dates = [F.lit(d).cast("date") for d in holidays]
    if not dates:
        return F.lit(0)
    return F.to_date(ts).isin(*dates).cast("int")


def calendar_and_rush_columns(time_col: str = "Time_Bin", holidays=fixed.DEFAULT_HOLIDAYS) -> dict[str, Column]:
    ts = F.col(time_col)
    m = F.month(ts)
    s, c = month_angle_cols(m)
    return {
        "month": m,
        "month_sin": s,
        "month_cos": c,
        "is_rush_hour": rush_hour_flag(F.hour(ts)),
        "is_holiday": holiday_flag(ts, holidays),
    }


def add_calendar_and_rush_features(df: DataFrame, time_col: str = "Time_Bin",
                                   holidays=fixed.DEFAULT_HOLIDAYS) -> DataFrame:
    return df.withColumns(calendar_and_rush_columns(time_col, holidays))


def add_cyclical_features(df: DataFrame, time_col: str = "Time_Bin") -> DataFrame:
    """hour, hour_sin, hour_cos, day_of_week (Mon=0), is_weekend."""
    ts = F.col(time_col)
    h = F.hour(ts)
    s, c = hour_angle_cols(h)
    dow = F.weekday(ts)
    return df.withColumns({
        "hour": h,
        "hour_sin": s,
        "hour_cos": c,
        "day_of_week": dow,
        "is_weekend": (dow >= fixed.WEEKEND_FROM_DOW).cast("int"),
    })


def calendar_from_parts(hour, month=None, is_holiday=None) -> dict[str, Column]:
    """Calendar features from request parts: month defaults to 1 and is clamped
    to 1..12; holiday defaults to 0."""
    hour = _col(hour)
    m = F.lit(1) if month is None else F.coalesce(_col(month).cast("int"), F.lit(1))
    m = F.least(F.greatest(m, F.lit(1)), F.lit(12))
    hol = F.lit(0) if is_holiday is None else F.coalesce(_col(is_holiday).cast("int"), F.lit(0))
    hol = F.when(hol != 0, 1).otherwise(0)
    s, c = month_angle_cols(m)
    return {
        "month": m,
        "month_sin": s,
        "month_cos": c,
        "is_rush_hour": rush_hour_flag(hour),
        "is_holiday": hol,
    }
