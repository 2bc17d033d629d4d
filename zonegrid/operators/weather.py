"""Weather: hourly observations onto the 15-minute grid, and the join.

Forward fill is an as-of join: observation ``i`` holds for every grid point
in ``[ceil15(ts_i), ts_{i+1})``. With ``lead(ts)`` per station each
observation expands itself with ``explode(sequence(...))``; no range join or
per-group pandas is needed. The per-station series is windowed in day chunks
with a one-row halo (see :mod:`zonegrid.operators.halo`).

``align="exact"`` keeps hourly observations where they are and holds the last
one for its own hour. ``align="stretched"`` reproduces the original's
placement of ``n`` values evenly over ``[first, last + 1h]`` (step
``n/(n-1)`` hours), whose grid ends at the last observation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from . import halo
from .position import global_position


def _step() -> Column:
    return F.expr(f"INTERVAL {fixed.BIN_MINUTES} MINUTES")


def _floor_bin(ts: Column) -> Column:
    return F.window(ts, f"{fixed.BIN_MINUTES} minutes").start


def _ceil_bin(ts: Column) -> Column:
    f = _floor_bin(ts)
    return F.when(f == ts, f).otherwise(f + _step())


def stretch_times(hourly: DataFrame) -> DataFrame:
    """Re-time observations like ``date_range(first, last + 1h, periods=n)``."""
    pos = global_position(hourly, "ts", ["ts"], "_i", partition_keys=["station"])
    span = hourly.groupBy("station").agg(
        F.min("ts").alias("_t0"), F.max("ts").alias("_t1"), F.count(F.lit(1)).alias("_n"))
    # one row per station: joined back by key (the optimizer broadcasts it by size)
    moved = F.expr("timestampadd(MICROSECOND, "
                   "(_i * timestampdiff(MICROSECOND, _t0, _t1 + INTERVAL 1 HOUR)) div (_n - 1), _t0)")
    return pos.join(span, "station").select(
        "station", F.when(F.col("_n") > 1, moved).otherwise(F.col("ts")).alias("ts"), "temp", "precip")


def upsample(hourly: DataFrame, align: str = "exact", chunk_days: int | None = 7) -> DataFrame:
    """(station, ts, temp, precip) hourly -> (station, Time_Bin, temp, precip) every 15 min."""
    obs = hourly.where(F.col("ts").isNotNull())
    if align == "stretched":
        obs = stretch_times(obs)
    data, part = halo.chunked(obs.select("station", "ts", "temp", "precip"), ["station"], "ts",
                              chunk_days, before=0, after=1)
    w = Window.partitionBy(*part).orderBy("ts")
    nxt = F.lead("ts", 1).over(w)
    with_next = data.select("station", "ts", "temp", "precip", nxt.alias("_next"), "_own").where("_own")
    start = _ceil_bin(F.col("ts"))
    if align == "exact":
        last_end = F.col("ts") + F.expr("INTERVAL 1 HOUR") - F.expr("INTERVAL 1 MICROSECOND")
    else:  # the grid ends at the last observation
        last_end = F.col("ts")
    end = _floor_bin(F.coalesce(F.col("_next") - F.expr("INTERVAL 1 MICROSECOND"), last_end))
    grid = F.when(start <= end, F.sequence(start, end, _step()))
    return with_next.select("station", F.explode(grid).alias("Time_Bin"), "temp", "precip")


def in_window(hourly: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Observations from ``first_day`` to the end of ``last_day``; the limits reach the scan."""
    end = F.date_add(F.to_date(F.lit(last_day)), 1).cast("timestamp_ntz")
    return hourly.where((F.col("ts") >= F.lit(first_day).cast("timestamp_ntz")) & (F.col("ts") < end))


def nearest_stations(zones: DataFrame, stations: list[tuple[str, float, float]]) -> DataFrame:
    """(Zone, station): the station nearest to each zone (Zone, lat, lon), the first by
    name where two are as near. ``stations`` are (name, lat, lon) settings of the run;
    distances are planar, with degrees of longitude shortened by the latitude."""
    def away(name: str, lat: float, lon: float) -> Column:
        east = (F.col("lon") - lon) * F.cos(F.radians("lat"))
        return F.struct(((F.col("lat") - lat) * (F.col("lat") - lat) + east * east).alias("d"), F.lit(name).alias("station"))
    return zones.select("Zone", F.array_min(F.array(*[away(*s) for s in stations]))["station"].alias("station"))


def join_weather(features: DataFrame, weather_15: DataFrame, station: str = fixed.DEFAULT_STATION,
                 by_zone: DataFrame | None = None) -> DataFrame:
    """Left join on Time_Bin with the weather of one named station, or of each zone's
    own (``by_zone``: Zone, station; a zone without one gets none). The weather grid is bounded by the time range
    (96 rows per station-day); the join strategy is left to the optimizer and
    AQE, which broadcasts it only after measuring its real size."""
    cols = ["Time_Bin", "temp", "precip"]
    if by_zone is None:
        return features.join(weather_15.where(F.col("station") == station).select(*cols), "Time_Bin", "left")
    return (features.join(by_zone.select("Zone", "station"), "Zone", "left")
            .join(weather_15.select("station", *cols), ["station", "Time_Bin"], "left").drop("station")
            .select(*features.columns, "temp", "precip"))
