"""Adapters that derive the service's inputs from the driver's test tables.

No trip or weather table exists in the driver data, so both are derived from
``events`` by Spark (their size grows with it):

* trips: ``pickup = ts``, ``PULocationID = Z[user_id % 10]``,
  ``DOLocationID = Z[(event_id*7+3) % 10]``, ``dropoff = ts + (event_id % 40) min``;
  click/view events form the "yellow" source (``tpep_`` names), the rest "fhvhv".
* hourly weather for one station: one observation per hour that has events,
  ``temp = -10 + (cents % 5500) / 100`` and
  ``precip = (cents % 300) / 100`` when the hour's event count is a multiple of 5,
  else 0, where ``cents = sum(round(value * 100))`` over the hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Popular zones of the original UI, used to map test users/events to zones.
ADAPTER_ZONES = (161, 132, 138, 237, 234, 4, 43, 68, 186, 263)
YELLOW_EVENT_TYPES = ("click", "view")
WEATHER_STATION = "nyc"


_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table (read-only files): one DataFrame per session and path, so
    file listing and footer reads are not repeated for every query built."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, id(spark), path)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def _zone_of(col):
    zones = F.array(*[F.lit(z).cast("long") for z in ADAPTER_ZONES])
    return F.element_at(zones, (col % len(ADAPTER_ZONES) + 1).cast("int"))


def trip_sources(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(yellow, fhvhv) raw trip sources with their native column names."""
    base = events.select(
        F.col("ts").alias("p"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") % 40).cast("int")))
        .alias("d"),
        _zone_of(F.col("user_id")).alias("PULocationID"),
        _zone_of(F.col("event_id") * 7 + 3).alias("DOLocationID"),
        F.col("event_id").alias("extra"),
        F.col("event_type").isin(*YELLOW_EVENT_TYPES).alias("_yellow"),
    )
    cols = ["PULocationID", "DOLocationID", "extra"]
    kind = F.coalesce(F.col("_yellow"), F.lit(False))    # events without a type are the other source's
    yellow = base.where(kind).select(
        F.col("p").alias("tpep_pickup_datetime"), F.col("d").alias("tpep_dropoff_datetime"), *cols)
    fhvhv = base.where(~kind).select(
        F.col("p").alias("pickup_datetime"), F.col("d").alias("dropoff_datetime"), *cols)
    return yellow, fhvhv


def weather_hourly(events: DataFrame, station: str = WEATHER_STATION) -> DataFrame:
    """Landed hourly weather table ``(station, ts, temp, precip)``."""
    hourly = (
        events.where(F.col("ts").isNotNull())
        .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
        .agg(F.count("*").alias("n"),
             F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    )
    cents = F.coalesce(F.col("cents"), F.lit(0))
    return hourly.select(
        F.lit(station).alias("station"),
        "ts",
        (F.lit(-10.0) + (cents % 5500) / 100.0).alias("temp"),
        F.when(F.col("n") % 5 == 0, (cents % 300) / 100.0).otherwise(F.lit(0.0)).alias("precip"),
    )


#: Two stations for the assignment by place: the hours of the yellow events and of the rest.
STATIONS = (("east", 40.64, -73.78), ("west", 40.78, -74.17))


def weather_by_station(events: DataFrame) -> DataFrame:
    yellow = F.coalesce(F.col("event_type").isin(*YELLOW_EVENT_TYPES), F.lit(False))
    return weather_hourly(events.where(yellow), "east").union(weather_hourly(events.where(~yellow), "west"))


def zone_positions(rows: DataFrame) -> DataFrame:
    """(Zone, lat, lon) of the zones in ``rows``: a made-up grid, as the data has none."""
    return rows.select("Zone").distinct().select(
        "Zone", (F.lit(40.5) + F.col("Zone") / 500).alias("lat"), (F.lit(-74.2) + (F.col("Zone") % 20) / 40).alias("lon"))


# SQL text of the same adapters, for the DuckDB oracle.
SQL_TRIPS = """
trips AS (
  SELECT ts AS pickup_datetime,
         ts + to_minutes(CAST(event_id % 40 AS INTEGER)) AS dropoff_datetime,
         CAST(list_extract([161,132,138,237,234,4,43,68,186,263], CAST(user_id % 10 AS INTEGER) + 1) AS BIGINT) AS PULocationID,
         CAST(list_extract([161,132,138,237,234,4,43,68,186,263], CAST((event_id * 7 + 3) % 10 AS INTEGER) + 1) AS BIGINT) AS DOLocationID
  FROM events
)"""

def sql_weather_hourly(station: str, where: str = "true") -> str:
    return f"""
  SELECT '{station}' AS station, h AS ts,
         -10.0 + (cents % 5500) / 100.0 AS temp,
         CASE WHEN n % 5 = 0 THEN (cents % 300) / 100.0 ELSE 0.0 END AS precip
  FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n,
               coalesce(sum(CAST(round(value * 100) AS BIGINT)), 0) AS cents
        FROM events WHERE ts IS NOT NULL AND {where} GROUP BY 1)"""


SQL_WEATHER_HOURLY = f"weather_hourly AS ({sql_weather_hourly('nyc')})"
SQL_WEATHER_WINDOW = (f"weather_hourly AS (SELECT * FROM ({sql_weather_hourly('nyc')}) "
                      "WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21')")
SQL_WEATHER_STATIONS = ("weather_hourly AS (" + sql_weather_hourly("east", "coalesce(event_type IN ('click', 'view'), false)")
                        + " UNION ALL" + sql_weather_hourly("west", "NOT coalesce(event_type IN ('click', 'view'), false)") + ")")
