"""Time binning, demand / supply counts and the imbalance table.

The preferred form (:func:`imbalance`) reads the trips once: every trip emits a
demand row (its pickup zone) and a supply row (its drop-off zone), and one
``groupBy(Time_Bin, Zone)`` counts both sides. Partial aggregation runs before
the only shuffle, so a hot zone or bin costs one row per map task, not one row
per trip. :func:`imbalance_outer` is the literal two-aggregate full outer join;
both give the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed

KEYS = ["Time_Bin", "Zone"]


def time_bin(ts: Column, minutes: int = fixed.BIN_MINUTES) -> Column:
    """Floor to the bin start; rows without a time stay, with a NULL bin."""
    return floor_bin(ts, minutes)


def floor_bin(ts: Column, minutes: int = fixed.BIN_MINUTES) -> Column:
    """Floor by epoch arithmetic on TIMESTAMP_NTZ (``window`` would drop rows whose
    time is NULL)."""
    step = minutes * 60 * 1_000_000
    since = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return F.timestamp_add("MICROSECOND", F.floor(since / step) * step,
                           F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def add_time_bin(trips: DataFrame, minutes: int = fixed.BIN_MINUTES,
                 supply_time: str = "pickup") -> DataFrame:
    out = trips.withColumn("Time_Bin", time_bin(F.col("pickup_datetime"), minutes))
    if supply_time == "dropoff":
        out = out.withColumn("Supply_Bin", floor_bin(F.col("dropoff_datetime"), minutes))
    return out


def _count_by(trips: DataFrame, zone_col: str, name: str, minutes: int) -> DataFrame:
    b = time_bin(F.col("pickup_datetime"), minutes)
    return (
        trips.where(F.col("pickup_datetime").isNotNull() & F.col(zone_col).isNotNull())
        .groupBy(b.alias("Time_Bin"), F.col(zone_col).alias("Zone"))
        .agg(F.count(F.lit(1)).alias(name))
    )


def demand_counts(trips: DataFrame, minutes: int = fixed.BIN_MINUTES) -> DataFrame:
    """Trips starting in a zone per bin (null keys excluded)."""
    return _count_by(trips, "PULocationID", "ActiveRequests", minutes)


def supply_counts(trips: DataFrame, minutes: int = fixed.BIN_MINUTES) -> DataFrame:
    """Trips ending in a zone per bin, binned by *pickup* time like the original."""
    return _count_by(trips, "DOLocationID", "AvailableDriversProxy", minutes)


def with_ratios(cells: DataFrame) -> DataFrame:
    """Counts as double; elasticity = supply/demand (demand 0 -> 0);
    DER = demand/supply (supply 0 -> 1)."""
    a = F.coalesce(F.col("ActiveRequests").cast("double"), F.lit(0.0))
    p = F.coalesce(F.col("AvailableDriversProxy").cast("double"), F.lit(0.0))
    return cells.select(
        F.col("Zone"),
        F.col("Time_Bin"),
        a.alias("ActiveRequests"),
        p.alias("AvailableDriversProxy"),
        F.coalesce(p / F.nullif(a, F.lit(0.0)), F.lit(0.0)).alias("SupplyElasticity"),
        F.coalesce(a / F.nullif(p, F.lit(0.0)), F.lit(1.0)).alias("DER_t"),
    )


def imbalance_outer(trips: DataFrame, minutes: int = fixed.BIN_MINUTES) -> DataFrame:
    """Literal form: two aggregates joined with a full outer equi-join."""
    d = demand_counts(trips, minutes)
    s = supply_counts(trips, minutes)
    return with_ratios(d.join(s, KEYS, "full"))


def imbalance(trips: DataFrame, minutes: int = fixed.BIN_MINUTES,
              supply_time: str = "pickup") -> DataFrame:
    """One scan, one shuffle: explode each trip into its two sides and count."""
    if supply_time == "pickup":
        pickup_bin = supply_bin = time_bin(F.col("pickup_datetime"), minutes)
    else:  # window() would also drop rows with a NULL pickup time: use arithmetic floors
        pickup_bin = floor_bin(F.col("pickup_datetime"), minutes)
        supply_bin = floor_bin(F.col("dropoff_datetime"), minutes)
    sides = trips.select(F.inline(F.array(
        F.struct(pickup_bin.alias("Time_Bin"), F.col("PULocationID").alias("Zone"),
                 F.lit(1).alias("d"), F.lit(0).alias("s")),
        F.struct(supply_bin.alias("Time_Bin"), F.col("DOLocationID").alias("Zone"),
                 F.lit(0).alias("d"), F.lit(1).alias("s")),
    )))
    cells = (
        sides.where(F.col("Time_Bin").isNotNull() & F.col("Zone").isNotNull())
        .groupBy("Time_Bin", "Zone")
        .agg(F.sum("d").cast("long").alias("ActiveRequests"),
             F.sum("s").cast("long").alias("AvailableDriversProxy"))
    )
    return with_ratios(cells)
