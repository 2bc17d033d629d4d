"""Expanding-window CV folds and the tail sample (M4, T4).

Positions come from :func:`zonegrid.operators.position.global_position`
(per-bin counts + running sum), so no step puts the table in one task.

* ``order="time"`` (default): rows in time order, zone breaks ties.
* ``order="arrival"``: the original's positional order (zone, then time),
  whose folds cut across zones - kept for parity.

With ``n`` rows and ``k`` folds, ``size = n // (k+1)``; fold ``j`` validates
positions ``[n - (k-j)*size, n - (k-j-1)*size)`` and trains on everything
before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .position import global_position


def default_n_splits(n: Column) -> Column:
    """``min(5, max(2, n // 100))``."""
    return F.least(F.lit(5), F.greatest(F.lit(2), F.floor(n / 100))).cast("long")


def with_positions(df: DataFrame, order: str = "time") -> DataFrame:
    if order == "time":
        return global_position(df, "Time_Bin", ["Zone"], "pos", total_name="n_rows")
    if order == "arrival":  # (zone, day) buckets keep one zone out of a single task
        keyed = df.withColumn("_ab", F.struct(F.col("Zone"), F.to_date("Time_Bin")))
        return global_position(keyed, "_ab", ["Time_Bin"], "pos", total_name="n_rows").drop("_ab")
    raise ValueError(order)


def time_series_folds(df: DataFrame, n_splits: int | None = None, order: str = "time") -> DataFrame:
    """Adds ``pos``, ``n_rows``, ``n_folds``, ``fold_size``, ``test_fold`` (NULL = never validated)."""
    p = with_positions(df, order)
    k = F.lit(n_splits).cast("long") if n_splits else default_n_splits(F.col("n_rows"))
    p = p.withColumn("n_folds", k).withColumn("fold_size", F.floor(F.col("n_rows") / (F.col("n_folds") + 1)))
    first = F.col("n_rows") - F.col("n_folds") * F.col("fold_size")
    fold = F.when((F.col("pos") >= first) & (F.col("fold_size") > 0),
                  F.floor((F.col("pos") - first) / F.col("fold_size"))).cast("long")
    return p.withColumn("test_fold", fold)


def fold_bounds(fold: int) -> Column:
    """Train rows of fold ``fold``: every position before its validation block."""
    first = F.col("n_rows") - F.col("n_folds") * F.col("fold_size")
    return F.col("pos") < first + F.lit(fold) * F.col("fold_size")


def tail_sample(df: DataFrame, max_samples: int, order: str = "time") -> DataFrame:
    """The last ``max_samples`` rows in the chosen order (all rows when fewer)."""
    p = with_positions(df, order)
    return p.where(F.col("pos") >= F.col("n_rows") - F.lit(max_samples))
