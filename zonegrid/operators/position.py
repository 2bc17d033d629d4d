"""Global row positions in time order without a single-partition window.

``row_number() OVER (ORDER BY t)`` moves the whole table into one task. Here
rows are counted per time bucket (a table bounded by the time range, not by
the data volume), a running sum over those counts gives each bucket's
offset, and ``row_number`` inside each bucket adds the rest. The result is
the exact position of every row in the total order ``(order_cols)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_position(df: DataFrame, bucket_col: str, order_cols: list[str], name: str = "pos",
                    partition_keys: list[str] | None = None, total_name: str | None = None) -> DataFrame:
    """Add 0-based ``name`` = position of the row in ``ORDER BY bucket_col, *order_cols``
    (within ``partition_keys`` when given); ``total_name`` also adds the row total."""
    keys = list(partition_keys or [])
    counts = df.groupBy(*keys, bucket_col).agg(F.count(F.lit(1)).alias("_bn"))
    w_run = Window.partitionBy(*keys).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_bn").over(Window.partitionBy(*keys)).cast("long").alias(total_name)] if total_name else []
    offsets = counts.select(*keys, bucket_col,
                            F.coalesce(F.sum("_bn").over(w_run), F.lit(0)).cast("long").alias("_off"), *extra)
    w_in = Window.partitionBy(*keys, bucket_col).orderBy(*order_cols)
    ranked = df.withColumn("_rn", F.row_number().over(w_in))
    return (ranked.join(offsets, [*keys, bucket_col], "inner")
            .withColumn(name, F.col("_off") + F.col("_rn") - 1)
            .drop("_off", "_rn"))


def total_rows(df: DataFrame, partition_keys: list[str] | None = None) -> DataFrame:
    keys = list(partition_keys or [])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
