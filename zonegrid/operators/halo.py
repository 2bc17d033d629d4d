"""Row-offset windows over long per-key series, split into (key, chunk) pieces.

``lag``/``lead``/``rowsBetween`` over ``Window.partitionBy(key)`` put a whole
key's series into one task; a hot key (a third of all rows) would then bound
the whole stage. Here the series is cut into time chunks, and each chunk gets
a *halo*: the ``before`` rows that precede its first row and the ``after``
rows that follow its last row, wherever they are (gaps in the series may put
them several chunks away). Window functions then run over ``(key, chunk)``
partitions and give exactly the per-key result for the chunk's own rows.

How the halo is found without a per-key shuffle of the whole series:

1. ``row_number``/``count`` per (key, chunk) mark the first ``after`` and the
   last ``before`` rows of every chunk - the *edge* rows.
2. The rows that precede a chunk's first row by at most ``before`` positions
   are all edge rows of earlier chunks, so ``lead(chunk, 1..before)`` over the
   edge table (per key: at most before+after rows per chunk) names, for every
   edge row, the later chunks it is a halo row of; ``lag(chunk, 1..after)``
   does the same backwards.
3. Edge rows are copied into those chunks (tagged ``_own = false``) and
   unioned with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_chunk(ts: Column, days: int) -> Column:
    """Chunk id from the calendar day (wall clock, no time-zone conversion)."""
    return F.floor(F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) / F.lit(days)).cast("long")


def with_halo(df: DataFrame, keys: list[str], order_col: str, chunk_col: str,
              before: int, after: int) -> DataFrame:
    """``df`` (which holds ``chunk_col``) plus halo copies; adds ``_own``."""
    cols = df.columns
    part = [*keys, chunk_col]
    marked = df.select(*cols,
                       F.row_number().over(Window.partitionBy(*part).orderBy(order_col)).alias("_rn"),
                       F.count(F.lit(1)).over(Window.partitionBy(*part)).alias("_cnt"))
    edge_cond = F.lit(False)
    if after > 0:
        edge_cond = edge_cond | (F.col("_rn") <= after)
    if before > 0:
        edge_cond = edge_cond | (F.col("_rn") > F.col("_cnt") - before)

    w_key = Window.partitionBy(*keys).orderBy(order_col)
    chunk = F.col(chunk_col)
    targets = [F.when(F.lead(chunk, k).over(w_key) != chunk, F.lead(chunk, k).over(w_key))
               for k in range(1, before + 1)]
    targets += [F.when(F.lag(chunk, k).over(w_key) != chunk, F.lag(chunk, k).over(w_key))
                for k in range(1, after + 1)]
    # window functions cannot sit inside a generator: name the targets first
    edges = marked.where(edge_cond).select(
        *cols, F.array_distinct(F.array_compact(F.array(*targets))).alias("_targets"))
    halo = edges.select(*[c for c in cols if c != chunk_col], F.explode("_targets").alias(chunk_col),
                        F.lit(False).alias("_own"))
    own = marked.select(*cols, F.lit(True).alias("_own"))
    return own.unionByName(halo)


def chunked(df: DataFrame, keys: list[str], order_col: str, chunk_days: int | None,
            before: int, after: int) -> tuple[DataFrame, list[str]]:
    """Data plus halo and the partition columns to window over.

    ``chunk_days=None`` windows each key whole (no halo), kept for comparison.
    """
    if not chunk_days:
        return df.withColumn("_own", F.lit(True)), list(keys)
    data = df.withColumn("_chunk", day_chunk(F.col(order_col), chunk_days))
    return with_halo(data, keys, order_col, "_chunk", before, after), [*keys, "_chunk"]
