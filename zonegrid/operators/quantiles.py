"""Exact quantiles (linear interpolation) without a whole group in one task.

``percentile`` merges every distinct value of a group into one final task. Here:

1. equal values are counted, and the counts written once into the shared folder: the
   input is read a single time, and ties are one row;
2. as long as a piece of a group has more than ``limit`` distinct values, a bounded
   sketch cuts it into ``ranges`` value ranges, whose counts tell which of them hold a
   target rank; only these go on, as smaller pieces. A round divides the pieces by about
   ``ranges``; small inputs need none;
3. the values of a piece, ``limit`` at most, are ordered, and the order statistics at
   ranks ``floor((n-1)p)`` and ``ceil((n-1)p)`` are read and interpolated, exactly like
   ``percentile`` / ``quantile_cont``.

The sketch only places the cuts; the result doesn't depend on its error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import ensure_checkpoint_dir

PIECE = ["_k", "_below"]   # a group and the rank of the piece's first value


def exact_quantiles(df: DataFrame, value: Column, probs: list[float], by: list[str] | None = None,
                    accuracy: int = 10000, ranges: int = 128, limit: int = 200_000) -> DataFrame:
    """``by`` columns + one double column ``q{i}`` per probability."""
    by = list(by or [])
    ensure_checkpoint_dir(df.sparkSession)
    key = F.struct(F.lit(0).alias("_0"), *[F.col(f"`{c}`") for c in by]).alias("_k")
    valued = df.select(key, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    pieces = (valued.groupBy("_k", "_v").agg(F.count("*").alias("_c"))
              .withColumn("_below", F.lit(0).cast("long")).checkpoint(eager=True))
    sizes = pieces.groupBy("_k").agg(F.sum("_c").alias("_n"))
    targets = sizes.select("_k", F.explode(F.array_distinct(F.array(*[
        side((F.col("_n") - 1) * F.lit(p)) for p in probs for side in (F.floor, F.ceil)]))).alias("_rank"))
    while pieces.groupBy(*PIECE).agg(F.count("*").alias("_d")).where(F.col("_d") > limit).limit(1).count():
        pieces = narrowed(pieces, targets, accuracy, ranges).checkpoint(eager=True)

    upto = W.partitionBy(*PIECE).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = pieces.withColumn("_upto", F.col("_below") + F.sum("_c").over(upto))
    lists = targets.groupBy("_k").agg(F.collect_list("_rank").alias("_ranks"))     # two a probability
    hits = F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_c")))
    picked = (ordered.join(lists, "_k").select("_k", "_v", F.explode(hits).alias("_rank")))
    at = picked.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    cols = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(p)
        low, high = (F.element_at("_at", side(h)) for side in (F.floor, F.ceil))
        cols.append((low + (high - low) * (h - F.floor(h))).alias(f"q{i}"))
    return at.join(sizes, "_k").select(*[F.col("_k")[c].alias(c) for c in by], *cols)


def narrowed(pieces: DataFrame, targets: DataFrame, accuracy: int, ranges: int) -> DataFrame:
    """The value ranges of the pieces that hold a target rank, as pieces."""
    cuts = F.percentile_approx("_v", [i / ranges for i in range(1, ranges + 1)], accuracy)
    known = pieces.groupBy(*PIECE).agg(F.array_distinct(cuts).alias("_cuts"))
    ranged = (pieces.join(known, PIECE)
              .withColumn("_range", F.size(F.filter("_cuts", lambda x: x <= F.col("_v")))).drop("_cuts"))
    before = W.partitionBy(*PIECE).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = (ranged.groupBy(*PIECE, "_range").agg(F.sum("_c").alias("_m"))
              .withColumn("_start", F.col("_below") + F.coalesce(F.sum("_m").over(before), F.lit(0))))
    stay = (totals.join(targets, "_k").where("_rank >= _start AND _rank < _start + _m")
            .select(*PIECE, "_range", "_start").distinct())
    return (ranged.join(stay, [*PIECE, "_range"])
            .select("_k", "_v", "_c", F.col("_start").cast("long").alias("_below")))
