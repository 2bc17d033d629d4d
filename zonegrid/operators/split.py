"""Time split, quality filters and audits.

One ``split`` column replaces two filtered copies, so a single write can
``partitionBy("split")`` and readers prune to one side. The window features
are computed before any of these filters (the last train row's target lies in
the test period), exactly like the original.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..params import Params

TRAIN, TEST = "train", "test"


def add_split(df: DataFrame, split_date: str, time_col: str = "Time_Bin") -> DataFrame:
    cut = F.lit(split_date).cast("timestamp_ntz")
    return df.withColumn("split", F.when(F.col(time_col) < cut, F.lit(TRAIN))
                         .when(F.col(time_col) >= cut, F.lit(TEST)))


def target_present(df: DataFrame) -> DataFrame:
    return df.dropna(subset=[fixed.TARGET])


def der_in_bounds(p: Params):
    """Inclusive bounds on both DER_t and the target; enabled by upper > 0."""
    if not p.der_outlier_upper > 0:
        return F.lit(True)
    lo, hi = F.lit(p.der_outlier_lower), F.lit(p.der_outlier_upper)
    return F.col("DER_t").between(lo, hi) & F.col(f"`{fixed.TARGET}`").between(lo, hi)


def min_active(p: Params):
    if not p.min_active_requests > 0:
        return F.lit(True)
    return F.col("ActiveRequests") >= p.min_active_requests


def split_filtered(features: DataFrame, p: Params) -> DataFrame:
    """Split column + target-null drop + DER outlier filter + minimum activity."""
    out = target_present(add_split(features, p.split_date).where(F.col("split").isNotNull()))
    return out.where(der_in_bounds(p) & min_active(p))


def split_counts(features: DataFrame, p: Params) -> DataFrame:
    """Rows per split at each filter stage, in one aggregation."""
    s = add_split(features, p.split_date).where(F.col("split").isNotNull())
    has_t = F.col(f"`{fixed.TARGET}`").isNotNull()
    keep = has_t & der_in_bounds(p) & min_active(p)
    return s.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(has_t, 1)).alias("n_with_target"),
        F.count(F.when(keep, 1)).alias("n_kept"),
    )


def feature_names_by_exclusion(df: DataFrame) -> list[str]:
    """Feature list by exclusion, from the schema (no job)."""
    return [c for c in df.columns if c not in fixed.EXCLUDE_FROM_FEATURES and c != "split"]


def quality_audit(df: DataFrame, by: str | None = "split") -> DataFrame:
    """P15 over the whole table (not a 20-row sample): missing required
    columns, emptiness and all-null time per split, as one aggregation."""
    missing = sorted(set(fixed.REQUIRED_PROCESSED) - set(df.columns))
    keys = [by] if by else []
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("Time_Bin").alias("n_time") if "Time_Bin" in df.columns else F.lit(0).cast("long").alias("n_time"),
    )
    return agg.select(
        *keys, "n_rows", "n_time",
        F.lit(",".join(missing)).alias("missing_columns"),
        ((F.col("n_rows") > 0) & (F.col("n_time") > 0) & F.lit(not missing)).alias("ok"),
    )


def validate_or_raise(audit_rows) -> None:
    """Raise like the original when a split is unusable."""
    for r in audit_rows:
        if r["missing_columns"]:
            raise ValueError(f"columns that the job needs are not there: {r['missing_columns'].split(',')}")
        if r["n_rows"] == 0:
            raise ValueError("no rows are left to train on")
        if r["n_time"] == 0:
            raise ValueError("no row has a time bin")
