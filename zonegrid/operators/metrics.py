"""Regression metrics, residual calibration, CV summary.

Each is one aggregation (partial aggregates per task, one small final
reduce); grouping keys are optional so the same code scores per split, per
fold or per model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from .quantiles import exact_quantiles


def regression_metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred",
                       by: list[str] | None = None) -> DataFrame:
    """n, MAE, RMSE, R2 (constant truth: 1 if no error else 0), MAPE x100."""
    yc, pc = F.col(f"`{y}`").cast("double"), F.col(f"`{p}`").cast("double")
    e = yc - pc
    agg = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(yc) * F.count(F.lit(1))).alias("_sst"),
        (F.avg(F.abs(e) / F.greatest(F.abs(yc), F.lit(fixed.MAPE_EPSILON))) * 100.0).alias("mape"),
    )
    r2 = (F.when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(1.0 - F.col("_sse") / F.col("_sst")))
    return agg.select(*(by or []), "n", "mae", "rmse", r2.alias("r2"), "mape")


def residual_calibration(df: DataFrame, y: str = "y_true", p: str = "y_pred",
                         by: list[str] | None = None, method: str = "exact") -> DataFrame:
    """Residual p10/p50/p90 and absolute-residual p50/p90 (linear interpolation).

    ``method="exact"`` (default) uses the bracketed exact quantiles of
    :mod:`zonegrid.operators.quantiles` (no whole group in one task);
    ``"percentile"`` is Spark's exact aggregate (value map per group, fine for
    small groups); ``"approx"`` is ``percentile_approx`` (bounded-memory sketch).
    """
    by = list(by or [])
    r = F.col(f"`{y}`").cast("double") - F.col(f"`{p}`").cast("double")
    if method == "exact":
        # residuals and absolute residuals as two tagged groups of one quantile pass
        sides = F.array(F.struct(F.lit(0).alias("w"), r.alias("v")), F.struct(F.lit(1).alias("w"), F.abs(r).alias("v")))
        long = df.select(*by, F.inline(sides))
        q = exact_quantiles(long, F.col("v"), [0.1, 0.5, 0.9], [*by, "w"])
        pick = {"p10": (0, 0), "p50": (0, 1), "p90": (0, 2), "abs_p50": (1, 1), "abs_p90": (1, 2)}
        return q.groupBy(*by).agg(*[F.max(F.when(F.col("w") == w, F.col(f"q{i}"))).alias(n)
                                    for n, (w, i) in pick.items()])
    if method == "percentile":
        q = F.percentile(r, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
        qa = F.percentile(F.abs(r), F.array(F.lit(0.5), F.lit(0.9)))
    else:
        q = F.percentile_approx(r, [0.1, 0.5, 0.9], 100000)
        qa = F.percentile_approx(F.abs(r), [0.5, 0.9], 100000)
    agg = df.groupBy(*by).agg(q.alias("_q"), qa.alias("_qa"))
    return agg.select(
        *by,
        F.col("_q")[0].cast("double").alias("p10"), F.col("_q")[1].cast("double").alias("p50"),
        F.col("_q")[2].cast("double").alias("p90"),
        F.col("_qa")[0].cast("double").alias("abs_p50"), F.col("_qa")[1].cast("double").alias("abs_p90"),
    )


def fold_mae(df: DataFrame, fold_col: str = "test_fold", y: str = "y_true", p: str = "y_pred") -> DataFrame:
    e = F.col(f"`{y}`").cast("double") - F.col(f"`{p}`").cast("double")
    return df.where(F.col(fold_col).isNotNull()).groupBy(fold_col).agg(F.avg(F.abs(e)).alias("mae"))


def cv_summary(fold_maes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and *population* std of the per-fold MAE."""
    return fold_maes.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("mae").alias("cv_mae_mean"),
        F.stddev_pop("mae").alias("cv_mae_std"),
    )
