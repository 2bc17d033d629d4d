"""Evaluation queries: metrics, calibration, folds, CV summary, tail sample.

Predictions here are the persistence forecast (``y_pred = DER_t`` for the
truth ``Target_DER_t+15``), which SQL can reproduce; model predictions go
through the same operators in :mod:`zonegrid.suite.models`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import folds, metrics
from .base import P, cte, final_sql, per_session, register, rounded
from .prep import PREP, SQL_JOINED, SQL_MATRIX, SQL_WEATHER_15, training_rows
from ..sources import testdata as td

MAT = [*PREP, td.SQL_WEATHER_HOURLY, SQL_WEATHER_15, SQL_JOINED, SQL_MATRIX]
SQL_PRED = 'pred AS (SELECT split, Zone, Time_Bin, "Target_DER_t+15" AS y_true, DER_t AS y_pred FROM mat)'


@per_session
def persistence(spark, sf_dir):
    rows, _ = training_rows(spark, sf_dir)
    return rows.select("split", "Zone", "Time_Bin", F.col(f"`{fixed.TARGET}`").alias("y_true"),
                       F.col("DER_t").alias("y_pred"))


@register("regression_metrics", final_sql(cte(*MAT, SQL_PRED, """result AS (
    SELECT split, count(*) AS n, avg(abs(y_true - y_pred)) AS mae,
           sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
           CASE WHEN var_pop(y_true) * count(*) = 0
                THEN CASE WHEN sum((y_true - y_pred) * (y_true - y_pred)) = 0 THEN 1.0 ELSE 0.0 END
                ELSE 1.0 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) END AS r2,
           avg(abs(y_true - y_pred) / greatest(abs(y_true), 1e-8)) * 100.0 AS mape
    FROM pred GROUP BY split)"""), ["split", "n", "mae", "rmse", "r2", "mape"], {"mae", "rmse", "r2", "mape"}))
def q_regression_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(persistence(spark, sf_dir), by=["split"]))


_CAL = ["p10", "p50", "p90", "abs_p50", "abs_p90"]


@register("residual_calibration", final_sql(cte(*MAT, SQL_PRED, """result AS (
    SELECT split,
           quantile_cont(y_true - y_pred, 0.1) AS p10, quantile_cont(y_true - y_pred, 0.5) AS p50,
           quantile_cont(y_true - y_pred, 0.9) AS p90,
           quantile_cont(abs(y_true - y_pred), 0.5) AS abs_p50, quantile_cont(abs(y_true - y_pred), 0.9) AS abs_p90
    FROM pred GROUP BY split)"""), ["split", *_CAL], set(_CAL)))
def q_residual_calibration(spark, sf_dir):
    return rounded(metrics.residual_calibration(persistence(spark, sf_dir), by=["split"]))


SQL_FOLDS = """
tr AS (SELECT * FROM pred WHERE split = 'train'),
pos AS (SELECT *, row_number() OVER (ORDER BY Time_Bin, Zone) - 1 AS pos, count(*) OVER () AS n_rows FROM tr),
kk AS (SELECT *, least(5, greatest(2, n_rows // 100)) AS n_folds FROM pos),
fs AS (SELECT *, n_rows // (n_folds + 1) AS fold_size FROM kk),
folds AS (SELECT *, CASE WHEN pos >= n_rows - n_folds * fold_size AND fold_size > 0
                         THEN (pos - (n_rows - n_folds * fold_size)) // fold_size END AS test_fold FROM fs)"""

_FOLD_COLS = ["Zone", "Time_Bin", "pos", "n_rows", "n_folds", "fold_size", "test_fold"]


def train_folds(spark, sf_dir):
    return folds.time_series_folds(persistence(spark, sf_dir).where(F.col("split") == "train"))


@register("cv_folds", final_sql(cte(*MAT, SQL_PRED, SQL_FOLDS, "result AS (SELECT * FROM folds)"), _FOLD_COLS))
def q_cv_folds(spark, sf_dir):
    return train_folds(spark, sf_dir).select(*_FOLD_COLS)


@register("cv_summary", final_sql(cte(*MAT, SQL_PRED, SQL_FOLDS, """fm AS (
    SELECT test_fold, avg(abs(y_true - y_pred)) AS mae FROM folds WHERE test_fold IS NOT NULL GROUP BY test_fold),
    result AS (SELECT count(*) AS n_folds, avg(mae) AS cv_mae_mean, stddev_pop(mae) AS cv_mae_std FROM fm)"""),
    ["n_folds", "cv_mae_mean", "cv_mae_std"], {"cv_mae_mean", "cv_mae_std"}))
def q_cv_summary(spark, sf_dir):
    return rounded(metrics.cv_summary(metrics.fold_mae(train_folds(spark, sf_dir))))


@register("tail_sample", final_sql(cte(*MAT, SQL_PRED, SQL_FOLDS, f"""result AS (
    SELECT Zone, Time_Bin, pos FROM folds WHERE pos >= n_rows - {P.tuning.max_samples})"""),
    ["Zone", "Time_Bin", "pos"]))
def q_tail_sample(spark, sf_dir):
    train = persistence(spark, sf_dir).where(F.col("split") == "train")
    return folds.tail_sample(train, P.tuning.max_samples).select("Zone", "Time_Bin", "pos")


@register("tail_sample_cut", final_sql(cte(*MAT, SQL_PRED, SQL_FOLDS, """result AS (
    SELECT Zone, Time_Bin, pos FROM folds WHERE pos >= n_rows - 1000)"""), ["Zone", "Time_Bin", "pos"]))
def q_tail_sample_cut(spark, sf_dir):
    """The sampling operator with a limit below the table's rows, so that it cuts."""
    train = persistence(spark, sf_dir).where(F.col("split") == "train")
    return folds.tail_sample(train, 1000).select("Zone", "Time_Bin", "pos")
