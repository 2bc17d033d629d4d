"""Boosted-tree training, early stopping, CV and grid search.

Trees are built by Spark ML's ``GBTRegressor`` (squared loss): every split
search is a distributed aggregation over the cached feature vectors.

* Early stopping with *patience*: fit ``maxIter`` trees once, score every
  prefix on the early-stopping rows with ``evaluateEachIteration`` (one pass),
  keep the best prefix unless it is followed by ``patience`` non-improving
  rounds, and cut the model to that many trees: there is no second fit.
* Grid search: all fits of the bounded tail sample are one job (``boost``).
* A tree takes a job a level, and each task of it sends its histograms of all open
  nodes. Rows are fitted in partitions of ``ROWS_PER_TASK``, whatever the number of
  partitions they were prepared in, and in no more than there are cores while a
  partition holds at most ``MOST_ROWS``. They are moved there once and checkpointed: the
  hundreds of jobs of a fit neither read rows of another split nor send their lineage.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from math import ceil, isfinite

from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folds import fold_bounds, time_series_folds
from ..params import ModelParams
from . import boost


DEFAULT_MAX_BINS = ModelParams().max_bins
ROWS_PER_TASK = 50_000   # rows of one task of a fit; at 21 features some 10 MB
MOST_ROWS = 1_000_000    # rows of one task where the cores are too few for the former


def regressor(n_trees: int, learning_rate: float, max_depth: int, seed: int,
              max_bins: int = DEFAULT_MAX_BINS) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol="label", predictionCol="prediction",
                        maxIter=int(n_trees), stepSize=float(learning_rate), maxDepth=int(max_depth),
                        seed=int(seed), lossType="squared", maxBins=int(max_bins))


def fit_tasks(spark: SparkSession, n_rows: int) -> int:
    """Partitions of a fit's rows."""
    return max(1, ceil(n_rows / MOST_ROWS), min(ceil(n_rows / ROWS_PER_TASK), spark.sparkContext.defaultParallelism))


def fit_rows(rows: DataFrame) -> DataFrame:
    """``features`` and ``label`` of all rows, in the partitions that their number asks for."""
    found = rows.select("features", "label")
    return found.repartition(fit_tasks(rows.sparkSession, rows.count())).checkpoint(eager=True)


def best_with_patience(errors: list[float], patience: int) -> int:
    """Number of trees to keep: best prefix, stopping after ``patience`` misses."""
    best, best_err = 0, float("inf")
    for i, e in enumerate(errors):
        if e < best_err:
            best, best_err = i, e
        elif patience > 0 and i - best >= patience:
            break
    return best + 1


def first_trees(model: GBTRegressionModel, k: int) -> GBTRegressionModel:
    """The model of the first ``k`` trees, with the same parameters."""
    if k >= model.getNumTrees:
        return model
    jvm, gateway = SparkSession.active()._jvm, SparkSession.active().sparkContext._gateway
    kind = jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(kind.DecisionTreeRegressionModel, k)
    weights = gateway.new_array(gateway.jvm.double, k)
    for i in range(k):
        trees[i], weights[i] = model.trees[i]._java_obj, model.treeWeights[i]
    whole = model._java_obj
    cut = kind.GBTRegressionModel(f"{model.uid}_{k}", trees, weights, whole.numFeatures())
    return model._copyValues(GBTRegressionModel(cut), {model.maxIter: k})


@dataclass
class FitResult:
    model: GBTRegressionModel
    n_trees: int
    errors: list


def fit(train: DataFrame, params: ModelParams, stop_on: DataFrame | None = None) -> FitResult:
    """Fit with optional patience-based early stopping on ``stop_on``."""
    est = regressor(params.n_estimators, params.learning_rate, params.max_depth, params.seed, params.max_bins)
    model = est.fit(fit_rows(train))
    errors: list = []
    keep = params.n_estimators
    if stop_on is not None and params.early_stopping_rounds > 0:
        errors = list(model.evaluateEachIteration(stop_on, "squared"))
        keep = best_with_patience(errors, params.early_stopping_rounds)
        model = first_trees(model, keep)
    return FitResult(model, keep, errors)


def train_tail_split(train: DataFrame, fraction: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(fit rows, early-stopping rows): the latest ``fraction`` of train by time position."""
    from ..operators.folds import with_positions
    p = with_positions(train, "time")
    cut = F.col("n_rows") - F.ceil(F.col("n_rows") * F.lit(fraction))
    return p.where(F.col("pos") < cut), p.where(F.col("pos") >= cut)


def fit_with_stopping(train: DataFrame, test: DataFrame, params: ModelParams) -> FitResult:
    """Early stopping on the holdout (parity) or on the latest slice of train."""
    if params.early_stopping_rounds <= 0:
        return fit(train, params, None)
    if params.early_stopping_on == "test":
        return fit(train, params, test)
    head, tail = train_tail_split(train)
    found = fit(head, params, tail)
    # refit on all train rows with the number of trees found on the tail
    final = regressor(found.n_trees, params.learning_rate, params.max_depth, params.seed, params.max_bins).fit(
        fit_rows(train))
    return FitResult(final, found.n_trees, found.errors)


def fold_frames(assembled: DataFrame, n_splits: int | None = None, order: str = "time"):
    """[(train_rows, validation_rows)] of the expanding-window split; none where the rows
    are not more than the folds."""
    tasks = fit_tasks(assembled.sparkSession, assembled.count())
    folded = time_series_folds(assembled, n_splits, order).repartition(tasks).cache()
    k = int(folded.where("fold_size > 0").select(F.max("n_folds")).first()[0] or 0)
    return [(folded.where(fold_bounds(j)), folded.where(F.col("test_fold") == j)) for j in range(k)], folded


def cv_scores(assembled: DataFrame, params: ModelParams, n_splits: int | None = None,
              order: str = "time", threads: int = 4) -> dict:
    """M2: MAE per expanding-window fold (no early stopping), mean and population std;
    these are NaN only where there are no folds."""
    folds, cached = fold_frames(assembled, n_splits, order)

    def run(pair):
        tr, va = pair
        m = regressor(params.n_estimators, params.learning_rate, params.max_depth, params.seed,
                      params.max_bins).fit(fit_rows(tr))
        return float(m.evaluateEachIteration(va, "absolute")[-1])

    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        maes = list(pool.map(run, folds))
    cached.unpersist()
    if not all(map(isfinite, maes)):
        raise ArithmeticError(f"a fold's error is not a finite number: {maes}")
    n = len(maes)
    mean = sum(maes) / n if n else float("nan")
    std = (sum((m - mean) ** 2 for m in maes) / n) ** 0.5 if n else float("nan")
    return {"fold_mae": maes, "cv_mae_mean": mean, "cv_mae_std": std}


def grid_search(assembled: DataFrame, grid: dict, cv_splits: int, order: str = "time",
                max_bins: int = DEFAULT_MAX_BINS) -> DataFrame:
    """M5: n_estimators, max_depth, learning_rate, mean_mae, n_folds per combination
    (expanding-window folds). All fits are one job; a fit with fewer trees is the
    beginning of one with more."""
    folded = time_series_folds(assembled, cv_splits, order)
    return (boost.grid_errors(folded, cv_splits, grid, max_bins)
            .groupBy("n_estimators", "max_depth", "learning_rate")
            .agg(F.avg("mae").alias("mean_mae"), F.count("*").alias("n_folds")))


def best_of(results: DataFrame) -> DataFrame:
    """The one row of least mean error; ties go to the smaller parameters."""
    names = ["n_estimators", "max_depth", "learning_rate"]
    return results.agg(F.min(F.struct("mean_mae", *names)).alias("b")).select("b.*").where("mean_mae is not null")
