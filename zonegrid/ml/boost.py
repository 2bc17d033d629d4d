"""Boosting of many parameter sets in one job, for the grid search (M5).

The grid search works on the tail sample, whose rows ``TuningParams.max_samples``
bounds. A fit of one (depth, rate, fold) needs its rows at every tree and level, and a
job per level would spend its time on scheduling; so each fit is one group, Spark spreads
the groups, and all fits are one job. Trees are those of ``GBTRegressor``: variance
splits over feature bins, the first tree at weight 1 on the label, later ones at the
learning rate on twice the residual. Bins are midpoints of a feature's distinct values,
or of its quantiles where it has more values than bins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds of one feature: a value goes left of those it doesn't exceed."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.linspace(0, 1, bins), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def best_splits(node: np.ndarray, codes: np.ndarray, target: np.ndarray, nodes: int, bins: int):
    """(feature, bin) with the largest drop of squared error per node; feature -1 where
    none gains. Histograms of all nodes and features come from two counts."""
    features = codes.shape[1]
    cell = ((node[:, None] * features + np.arange(features)) * bins + codes).ravel()
    shape = (nodes, features, bins)
    rows = np.bincount(cell, minlength=nodes * features * bins).reshape(shape).cumsum(axis=2)
    sums = np.bincount(cell, np.repeat(target, features), nodes * features * bins).reshape(shape).cumsum(axis=2)
    n, s = rows[:, :1, -1:], sums[:, :1, -1:]
    left, right = rows, n - rows
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sums ** 2 / left + (s - sums) ** 2 / right - s ** 2 / n
    gain = np.where((left > 0) & (right > 0), gain, -1.0).reshape(nodes, -1)
    at = gain.argmax(axis=1)
    feature, cut = np.divmod(at, bins)
    return np.where(gain[np.arange(nodes), at] > 1e-12, feature, -1), cut


def grown(codes: np.ndarray, target: np.ndarray, other: np.ndarray, depth: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree's values for its own rows and for other rows."""
    node, away = np.zeros(len(codes), dtype=np.int64), np.zeros(len(other), dtype=np.int64)
    names = 1
    open_ = np.ones(1, dtype=bool)                  # nodes that may still be split
    for _ in range(depth):
        feature, cut = best_splits(node, codes, target, names, bins)
        feature = np.where(open_, feature, -1)
        if (feature < 0).all():
            break
        step = lambda at, c: 2 * at + ((feature[at] >= 0) & (
            c[np.arange(len(c)), np.maximum(feature[at], 0)] > cut[at]))
        node, away = step(node, codes), step(away, other)
        open_ = np.repeat(feature >= 0, 2)
        names *= 2
        # Only nodes with rows keep a name, so that histograms stay as small as the tree.
        used, node = np.unique(node, return_inverse=True)
        back = np.full(names, -1)
        back[used] = np.arange(len(used))
        away, open_, names = back[away], open_[used], len(used)
    value = np.bincount(node, target, names) / np.bincount(node, minlength=names)
    return value[node], value[away]


def fold_errors(x: np.ndarray, y: np.ndarray, own: np.ndarray, counts: list[int], depth: int, rate: float,
                bins: int) -> list[float]:
    """Mean absolute error on the other rows after each of ``counts`` trees fitted on
    the ``own`` rows."""
    cuts = [cut_points(c, bins) for c in x[own].T]
    codes = np.stack([np.searchsorted(t, c, side="left") for t, c in zip(cuts, x.T)], axis=1)
    mine, other, label = codes[own], codes[~own], y[own]
    width = int(codes.max()) + 1
    fit, seen = grown(mine, label, other, depth, width)
    errors = {1: float(np.abs(y[~own] - seen).mean())}
    for t in range(2, max(counts) + 1):
        a, b = grown(mine, 2 * (label - fit), other, depth, width)
        fit, seen = fit + rate * a, seen + rate * b
        if t in counts:
            errors[t] = float(np.abs(y[~own] - seen).mean())
    return [errors[c] for c in counts]


def grid_errors(folded: DataFrame, folds: int, grid: dict, bins: int) -> DataFrame:
    """(n_estimators, max_depth, learning_rate, fold, mae, n_train, n_valid) for every
    combination and fold of ``folded`` (features, label and the columns of
    ``time_series_folds``), in one job."""
    counts = sorted(int(c) for c in grid["n_estimators"])
    fits = [(int(d), float(r), j) for d in grid["max_depth"] for r in grid["learning_rate"] for j in range(folds)]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        depth, rate, fold = rows["max_depth"].iat[0], rows["learning_rate"].iat[0], rows["fold"].iat[0]
        rows = rows.sort_values("pos")              # the same sums whatever the order of arrival
        x, y, own = np.stack(rows["x"].to_numpy()), rows["label"].to_numpy(), rows["own"].to_numpy()
        maes = fold_errors(x, y, own, counts, int(depth), float(rate), bins)
        return pd.DataFrame({"n_estimators": counts, "max_depth": depth, "learning_rate": rate, "fold": fold,
                             "mae": maes, "n_train": int(own.sum()), "n_valid": int((~own).sum())})

    first = F.col("n_rows") - F.col("n_folds") * F.col("fold_size")
    each = F.array(*[F.struct(F.lit(d).alias("max_depth"), F.lit(r).alias("learning_rate"), F.lit(j).alias("fold"))
                     for d, r, j in fits])
    own = F.col("pos") < first + F.col("fold") * F.col("fold_size")
    rows = (folded.select("pos", "label", "n_rows", "n_folds", "fold_size", "test_fold",
                          vector_to_array("features").alias("x"), F.explode(each).alias("f"))
            .select("*", "f.*").withColumn("own", own)
            .where(F.col("own") | (F.col("test_fold") == F.col("fold")))
            .select("max_depth", "learning_rate", "fold", "pos", "label", "own", "x"))
    return rows.groupBy("max_depth", "learning_rate", "fold").applyInPandas(
        fit, "n_estimators int, max_depth int, learning_rate double, fold int, mae double, n_train long, n_valid long")
