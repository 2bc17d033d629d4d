"""Tree ensembles as arrays: per-tree outputs, dispersion, gain, TreeSHAP.

A saved ``GBTRegressionModel`` keeps its nodes in ``<path>/data``
(``treeID, nodeData{id, prediction, impurityStats, rawCount, gain, leftChild,
rightChild, split{featureIndex, leftCategoriesOrThreshold}}``) and the tree
weights in ``<path>/treesMetadata``. The node table is bounded by the model
size (trees x 2^(depth+1) rows), so it is read once, turned into NumPy arrays
and shipped to executors; the rows being scored never leave their partitions.

TreeSHAP: for one leaf with value ``v``, the path-dependent conditional
expectation is a product game over the unique features ``P`` on its path:
feature ``j`` contributes ``a_j(x)`` (1 if ``x`` follows every split on ``j``)
when present and ``b_j`` (product of cover fractions of those splits) when
absent. Its exact Shapley values are
``phi_i = v (a_i - b_i) sum_k c_k k!(d-k-1)!/d!`` with ``c_k`` the
coefficients of ``prod_{j != i} (b_j + a_j t)`` (Lundberg et al., 2018/2020,
path-dependent TreeSHAP). Summed over leaves and trees, ``base + sum(phi)``
equals the prediction.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Tree:
    feature: np.ndarray    # split feature per node, -1 for leaves
    threshold: np.ndarray  # go left when x <= threshold
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray      # node prediction (used at leaves)
    cover: np.ndarray      # training rows reaching the node
    gain: np.ndarray


@dataclass
class Forest:
    trees: list
    weights: np.ndarray
    n_features: int


def node_table(spark: SparkSession, model_path: str) -> DataFrame:
    d = spark.read.parquet(f"{model_path}/data")
    return d.select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"),
        F.col("nodeData.prediction").alias("value"),
        F.coalesce(F.get(F.col("nodeData.impurityStats"), 0), F.col("nodeData.rawCount").cast("double")).alias("cover"),
        F.col("nodeData.gain").alias("gain"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0).alias("threshold"),
    )


def tree_weights(spark: SparkSession, model_path: str) -> DataFrame:
    m = spark.read.parquet(f"{model_path}/treesMetadata")
    return m.select(F.col(m.columns[0]).alias("tree"), F.col(m.columns[-1]).alias("weight"))


def load_forest(spark: SparkSession, model_path: str, n_features: int) -> Forest:
    """Model-sized arrays (bounded by trees x nodes), built on the driver."""
    nodes = node_table(spark, model_path).toPandas()
    weights = tree_weights(spark, model_path).toPandas().sort_values("tree")
    trees = []
    for t in sorted(nodes["tree"].unique()):
        g = nodes[nodes["tree"] == t].sort_values("id")
        n = int(g["id"].max()) + 1
        arr = {k: np.zeros(n) for k in ("threshold", "value", "cover", "gain")}
        feature = np.full(n, -1, dtype=np.int64)
        left = np.full(n, -1, dtype=np.int64)
        right = np.full(n, -1, dtype=np.int64)
        ids = g["id"].to_numpy()
        is_split = g["left"].to_numpy() >= 0
        feature[ids[is_split]] = g["feature"].to_numpy()[is_split]
        left[ids] = g["left"].to_numpy()
        right[ids] = g["right"].to_numpy()
        for k in arr:
            arr[k][ids] = np.nan_to_num(g[k].to_numpy(dtype=float))
        trees.append(Tree(feature, arr["threshold"], left, right, arr["value"], arr["cover"], arr["gain"]))
    return Forest(trees, weights["weight"].to_numpy(dtype=float), n_features)


def tree_outputs(forest: Forest, X: np.ndarray) -> np.ndarray:
    """(rows, trees) matrix of weight_t * tree_t(x)."""
    n = X.shape[0]
    out = np.empty((n, len(forest.trees)))
    rows = np.arange(n)
    for t, (tree, w) in enumerate(zip(forest.trees, forest.weights)):
        idx = np.zeros(n, dtype=np.int64)
        while True:
            f = tree.feature[idx]
            inner = f >= 0
            if not inner.any():
                break
            x = X[rows, np.where(inner, f, 0)]
            nxt = np.where(x <= tree.threshold[idx], tree.left[idx], tree.right[idx])
            idx = np.where(inner, nxt, idx)
        out[:, t] = w * tree.value[idx]
    return out


# ---------------------------------------------------------------- TreeSHAP ---

@dataclass
class PathGroup:
    """The leaves of a forest whose paths test ``d`` different features, as arrays."""
    value: np.ndarray      # (leaves,) weighted leaf values
    feature: np.ndarray    # (leaves, d)
    cover: np.ndarray      # (leaves, d) product of the cover fractions of a feature's splits
    above: np.ndarray      # (leaves, d) a row follows the path if above < x <= upto
    upto: np.ndarray
    weights: np.ndarray    # (d,) k! (d-k-1)! / d!
    table: np.ndarray      # (leaves, 2^d, d) contributions by the features that follow; empty if too large


TABLE_BYTES = 64 * 1024 * 1024   # of all tables of a forest


def contributions(g: PathGroup, a: np.ndarray, i: int) -> np.ndarray:
    """(rows, leaves): what the features at position ``i`` of the paths contribute where
    ``a`` (rows, leaves, d) tells which splits are followed."""
    coefs = np.ones((*a.shape[:2], 1))
    for j in range(a.shape[2]):
        if j != i:
            more = np.zeros((*a.shape[:2], coefs.shape[2] + 1))
            more[:, :, :-1] += coefs * g.cover[:, j, None]
            more[:, :, 1:] += coefs * a[:, :, j, None]
            coefs = more
    return g.value * (a[:, :, i] - g.cover[:, i]) * (coefs @ g.weights)


def case_table(g: PathGroup) -> np.ndarray:
    """A contribution depends on the row only by which of the ``d`` features follow the
    path: 2^d cases a leaf, worked out once for all rows."""
    leaves, d = g.feature.shape
    cases = ((np.arange(1 << d)[:, None] >> np.arange(d)) & 1).astype(float)
    a = np.broadcast_to(cases[:, None, :], (1 << d, leaves, d))
    return np.ascontiguousarray(np.stack([contributions(g, a, i) for i in range(d)], axis=2).transpose(1, 0, 2))


def leaf_paths(tree: Tree) -> list[tuple[float, dict]]:
    """(value, {feature: (cover, above, upto)}) of every leaf."""
    out, stack = [], [(0, {})]
    while stack:
        node, path = stack.pop()
        f = int(tree.feature[node])
        if f < 0:
            out.append((float(tree.value[node]), path))
            continue
        cover, above, upto = path.get(f, (1.0, -np.inf, np.inf))
        own, cut = tree.cover[node], tree.threshold[node]
        for child, ends in ((int(tree.left[node]), (above, min(upto, cut))),
                            (int(tree.right[node]), (max(above, cut), upto))):
            share = tree.cover[child] / own if own > 0 else 0.0
            stack.append((child, {**path, f: (cover * share, *ends)}))
    return out


def path_groups(forest: Forest) -> list[PathGroup]:
    """All leaves of the forest, grouped by the number of features on their path."""
    by_length: dict[int, list] = {}
    for tree, w in zip(forest.trees, forest.weights):
        for value, path in leaf_paths(tree):
            by_length.setdefault(len(path), []).append((w * value, sorted(path), [path[f] for f in sorted(path)]))
    out, room = [], TABLE_BYTES
    for d, leaves in sorted(by_length.items()):
        ends = np.array([x[2] for x in leaves], dtype=float).reshape(len(leaves), d, 3)
        g = PathGroup(np.array([x[0] for x in leaves]), np.array([x[1] for x in leaves], dtype=np.int64).reshape(-1, d),
                      ends[:, :, 0], ends[:, :, 1], ends[:, :, 2],
                      np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)]), np.zeros(0))
        size = 8 * len(leaves) * d << d
        if 0 < size <= room:
            g.table, room = case_table(g), room - size
        out.append(g)
    return out


CELLS = 1 << 20   # rows x leaves x path features held at once


def shap_values(forest: Forest, X: np.ndarray, groups: list[PathGroup] | None = None) -> tuple[float, np.ndarray]:
    """(expected value, (rows, features) SHAP matrix): one array operation a feature
    position for all leaves of a path length."""
    groups = path_groups(forest) if groups is None else groups
    phi = np.zeros((len(X), forest.n_features))
    base = sum(float((g.value * g.cover.prod(axis=1)).sum()) for g in groups)
    for g in groups:
        leaves, d = g.feature.shape
        if d == 0:
            continue
        target = np.eye(forest.n_features)[g.feature]                    # (leaves, d, features)
        cases = g.table.reshape(-1, d)
        first = np.arange(leaves) << d
        step = max(1, CELLS // (leaves * d))
        for at in range(0, len(X), step):
            x = X[at:at + step]
            follows = [(x[:, g.feature[:, i]] > g.above[:, i]) & (x[:, g.feature[:, i]] <= g.upto[:, i]) for i in range(d)]
            if len(cases):
                own = cases[first + sum(f.astype(np.int64) << i for i, f in enumerate(follows))]
            else:
                a = np.stack(follows, axis=2).astype(float)
                own = np.stack([contributions(g, a, i) for i in range(d)], axis=2)
            phi[at:at + step] += own.reshape(len(x), -1) @ target.reshape(leaves * d, -1)
    return base, phi


def leaf_table(forest: Forest) -> list[list[float]]:
    """Weighted leaf values per tree, leaves from left to right as Spark numbers them."""
    out = []
    for tree, w in zip(forest.trees, forest.weights):
        values, stack = [], [0]
        while stack:
            node = stack.pop()
            if tree.feature[node] < 0:
                values.append(float(w * tree.value[node]))
            else:
                stack += [int(tree.right[node]), int(tree.left[node])]
        out.append(values)
    return out
