"""A forest's trees as column expressions: nodes visited, leaf numbers, node statistics.

The trees are model-sized, so they become literals of the plan; rows stay in the JVM
and only one small row per node is aggregated. A missing value follows the right side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees as T

NODES = "tree int, id int, left int, right int, feature int, threshold double, value double, cover double, gain double"


def build(spec: list[tuple[float, list[tuple]]], n_features: int) -> T.Forest:
    """A forest from (weight, [(left, right, feature, threshold, value) a node]); children
    and feature are -1 at leaves. Covers and gains are zero until measured."""
    trees = []
    for _, nodes in spec:
        left, right, feature, threshold, value = (np.array(c) for c in zip(*nodes))
        zero = np.zeros(len(nodes))
        trees.append(T.Tree(feature, threshold.astype(float), left, right, value.astype(float), zero, zero.copy()))
    return T.Forest(trees, np.array([w for w, _ in spec], dtype=float), n_features)


def _descend(tree: T.Tree, x: list[Column], at_leaf: Callable[[int], Column],
             at_split: Callable[[int, Column], Column], node: int = 0) -> Column:
    f = int(tree.feature[node])
    if f < 0:
        return at_leaf(node)
    below = [_descend(tree, x, at_leaf, at_split, int(side[node])) for side in (tree.left, tree.right)]
    return at_split(node, F.when(x[f] <= F.lit(float(tree.threshold[node])), below[0]).otherwise(below[1]))


def _inputs(features: list[str]) -> list[Column]:
    return [F.col(f"`{c}`").cast("double") for c in features]


def visited(forest: T.Forest, features: list[str]) -> Column:
    """array<struct<tree, id>>: every node that a row passes, over all trees."""
    x = _inputs(features)
    per_tree = []
    for t, tree in enumerate(forest.trees):
        one = lambda node, t=t: F.array(F.struct(F.lit(t).alias("tree"), F.lit(node).alias("id")))
        per_tree.append(_descend(tree, x, one, lambda node, rest: F.concat(one(node), rest)))
    return F.concat(*per_tree)


def with_leaf_numbers(df: DataFrame, forest: T.Forest, features: list[str], out: str) -> DataFrame:
    """A vector of leaf numbers, one a tree, leaves counted from left to right as Spark does."""
    x = _inputs(features)
    per_tree = []
    for tree in forest.trees:
        number, stack = {}, [0]
        while stack:
            node = stack.pop()
            if tree.feature[node] < 0:
                number[node] = float(len(number))
            else:
                stack += [int(tree.right[node]), int(tree.left[node])]
        per_tree.append(_descend(tree, x, lambda node, n=number: F.lit(n[node]), lambda _, rest: rest))
    return df.withColumn(out, array_to_vector(F.array(*per_tree)))


def node_statistics(df: DataFrame, forest: T.Forest, features: list[str], label: str) -> DataFrame:
    """tree, id, rows and population variance of ``label`` of every node that rows reach:
    one aggregation, combined before its shuffle to one row a node and task."""
    return (df.select(F.col(f"`{label}`").cast("double").alias("y"), F.inline(visited(forest, features)))
            .groupBy("tree", "id").agg(F.count(F.lit(1)).alias("rows"), F.var_pop("y").alias("variance")))


def measured(forest: T.Forest, statistics: DataFrame) -> T.Forest:
    """The forest with covers, and gains as the variance that a split takes away.
    One row a node comes to the driver. Nodes that no row reaches have neither."""
    trees = [T.Tree(t.feature, t.threshold, t.left, t.right, t.value, np.zeros(len(t.feature)), np.zeros(len(t.feature)))
             for t in forest.trees]
    variance = [np.zeros(len(t.feature)) for t in trees]
    for r in statistics.collect():
        trees[r["tree"]].cover[r["id"]] = r["rows"]
        variance[r["tree"]][r["id"]] = r["variance"]
    for t, var in zip(trees, variance):
        for node in np.flatnonzero((t.feature >= 0) & (t.cover > 0)):
            kids = [t.left[node], t.right[node]]
            t.gain[node] = var[node] - (t.cover[kids] * var[kids]).sum() / t.cover[node]
    return T.Forest(trees, forest.weights, forest.n_features)


def node_frame(spark: SparkSession, forest: T.Forest) -> DataFrame:
    """The forest in the columns of ``trees.node_table``."""
    rows = [(t, i, int(x.left[i]), int(x.right[i]), int(x.feature[i]), float(x.threshold[i]), float(x.value[i]),
             float(x.cover[i]), float(x.gain[i])) for t, x in enumerate(forest.trees) for i in range(len(x.feature))]
    return spark.createDataFrame(rows, NODES)
