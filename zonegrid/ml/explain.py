"""Distributed explanation and dispersion scoring.

Rows stay in their partitions. Dispersion looks the leaf numbers that Spark's model
gives up in a literal table of leaf values; SHAP runs over Arrow batches. What is
shipped is measured first. Top-k selection and formatting are array functions.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import surge
from . import trees as T
from .trees import Forest, PathGroup, shap_values


def gain_importance(spark: SparkSession, model_path: str, names: list[str]) -> DataFrame:
    """Mean split gain per feature (gain x rows at the split), share of the
    total, unused features absent, ordered by gain (A8, T5)."""
    return gain_shares(T.node_table(spark, model_path), names)


def gain_shares(nodes: DataFrame, names: list[str]) -> DataFrame:
    """``gain_importance`` of a table of nodes."""
    per = nodes.where(F.col("left") >= 0).groupBy("feature").agg(F.avg(F.col("gain") * F.col("cover")).alias("gain"))
    names_arr = F.array(*[F.lit(n) for n in names])
    total = F.sum("gain").over(Window.partitionBy())
    return (per.select(F.element_at(names_arr, F.col("feature") + 1).alias("feature"), "gain",
                       (F.col("gain") / total).alias("gain_fraction"))
            .orderBy(F.desc("gain"), "feature"))


def _matrix(pdf: pd.DataFrame, features: list[str]) -> np.ndarray:
    return pdf[features].to_numpy(dtype=float)


MAX_BROADCAST_BYTES = 256 * 1024 * 1024
MAX_LITERAL = 16 * 1024 * 1024


def shipped_bytes(groups: list[T.PathGroup]) -> int:
    """Size of the arrays that SHAP ships: they grow with the leaves of the model. The
    tables of cases beside them have ``T.TABLE_BYTES`` at most."""
    return sum(x.nbytes for g in groups for x in (g.value, g.feature, g.cover, g.above, g.upto, g.weights))


LEAF = "tree_leaf"


def with_leaves(model):
    """The model with a column of leaf numbers in its output."""
    return model.copy().setLeafCol(LEAF)


def tree_dispersion(scored: DataFrame, leaves: list[list[float]]) -> DataFrame:
    """``scored`` (of ``with_leaves``) with n_trees, forest_prediction, tree_std,
    confidence and its text (A9, F12). Tree 0 carries the base level, like a booster's
    base score, so the spread (ddof 0) is taken over the later trees."""
    text = json.dumps(leaves)
    if len(text) > MAX_LITERAL:
        raise ValueError(f"leaf values of {len(text)} bytes exceed the limit of a literal, {MAX_LITERAL}")
    values = F.from_json(F.lit(text), "array<array<double>>")   # folded once, when the query is planned
    per_tree = F.transform(vector_to_array(LEAF), lambda leaf, t: F.get(F.get(values, t), leaf.cast("int")))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    n = F.col("n_trees")
    later = F.slice("per_tree", 2, len(leaves))
    mean = total(later) / (n - 1)
    out = (scored.withColumn("per_tree", per_tree).withColumn("n_trees", F.size("per_tree"))
           .withColumn("forest_prediction", total(F.col("per_tree")))
           .withColumn("tree_mean", F.when(n > 1, mean))
           .withColumn("tree_std", F.when(n > 1, F.sqrt(total(F.transform(
               later, lambda x: (x - F.col("tree_mean")) * (x - F.col("tree_mean")))) / (n - 1)))))
    conf = surge.confidence_from_std(F.col("tree_std"), n)
    return (out.withColumn("confidence", conf).withColumn("confidence_text", surge.percent_text(conf))
            .drop("per_tree", "tree_mean", LEAF))


def shap_topk(df: DataFrame, forest: T.Forest, features: list[str], k: int = 12,
              id_col: str = "request_id") -> DataFrame:
    """Expected value + the ``k`` features with the largest |SHAP| per row."""
    if not 4 <= k <= 64:
        raise ValueError("max_features must be within 4..64")
    groups = T.path_groups(forest)
    if shipped_bytes(groups) > MAX_BROADCAST_BYTES:
        raise ValueError(f"leaf paths of {shipped_bytes(groups)} bytes exceed the broadcast limit {MAX_BROADCAST_BYTES}")
    shared = df.sparkSession.sparkContext.broadcast([tuple(vars(g).values()) for g in groups])
    frame = Forest([], forest.weights, forest.n_features)

    def run(batches):
        paths = [PathGroup(*g) for g in shared.value]
        for pdf in batches:
            base, phi = shap_values(frame, _matrix(pdf, features), paths)
            yield pd.DataFrame({id_col: pdf[id_col], "expected_value": base, "shap": list(phi)})

    out = df.select(id_col, *[F.col(f"`{c}`") for c in features]).mapInPandas(
        run, f"{id_col} string, expected_value double, shap array<double>")
    names = F.array(*[F.lit(n) for n in features])
    pairs = F.arrays_zip(names.alias("feature"), F.col("shap").alias("shap_value"))
    ranked = F.array_sort(pairs, lambda a, b: F.signum(F.abs(b["shap_value"]) - F.abs(a["shap_value"])).cast("int"))
    return out.select(id_col, "expected_value", F.slice(ranked, 1, k).alias("top_features"),
                      F.aggregate("shap", F.lit(0.0), lambda acc, x: acc + x).alias("shap_sum"))
