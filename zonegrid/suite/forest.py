"""Importance, spread, SHAP and fold scores of a fixed forest over the training rows.

A trained model's numbers have no SQL counterpart, but the operators that explain and
score a model do: here they work on a small forest whose splits are written down, with
covers and gains measured on the train rows. The oracles walk the same node table by
recursion, and take Shapley values by their definition over all feature subsets.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..ml import explain, walk
from ..operators import folds, metrics
from .base import cte, final_sql, per_session, register, rounded
from .evaluate import MAT
from .prep import training_rows

FEATURES = ["DemandVelocity_t", "Lag_DER_t-15", "SupplyElasticity", "Zone", "day_of_week"]

# (weight, nodes); a node is (left, right, feature, threshold, value)
FOREST = [
    (1.0, [(1, 2, 1, 0.75, 0.0), (-1, -1, -1, 0.0, 0.9), (-1, -1, -1, 0.0, 1.3)]),
    (0.5, [(1, 4, 2, 0.5, 0.0), (2, 3, 3, 120.0, 0.0), (-1, -1, -1, 0.0, 0.21), (-1, -1, -1, 0.0, -0.13),
           (5, 6, 0, 0.5, 0.0), (-1, -1, -1, 0.0, 0.05), (-1, -1, -1, 0.0, 0.34)]),
    (0.5, [(1, 4, 4, 4.0, 0.0), (2, 3, 1, 1.0, 0.0), (-1, -1, -1, 0.0, -0.07), (-1, -1, -1, 0.0, 0.16),
           (-1, -1, -1, 0.0, 0.11)]),
    (0.5, [(1, 2, 0, -0.5, 0.0), (-1, -1, -1, 0.0, -0.19), (3, 4, 2, 1.0, 0.0), (-1, -1, -1, 0.0, 0.08),
           (-1, -1, -1, 0.0, -0.23)]),
    (0.5, [(1, 4, 3, 150.0, 0.0), (2, 3, 3, 60.0, 0.0), (-1, -1, -1, 0.0, 0.12), (-1, -1, -1, 0.0, -0.04),
           (-1, -1, -1, 0.0, 0.03)]),
]

SQL_FOREST = "forest(tree, weight, id, l, r, feature, threshold, value) AS (VALUES " + ", ".join(
    f"({t}, {w}::DOUBLE, {i}, {a}, {b}, {f}, {c}::DOUBLE, {v}::DOUBLE)"
    for t, (w, nodes) in enumerate(FOREST) for i, (a, b, f, c, v) in enumerate(nodes)) + ")"

SQL_ROWS = (f'x AS (SELECT split, Zone, Time_Bin, "{fixed.TARGET}" AS y, row_number() OVER (ORDER BY Zone, Time_Bin) AS rid, ['
            + ", ".join(f'CAST("{c}" AS DOUBLE)' for c in FEATURES) + "] AS fx FROM mat)")

SQL_WALK = """
walk AS (
  SELECT rid, fx, tree, 0 AS node FROM x, (SELECT DISTINCT tree FROM forest)
  UNION ALL
  SELECT w.rid, w.fx, w.tree, CASE WHEN w.fx[f.feature + 1] <= f.threshold THEN f.l ELSE f.r END
  FROM walk w JOIN forest f ON f.tree = w.tree AND f.id = w.node WHERE f.l >= 0),
stat AS (SELECT tree, node, count(*) AS n, var_pop(y) AS v
         FROM walk JOIN x USING (rid) WHERE split = 'train' GROUP BY tree, node),
leaf AS (SELECT w.rid, w.tree, f.weight * f.value AS v
         FROM walk w JOIN forest f ON f.tree = w.tree AND f.id = w.node WHERE f.l < 0)"""


def _sql(*parts: str) -> str:
    return cte(*MAT, SQL_FOREST, SQL_ROWS, SQL_WALK, *parts).replace("WITH", "WITH RECURSIVE", 1)


@per_session
def measured_forest(spark, sf_dir):
    """The fixed forest with covers and gains of the train rows."""
    rows, _ = training_rows(spark, sf_dir)
    plain = walk.build(FOREST, len(FEATURES))
    train = rows.where(F.col("split") == "train")
    return walk.measured(plain, walk.node_statistics(train, plain, FEATURES, fixed.TARGET))


def dispersion(spark, sf_dir):
    rows, _ = training_rows(spark, sf_dir)
    plain = walk.build(FOREST, len(FEATURES))
    return explain.tree_dispersion(walk.with_leaf_numbers(rows, plain, FEATURES, explain.LEAF),
                                   explain.T.leaf_table(plain))


@register("forest_gain", final_sql(_sql(f"""
per AS (SELECT f.feature, avg((s.v - (coalesce(a.n * a.v, 0) + coalesce(b.n * b.v, 0)) / s.n) * s.n) AS gain
        FROM forest f JOIN stat s ON s.tree = f.tree AND s.node = f.id
        LEFT JOIN stat a ON a.tree = f.tree AND a.node = f.l LEFT JOIN stat b ON b.tree = f.tree AND b.node = f.r
        WHERE f.l >= 0 GROUP BY f.feature),
result AS (SELECT {FEATURES!r}[feature + 1] AS feature, gain, gain / sum(gain) OVER () AS gain_fraction FROM per)"""),
    ["feature", "gain", "gain_fraction"], {"gain", "gain_fraction"}))
def q_forest_gain(spark, sf_dir):
    """Mean gain of a feature's splits and its share."""
    return rounded(explain.gain_shares(walk.node_frame(spark, measured_forest(spark, sf_dir)), FEATURES))


_SPREAD = ["split", "Zone", "Time_Bin", "n_trees", "forest_prediction", "tree_std", "confidence", "confidence_text"]


@register("forest_dispersion", final_sql(_sql("""
agg AS (SELECT rid, CAST(count(*) AS INTEGER) AS n_trees, sum(v) AS forest_prediction,
               stddev_pop(v) FILTER (WHERE tree > 0) AS tree_std FROM leaf GROUP BY rid),
conf AS (SELECT *, least(greatest(1 / (1 + tree_std), 0.15::DOUBLE), 0.98::DOUBLE) AS confidence FROM agg),
result AS (SELECT *, CAST(CAST(round_even(confidence * 100, 0) AS INTEGER) AS VARCHAR) || '%' AS confidence_text
           FROM conf JOIN x USING (rid))"""), _SPREAD, {"forest_prediction", "tree_std", "confidence"}))
def q_forest_dispersion(spark, sf_dir):
    """Spread over the trees, confidence and its text."""
    return rounded(dispersion(spark, sf_dir).select(*_SPREAD))


@register("forest_shap", final_sql(_sql(f"""
used AS (SELECT tree, bit_or(1 << feature) AS used, count(DISTINCT feature) AS m FROM forest WHERE l >= 0 GROUP BY tree),
sets AS (SELECT tree, used, m, CAST(s AS INTEGER) AS s FROM used, range({1 << len(FEATURES)}) AS r(s)
         WHERE (CAST(s AS INTEGER) | used) = used),
kids AS (SELECT f.tree, f.id AS parent, f.feature, f.threshold, k.child, k.is_left, coalesce(c.n, 0) / p.n AS share
         FROM (SELECT tree, id, l AS child, true AS is_left FROM forest WHERE l >= 0
               UNION ALL SELECT tree, id, r, false FROM forest WHERE l >= 0) k
         JOIN forest f ON f.tree = k.tree AND f.id = k.id JOIN stat p ON p.tree = k.tree AND p.node = k.id
         LEFT JOIN stat c ON c.tree = k.tree AND c.node = k.child),
cond AS (
  SELECT rid, fx, tree, s, 0 AS node, 1::DOUBLE AS w FROM x, sets
  UNION ALL
  SELECT c.rid, c.fx, c.tree, c.s, k.child, c.w * CASE WHEN (c.s >> k.feature) & 1 = 1 THEN 1 ELSE k.share END
  FROM cond c JOIN kids k ON k.tree = c.tree AND k.parent = c.node
  WHERE (c.s >> k.feature) & 1 = 0 OR (c.fx[k.feature + 1] <= k.threshold) = k.is_left),
val AS (SELECT c.rid, c.tree, c.s, sum(c.w * f.weight * f.value) AS v
        FROM cond c JOIN forest f ON f.tree = c.tree AND f.id = c.node WHERE f.l < 0 GROUP BY ALL),
phi AS (SELECT a.rid, i.f, sum((b.v - a.v) * factorial(bit_count(a.s)) * factorial(CAST(t.m - bit_count(a.s) - 1 AS INTEGER))
                               / factorial(CAST(t.m AS INTEGER))) AS shap_value
        FROM val a JOIN sets t ON t.tree = a.tree AND t.s = a.s
        JOIN (SELECT CAST(f AS INTEGER) AS f FROM range({len(FEATURES)}) AS r(f)) i
          ON (t.used >> i.f) & 1 = 1 AND (a.s >> i.f) & 1 = 0
        JOIN val b ON b.rid = a.rid AND b.tree = a.tree AND b.s = (a.s | (1 << i.f))
        GROUP BY a.rid, i.f),
base AS (SELECT rid, sum(v) AS expected_value FROM val WHERE s = 0 GROUP BY rid),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY abs(shap_value) DESC, f) AS INTEGER) AS rank FROM phi),
result AS (SELECT CAST(x.Zone AS VARCHAR) || ' ' || CAST(x.Time_Bin AS VARCHAR) AS cell, expected_value, rank,
                  {FEATURES!r}[f + 1] AS feature, shap_value
           FROM ranked JOIN base USING (rid) JOIN x USING (rid) WHERE rank <= 4)"""),
    ["cell", "expected_value", "rank", "feature", "shap_value"], {"expected_value", "shap_value"}))
def q_forest_shap(spark, sf_dir):
    """The four features of largest contribution of every training row."""
    rows, _ = training_rows(spark, sf_dir)
    cell = F.concat_ws(" ", F.col("Zone").cast("string"), F.col("Time_Bin").cast("string"))
    top = explain.shap_topk(rows.withColumn("cell", cell), measured_forest(spark, sf_dir), FEATURES, k=4, id_col="cell")
    ranked = top.select("cell", "expected_value", F.posexplode("top_features").alias("at", "top"))
    return rounded(ranked.select("cell", "expected_value", (F.col("at") + 1).alias("rank"), "top.feature", "top.shap_value"))


@register("forest_folds", final_sql(_sql("""
pred AS (SELECT rid, sum(v) AS p FROM leaf GROUP BY rid),
pos AS (SELECT y, p, row_number() OVER (ORDER BY Time_Bin, Zone) - 1 AS pos, count(*) OVER () AS n
        FROM x JOIN pred USING (rid) WHERE split = 'train'),
siz AS (SELECT *, least(5, greatest(2, n // 100)) AS k, n // (least(5, greatest(2, n // 100)) + 1) AS size FROM pos),
result AS (SELECT (pos - (n - k * size)) // size AS test_fold, avg(abs(y - p)) AS mae
           FROM siz WHERE size > 0 AND pos >= n - k * size GROUP BY 1)"""), ["test_fold", "mae"], {"mae"}))
def q_forest_folds(spark, sf_dir):
    """M2: mean absolute error of the forest in every fold of the expanding windows."""
    scored = dispersion(spark, sf_dir).where(F.col("split") == "train").select(
        "Zone", "Time_Bin", F.col(f"`{fixed.TARGET}`").alias("y_true"), F.col("forest_prediction").alias("y_pred"))
    return rounded(metrics.fold_mae(folds.time_series_folds(scored)))
