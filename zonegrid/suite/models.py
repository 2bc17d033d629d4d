"""Model queries (rows-only checks: model numbers have no SQL oracle).

One training per session and data folder is shared by all of them: the
driver's sequence of model queries fits the booster once.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import functions as F

from ..ml import explain, registry, train
from ..ml import trees as T
from ..operators import folds, matrix
from ..operators import requests as R
from ..plans import scoring as scoring_plan
from ..plans import training
from ..session import shared_path
from ..sources.files import folder_fingerprint, is_missing_path
from .base import P, register, rounded
from .prep import split_rows, weather_15
from .scoring import valid_requests

# The training job always runs expanding-window CV (folds fitted concurrently).
RUN_CV = True

_TRAINED: dict = {}


def data_fingerprint(spark, sf_dir: str) -> str:
    """Paths, sizes and times of the input files + parameters + code version (registry key)."""
    from .. import __version__
    return hashlib.sha256(f"{__version__}:{P!r}:{folder_fingerprint(spark, sf_dir)}".encode()).hexdigest()[:16]


class Trained:
    """The latest registered model for these inputs; trained when there is none
    (a serving process loads the registered model instead of retraining)."""

    def __init__(self, spark, sf_dir):
        self.base = shared_path(spark, f"registry-{data_fingerprint(spark, sf_dir)}")
        if not self._load(spark, sf_dir):
            out = training.train_and_save(spark, split_rows(spark, sf_dir), weather_15(spark, sf_dir), P,
                                          self.base, run_cv=RUN_CV)
            self.model, self.features, self.path = out["model"], out["features"], out["path"]
            self.data, self.test_predictions = out["data"], out["test_predictions"]
            self.calibration, self.metrics, self.n_trees = out["calibration"], out["metrics"], out["n_trees"]
        self.forest = T.load_forest(spark, self.path, len(self.features))
        self.leaves = T.leaf_table(self.forest)

    def _load(self, spark, sf_dir) -> bool:
        try:
            rec = registry.latest(registry.registry(spark, self.base)).first()
        except AnalysisException as e:
            if not is_missing_path(e):
                raise
            return False   # no registry yet: train
        model = GBTRegressionModel.load(rec["artifact"])
        self.model, self.features, self.path = model, list(rec["features"]), rec["artifact"]
        self.calibration, self.metrics, self.n_trees = dict(rec["calibration"]), dict(rec["metrics"]), rec["n_trees"]
        data, feats = training.prepare(split_rows(spark, sf_dir), weather_15(spark, sf_dir))
        if feats != self.features:
            return False
        self.data = data
        te = data.where(F.col("split") == "test")
        self.test_predictions = model.transform(te).select(
            "Zone", "Time_Bin", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
        return True


def trained(spark, sf_dir) -> Trained:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        _TRAINED[key] = Trained(spark, sf_dir)
    return _TRAINED[key]


@register("gbt_predict")
def q_gbt_predict(spark, sf_dir):
    return rounded(trained(spark, sf_dir).test_predictions)


@register("grid_search")
def q_grid_search(spark, sf_dir):
    """Tail sample of train -> expanding-window grid search -> best by mean MAE."""
    data, _ = training.prepare(split_rows(spark, sf_dir), weather_15(spark, sf_dir))
    tail = folds.tail_sample(data.where(F.col("split") == "train"), P.tuning.max_samples)
    found = train.grid_search(tail.select("Zone", "Time_Bin", "features", "label"), dict(P.tuning.param_grid),
                              P.tuning.cv_splits, max_bins=P.model.max_bins).checkpoint(eager=True)
    names = ["n_estimators", "max_depth", "learning_rate"]
    best = train.best_of(found).select(*names, F.lit(True).alias("is_best"))
    return rounded(found.join(best, names, "left").withColumn("is_best", F.coalesce("is_best", F.lit(False))))


def request_matrix(spark, sf_dir):
    t = trained(spark, sf_dir)
    feats = R.request_features(valid_requests(spark, sf_dir))
    return R.align_to_manifest(feats, t.features), t


@register("score_requests")
def q_score_requests(spark, sf_dir):
    """Predict + level + confidence + holdout band + recommendation."""
    t = trained(spark, sf_dir)
    return rounded(scoring_plan.score_valid(valid_requests(spark, sf_dir), t.model, t.features, t.calibration, t.leaves))


@register("model_registry")
def q_model_registry(spark, sf_dir):
    t = trained(spark, sf_dir)
    return registry.registry(spark, t.base)


@register("model_info")
def q_model_info(spark, sf_dir):
    t = trained(spark, sf_dir)
    return registry.json_safe_metrics(registry.latest(registry.registry(spark, t.base)))


@register("run_log")
def q_run_log(spark, sf_dir):
    t = trained(spark, sf_dir)
    return registry.runs(spark, t.base)


@register("gain_importance")
def q_gain_importance(spark, sf_dir):
    t = trained(spark, sf_dir)
    return rounded(explain.gain_importance(spark, t.path, t.features))


@register("tree_dispersion")
def q_tree_dispersion(spark, sf_dir):
    aligned, t = request_matrix(spark, sf_dir)
    scored = explain.with_leaves(t.model).transform(matrix.assemble(aligned, t.features, label=None))
    return rounded(explain.tree_dispersion(scored, t.leaves).select(
        "request_id", "n_trees", "forest_prediction", "tree_std", "confidence", "confidence_text"))


@register("shap_topk")
def q_shap_topk(spark, sf_dir):
    aligned, t = request_matrix(spark, sf_dir)
    return rounded(explain.shap_topk(aligned, t.forest, t.features, k=12))


@register("stream_score_requests")
def q_stream_score_requests(spark, sf_dir):
    """The scoring path as a file-source stream (availableNow) over the landed
    request bodies; the scored rows equal the batch path's."""
    from ..sources.sinks import run_path
    from ..streaming import scoring as stream_scoring
    from .scoring import _BODIES, landed_bodies
    t = trained(spark, sf_dir)
    landed_bodies(spark, sf_dir)
    src = _BODIES[(spark.sparkContext.applicationId, sf_dir)]
    out, ckpt = run_path(spark, "stream-scored"), run_path(spark, "stream-checkpoint")
    q = stream_scoring.start(spark, src, out, ckpt, t.model, t.features, t.calibration, t.leaves)
    q.awaitTermination()
    return rounded(stream_scoring.read_scored(spark, out).drop("batch_id"))
