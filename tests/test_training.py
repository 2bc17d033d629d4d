"""The training job: a failure of a part is no result of the whole (M7)."""

import datetime as dt
import math

import pytest

from zonegrid.ml import registry, train
from zonegrid.operators.matrix import assemble
from zonegrid.params import ModelParams, Params
from zonegrid.plans import training

PARAMS = Params(model=ModelParams(n_estimators=2, max_depth=2, early_stopping_rounds=2))


@pytest.fixture
def job(spark, tmp_path, monkeypatch):
    """A function that trains on its number of train rows; and the registry's folder."""
    def run(n_train, **more):
        t0 = dt.datetime(2024, 1, 1)
        rows = [("train" if i < n_train else "test", 1, t0 + dt.timedelta(minutes=15 * i), float(i % 3), float(i % 5))
                for i in range(n_train + 4)]
        df = spark.createDataFrame(rows, "split string, Zone long, Time_Bin timestamp_ntz, a double, `Target_DER_t+15` double")
        data = assemble(df, ["a"]).select("split", "Zone", "Time_Bin", "features", "label")
        monkeypatch.setattr(training, "prepare", lambda *_: (data, ["a"]))
        return training.train_and_save(spark, None, None, PARAMS, str(tmp_path), **more)
    return run, tmp_path


def test_a_failed_cross_validation_fails_the_job(spark, job, monkeypatch):
    run, base = job
    real = train.cv_scores

    def lost(*_, **__):
        raise RuntimeError("a fold was lost")
    monkeypatch.setattr(train, "cv_scores", lost)
    for name in (None, "r"):
        with pytest.raises(RuntimeError, match="a fold was lost"):
            run(30, run=name)
    assert not any((base / kept).exists() for kept in ("models", "registry", "training_runs"))
    monkeypatch.setattr(train, "cv_scores", real)
    monkeypatch.setattr(train, "fit_with_stopping", lost)     # a named run has kept its model
    out = run(30, run="r")
    assert out["metrics"]["cv_mae_mean"] > 0 and out["metrics"]["cv_mae_std"] >= 0
    records = registry.registry(spark, str(base)).collect()
    assert [r.metrics["cv_mae_mean"] for r in records] == [out["metrics"]["cv_mae_mean"]]
    assert registry.runs(spark, str(base)).first().metrics["cv_mae_mean"] == out["metrics"]["cv_mae_mean"]


def test_a_fold_without_a_number_is_a_failure(job, monkeypatch):
    run, base = job
    monkeypatch.setattr(train.GBTRegressionModel, "evaluateEachIteration",
                        lambda self, rows, loss: [math.nan if loss == "absolute" else 1.0])
    with pytest.raises(ArithmeticError, match="not a finite number"):
        run(30)
    assert not (base / "registry").exists()


@pytest.mark.parametrize("n_train", [1, 2])
def test_rows_too_few_for_folds_have_no_score(job, n_train):
    """As before: no folds is no failure, and the model is trained."""
    run, _ = job
    out = run(n_train)
    assert math.isnan(out["metrics"]["cv_mae_mean"]) and math.isnan(out["metrics"]["cv_mae_std"])
    assert out["n_train"] == n_train and out["n_trees"] >= 1


def test_the_record_says_why_there_is_no_score(spark, job):
    run, base = job
    run(2)
    run(30, run_cv=False)
    run(30)
    said = [r.data.get("cross_validation") for r in registry.registry(spark, str(base)).orderBy("trained_at").collect()]
    assert said == ["none: 2 train rows make no folds", "none: switched off", None]


def test_a_job_that_fails_at_its_run_log_has_no_record(job, monkeypatch):
    run, base = job

    def full(*_, **__):
        raise OSError("the disk is full")
    monkeypatch.setattr(registry, "log_run", full)
    with pytest.raises(OSError, match="the disk is full"):
        run(30, run_cv=False)
    assert not (base / "registry").exists()


def test_the_run_log_says_why_there_is_no_score(spark, job):
    """It keeps finite metrics only, so that these scores are not in it."""
    run, base = job
    run(2)
    run(30, run_cv=False)
    run(30)
    found = registry.runs(spark, str(base)).orderBy("logged_at").collect()
    assert [r.tags.get("cross_validation") for r in found] == ["none: 2 train rows make no folds", "none: switched off", None]
    assert ["cv_mae_mean" in r.metrics for r in found] == [False, False, True]
    assert {r.tags["n_features"] for r in found} == {"1"}
