"""Command-line jobs end to end: monthly trip files -> features -> model -> scored requests."""

from zonegrid.__main__ import main
from zonegrid.sources import requests as reqsrc
from zonegrid.sources import testdata as td
from zonegrid.sources.sinks import read_split

SF = "/root/testdata/sf0.001"


def test_retrieve_train_score(spark, tmp_path):
    from zonegrid.suite.prep import split_rows
    from zonegrid.suite.scoring import cyc_rows
    events = td.table(spark, SF, "events")
    yellow, fhvhv = td.trip_sources(events)
    data = tmp_path / "taxi"
    yellow.write.parquet(str(data / "yellow_tripdata_2024-01.parquet"))
    fhvhv.write.parquet(str(data / "fhvhv_tripdata_2024-01.parquet"))
    out = main(["retrieve", "--data", str(data), "--out", str(tmp_path / "processed"),
                "--split-date", "2024-01-22", "--holidays", "2024-01-01,2024-01-15"])
    feats = read_split(spark, out["features"])
    assert feats.count() == split_rows(spark, SF).count()
    assert {r["split"] for r in out["audit"]} == {"train", "test"}

    weather = str(tmp_path / "weather.parquet")
    td.weather_hourly(events).write.parquet(weather)
    trained = main(["train", "--features", out["features"], "--weather", weather, "--registry",
                    str(tmp_path / "registry"), "--split-date", "2024-01-22", "--n-estimators", "3", "--no-cv",
                    "--weather-start", "2024-01-01", "--weather-end", "2024-01-30"])
    assert 1 <= trained["n_trees"] <= 3 and trained["metrics"]["mae"] >= 0

    reqs = str(tmp_path / "requests.parquet")
    reqsrc.request_bodies(cyc_rows(spark, SF)).write.parquet(reqs)
    scored = main(["score", "--requests", reqs, "--registry", str(tmp_path / "registry"),
                   "--out", str(tmp_path / "scored")])
    n_scored = spark.read.parquet(scored["scored"]).count()
    assert n_scored == scored["valid_counts"]["true"] and scored["valid_counts"]["false"] > 0

    for want in ({"new": 1}, {"unchanged": 1}):
        assert main(["refresh", "--data", str(data / "yellow_tripdata_2024-01.parquet"),
                     "--manifest", str(tmp_path / "manifest")]) == want


def test_interrupted_training_goes_on(spark, tmp_path, monkeypatch):
    """Tuning, too: the second job makes only what the first did not finish."""
    from dataclasses import replace

    from zonegrid.ml import train
    from zonegrid.params import TESTDATA
    from zonegrid.plans import training
    from zonegrid.suite.prep import split_rows, weather_15
    p = replace(TESTDATA, model=replace(TESTDATA.model, n_estimators=2, max_depth=2),
                tuning=replace(TESTDATA.tuning, enabled=True, cv_splits=2, param_grid=(
                    ("n_estimators", (2, 3)), ("max_depth", (2,)), ("learning_rate", (0.1, 0.3)))))
    args = (spark, split_rows(spark, SF), weather_15(spark, SF), p, str(tmp_path / "registry"))
    real = train.fit_with_stopping

    def broken(*_):
        raise KeyboardInterrupt
    monkeypatch.setattr(train, "fit_with_stopping", broken)
    try:
        training.train_and_save(*args, run="r")
        raise AssertionError("the fit should have been interrupted")
    except KeyboardInterrupt:
        pass
    monkeypatch.setattr(train, "fit_with_stopping", real)
    for name in ("cv_scores", "grid_search"):
        monkeypatch.setattr(train, name, broken)
    out = training.train_and_save(*args, run="r")
    assert out["best_grid"]["n_estimators"] in (2, 3) and out["metrics"]["cv_mae_mean"] >= 0
    assert out["n_trees"] <= out["best_grid"]["n_estimators"]
    monkeypatch.setattr(train, "fit_with_stopping", broken)      # the model is a stage, too
    assert training.train_and_save(*args, run="r")["metrics"]["mae"] == out["metrics"]["mae"]


def test_files_a_month_follow_its_size(spark, tmp_path):
    from zonegrid.sources import sinks
    from zonegrid.suite.core import cells
    path = str(tmp_path / "cells")
    sinks.write_aggregate_checkpoint(cells(spark, SF).repartition(64), path)
    months = list((tmp_path / "cells").glob("month_key=*"))
    assert months and all(len(list(m.glob("*.parquet"))) <= 2 for m in months)
    assert sinks.read_aggregate_checkpoint(spark, path).count() == cells(spark, SF).count()
