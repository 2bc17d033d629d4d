"""Weather upsampling (fixture 1.7), metrics and calibration (1.6), folds, positions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonegrid.operators import folds, metrics, weather
from zonegrid.operators.position import global_position

T0 = dt.datetime(2025, 1, 1)


def _hourly(spark):
    rows = [("nyc", T0 + dt.timedelta(hours=i), t, p) for i, (t, p) in enumerate(
        [(10.0, 0.0), (11.0, 0.5), (12.0, 1.0), (13.0, 0.5)])]
    return spark.createDataFrame(rows, "station string, ts timestamp_ntz, temp double, precip double")


def test_upsample_exact(spark):
    out = weather.upsample(_hourly(spark), "exact").orderBy("Time_Bin").collect()
    assert len(out) == 16
    assert [r.temp for r in out] == [10.0] * 4 + [11.0] * 4 + [12.0] * 4 + [13.0] * 4
    gaps = {(b.Time_Bin - a.Time_Bin) for a, b in zip(out, out[1:])}
    assert gaps == {dt.timedelta(minutes=15)}


def test_upsample_stretched_matches_original_placement(spark):
    out = weather.upsample(_hourly(spark), "stretched").orderBy("Time_Bin").collect()
    assert len(out) == 17
    temps = {r.Time_Bin: r.temp for r in out}
    assert temps[T0 + dt.timedelta(minutes=75)] == 10.0
    assert temps[T0 + dt.timedelta(minutes=90)] == 11.0
    assert temps[T0 + dt.timedelta(minutes=150)] == 11.0
    assert temps[T0 + dt.timedelta(minutes=165)] == 12.0
    assert temps[T0 + dt.timedelta(minutes=225)] == 12.0
    assert temps[T0 + dt.timedelta(minutes=240)] == 13.0


def test_upsample_fills_gaps_in_observations(spark):
    rows = [("nyc", T0, 1.0, 0.0), ("nyc", T0 + dt.timedelta(hours=3), 2.0, 0.0)]
    h = spark.createDataFrame(rows, "station string, ts timestamp_ntz, temp double, precip double")
    out = weather.upsample(h, "exact", chunk_days=1).orderBy("Time_Bin").collect()
    assert [r.temp for r in out] == [1.0] * 12 + [2.0] * 4


def test_two_stations_by_place_and_window(spark):
    from zonegrid.operators.weather import in_window, join_weather, nearest_stations
    both = _hourly(spark).union(_hourly(spark).selectExpr("'far' AS station", "ts", "temp + 100 AS temp", "precip"))
    w15 = weather.upsample(in_window(both, "2025-01-01", "2025-01-01"))
    rows = spark.createDataFrame([(1, T0), (2, T0), (3, T0)], "Zone long, Time_Bin timestamp_ntz")
    zones = spark.createDataFrame([(1, 40.0, -74.0), (2, 41.0, -73.0)], "Zone long, lat double, lon double")
    near = nearest_stations(zones, [("nyc", 40.1, -74.1), ("far", 41.1, -73.1)])
    got = {r.Zone: r.temp for r in join_weather(rows, w15, by_zone=near).collect()}
    assert got == {1: 10.0, 2: 110.0, 3: None}
    assert {r.temp for r in join_weather(rows, w15).collect()} == {10.0}
    assert in_window(both, "2025-01-02", "2025-01-05").count() == 0


def _residuals(spark):
    rows = list(zip([1.0, 2.0, 3.0, 4.0, 5.0], [1.1, 1.9, 3.2, 3.8, 5.1]))
    return spark.createDataFrame(rows, "y_true double, y_pred double")


def test_residual_calibration_golden(spark):
    r = metrics.residual_calibration(_residuals(spark)).first()
    assert round(r.p10, 6) == -0.16 and round(r.p50, 6) == -0.1 and round(r.p90, 6) == 0.16
    assert round(r.abs_p50, 6) == 0.1 and round(r.abs_p90, 6) == 0.2
    assert r.p10 <= r.p50 <= r.p90


def test_regression_metrics_golden(spark):
    r = metrics.regression_metrics(_residuals(spark)).first()
    assert round(r.mae, 6) == 0.14 and round(r.rmse, 6) == 0.148324
    assert round(r.r2, 6) == 0.989 and round(r.mape, 6) == 5.733333


def test_r2_constant_truth_rule(spark):
    same = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y_true double, y_pred double")
    off = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "y_true double, y_pred double")
    assert metrics.regression_metrics(same).first().r2 == 1.0
    assert metrics.regression_metrics(off).first().r2 == 0.0


def test_cv_summary_population_std(spark):
    f = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "test_fold long, mae double")
    r = metrics.cv_summary(f).first()
    assert r.cv_mae_mean == 2.0 and round(r.cv_mae_std, 6) == round(float(np.std([1, 2, 3])), 6)


def test_global_position_matches_sorted_order(spark):
    rows = [(T0 + dt.timedelta(minutes=15 * (i % 7)), i % 5) for i in range(35)]
    df = spark.createDataFrame(rows, "Time_Bin timestamp_ntz, Zone long").dropDuplicates()
    got = sorted((r.pos, r.Time_Bin, r.Zone) for r in global_position(df, "Time_Bin", ["Zone"]).collect())
    expect = sorted((r.Time_Bin, r.Zone) for r in df.collect())
    assert [(t, z) for _, t, z in got] == expect and [p for p, _, _ in got] == list(range(len(expect)))


@pytest.mark.parametrize("n", [250, 1000])
def test_folds_follow_expanding_window_rule(spark, n):
    rows = [(T0 + dt.timedelta(minutes=15 * i), 1) for i in range(n)]
    df = spark.createDataFrame(rows, "Time_Bin timestamp_ntz, Zone long")
    out = folds.time_series_folds(df).orderBy("pos").collect()
    k = min(5, max(2, n // 100))
    size = n // (k + 1)
    first = n - k * size
    assert {r.n_folds for r in out} == {k}
    for r in out:
        expect = None if r.pos < first else (r.pos - first) // size
        assert r.test_fold == expect
    tail = folds.tail_sample(df, 100).collect()
    assert len(tail) == 100 and min(r.pos for r in tail) == n - 100
    assert F is not None


@pytest.mark.parametrize("accuracy,slack,limit", [(10000, 8, 200_000), (10000, 8, 20), (100, 4, 3)])
def test_exact_quantiles_match_numpy(spark, accuracy, slack, limit):
    from zonegrid.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.exponential(1.0, 700), np.full(300, 2.5)])  # skewed, with a tie block
    rows = [(int(i % 3), float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.g: [r[f"q{i}"] for i in range(len(probs))]
           for r in exact_quantiles(df, F.col("v"), probs, ["g"], accuracy, slack, limit).collect()}
    for g in range(3):
        expect = np.quantile(np.array([v for k, v in rows if k == g]), probs)
        assert np.allclose(got[g], expect, rtol=0, atol=1e-12), (g, got[g], expect)
    whole = exact_quantiles(df, F.col("v"), probs, None, accuracy, slack, limit).first()
    assert np.allclose([whole[f"q{i}"] for i in range(len(probs))], np.quantile(vals, probs), atol=1e-12)
