"""Sources, binning, imbalance, series features (fixtures 1.1-1.3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from zonegrid.operators import bins, series
from zonegrid.sources.trips import standardize, union_sources

T0 = dt.datetime(2025, 1, 1)


def _trips(spark, pickup_col, dropoff_col):
    rows = [(T0 + dt.timedelta(minutes=15 * i), T0 + dt.timedelta(minutes=15 * i + 10), pu, do, i + 1)
            for i, (pu, do) in enumerate([(161, 162), (161, 163), (237, 238), (237, 239), (161, 162)])]
    return spark.createDataFrame(rows, f"{pickup_col} timestamp_ntz, {dropoff_col} timestamp_ntz, "
                                       "PULocationID long, DOLocationID long, extra_column long")


def test_standardize_yellow_renames_and_prunes(spark):
    df = standardize(_trips(spark, "tpep_pickup_datetime", "tpep_dropoff_datetime"), "yellow")
    assert df.columns == ["pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID"]
    assert [r.PULocationID for r in df.collect()] == [161, 161, 237, 237, 161]


def test_standardize_fhvhv_keeps_names(spark):
    df = standardize(_trips(spark, "pickup_datetime", "dropoff_datetime"), "fhvhv")
    assert df.columns == ["pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID"]
    assert df.count() == 5


def test_union_is_bag_and_empty_fails(spark):
    y = standardize(_trips(spark, "tpep_pickup_datetime", "tpep_dropoff_datetime"), "yellow")
    f = standardize(_trips(spark, "pickup_datetime", "dropoff_datetime"), "fhvhv")
    assert union_sources([y, f]).count() == 10
    with pytest.raises(ValueError):
        union_sources([None, None])


def test_imbalance_zero_rules_fixture(spark):
    y = standardize(_trips(spark, "tpep_pickup_datetime", "tpep_dropoff_datetime"), "yellow")
    cells = {(r.Zone, r.Time_Bin): r for r in bins.imbalance(y).collect()}
    assert len(cells) == 10
    a = cells[(161, T0)]
    assert (a.ActiveRequests, a.AvailableDriversProxy, a.SupplyElasticity, a.DER_t) == (1.0, 0.0, 0.0, 1.0)
    b = cells[(162, T0)]
    assert (b.ActiveRequests, b.AvailableDriversProxy, b.SupplyElasticity, b.DER_t) == (0.0, 1.0, 0.0, 0.0)
    # union doubles every count, ratios unchanged
    f = standardize(_trips(spark, "pickup_datetime", "dropoff_datetime"), "fhvhv")
    doubled = {(r.Zone, r.Time_Bin): r for r in bins.imbalance(union_sources([y, f])).collect()}
    assert doubled[(161, T0)].ActiveRequests == 2.0 and doubled[(161, T0)].DER_t == 1.0


def test_null_keys_drop_only_their_side(spark):
    rows = [(T0, T0, 1, None), (T0, T0, None, 2), (None, T0, 3, 3)]
    t = spark.createDataFrame(rows, "pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, "
                                    "PULocationID long, DOLocationID long")
    got = {r.Zone: (r.ActiveRequests, r.AvailableDriversProxy) for r in bins.imbalance(t).collect()}
    assert got == {1: (1.0, 0.0), 2: (0.0, 1.0)}


def test_explode_form_equals_outer_join(spark):
    from zonegrid.suite.base import trips
    t = trips(spark, "/root/testdata/sf0.001")
    a = bins.imbalance(t).orderBy("Zone", "Time_Bin").collect()
    b = bins.imbalance_outer(t).orderBy("Zone", "Time_Bin").collect()
    assert a == b
    n_pu = t.where(F.col("PULocationID").isNotNull()).count()
    assert sum(r.ActiveRequests for r in a) == n_pu


def _series_fixture(spark):
    der = {161: [1.0, 1.2, 1.5, 1.8, 2.0, 2.2], 237: [1.5, 1.4, 1.6, 1.7, 1.5, 1.6]}
    act = {161: [100, 120, 150, 180, 200, 220], 237: [150, 140, 160, 170, 150, 160]}
    rows = [(z, T0 + dt.timedelta(minutes=15 * i), der[z][i], float(act[z][i]))
            for z in der for i in range(6)]
    return spark.createDataFrame(rows, "Zone long, Time_Bin timestamp_ntz, DER_t double, ActiveRequests double")


@pytest.mark.parametrize("chunk_days", [None, 1])
def test_series_fixture_goldens(spark, chunk_days):
    out = series.series_features(_series_fixture(spark), chunk_days).orderBy("Zone", "Time_Bin").collect()
    z161 = [r for r in out if r.Zone == 161]
    z237 = [r for r in out if r.Zone == 237]
    assert z161[0]["Target_DER_t+15"] == 1.2 and z161[-1]["Target_DER_t+15"] is None
    assert z161[1]["Lag_DER_t-15"] == 1.0 and z161[0]["Lag_DER_t-15"] is None
    assert z161[2]["Lag_DER_t-30"] == 1.0
    assert [r.DemandVelocity_t for r in z161] == [None, 20, 30, 30, 20, 20]
    assert [r["Lag_DemandVelocity_t-15"] for r in z161] == [None, None, 20, 30, 30, 20]
    assert [round(r.DER_rolling_mean_1h, 6) for r in z161] == [1.0, 1.1, 1.233333, 1.375, 1.625, 1.875]
    assert [round(r.DER_rolling_std_1h, 6) for r in z161] == [0.0, 0.141421, 0.251661, 0.35, 0.35, 0.298608]
    assert [round(r.DER_rolling_std_1h, 6) for r in z237] == [0.0, 0.070711, 0.1, 0.129099, 0.129099, 0.08165]
    assert z237[0]["Lag_DER_t-15"] is None  # no leak across zones


def test_halo_chunks_equal_whole_zone_windows(spark):
    """Day chunks with halos give exactly the per-zone result on gappy data."""
    from zonegrid.suite.core import cells
    c = cells(spark, "/root/testdata/sf0.001")
    key = ["Zone", "Time_Bin"]
    whole = series.series_features(c, None).orderBy(*key).collect()
    for days in (1, 3):
        assert series.series_features(c, days).orderBy(*key).collect() == whole


def test_feature_names_by_exclusion(spark):
    from zonegrid.operators.split import feature_names_by_exclusion
    from zonegrid.suite.core import feature_table
    names = feature_names_by_exclusion(feature_table(spark, "/root/testdata/sf0.001"))
    assert names == ["Zone", "SupplyElasticity", "Lag_DER_t-15", "Lag_DER_t-30", "DemandVelocity_t",
                     "Lag_DemandVelocity_t-15", "DER_rolling_mean_1h", "DER_rolling_std_1h", "month", "month_sin",
                     "month_cos", "is_rush_hour", "is_holiday", "is_airport_zone", "is_manhattan_core"]
