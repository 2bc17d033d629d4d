"""Property tests: halo windows equal whole-key windows; results ignore partitioning."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from zonegrid.operators import bins, series
from zonegrid.suite.base import trips

T0 = dt.datetime(2024, 1, 1)

cells_strategy = st.lists(
    st.tuples(st.sampled_from([4, 132, 161]), st.integers(min_value=0, max_value=96 * 12),
              st.integers(min_value=0, max_value=5), st.integers(min_value=0, max_value=5)),
    min_size=1, max_size=60, unique_by=lambda t: (t[0], t[1]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=cells_strategy, chunk_days=st.sampled_from([1, 2, 5]))
def test_halo_windows_equal_whole_zone_windows(spark, rows, chunk_days):
    data = [(z, T0 + dt.timedelta(minutes=15 * b), float(a), float(p)) for z, b, a, p in rows]
    cells = bins.with_ratios(spark.createDataFrame(
        data, "Zone long, Time_Bin timestamp_ntz, ActiveRequests double, AvailableDriversProxy double"))
    key = ["Zone", "Time_Bin"]
    whole = series.series_features(cells, None).orderBy(*key).collect()
    assert series.series_features(cells, chunk_days).orderBy(*key).collect() == whole


def test_feature_table_ignores_partitioning(spark):
    t = trips(spark, "/root/testdata/sf0.001")
    key = ["Zone", "Time_Bin"]
    base = series.feature_table(bins.imbalance(t)).orderBy(*key).collect()
    for n in (1, 7):
        again = series.feature_table(bins.imbalance(t.repartition(n))).orderBy(*key).collect()
        assert again == base
