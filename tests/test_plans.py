"""Physical-plan properties that matter at scale."""

import re

from zonegrid.operators import bins
from zonegrid.suite import core
from zonegrid.suite.base import trips

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_one_shuffle_pruned_scan(spark):
    plan = _plan(bins.imbalance(trips(spark, SF)))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "partial_sum" in plan  # map-side combine before the shuffle
    scans = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert scans and all("value" not in s and "props" not in s for s in scans)
    assert "PushedFilters: [IsNotNull(ts), In(event_type" in plan or "event_type" in plan


def test_series_windows_keyed_by_zone_and_chunk(spark):
    plan = _plan(core.feature_table(spark, SF))
    specs = re.findall(r"windowspecdefinition\(([^,]+), ([^,]+), Time_Bin", plan)
    assert specs, plan[:2000]
    # the heavy windows (lead/lag/rolling) partition by (Zone, _chunk)
    assert any(a.startswith("Zone") and b.startswith("_chunk") for a, b in specs)


def test_aggregate_reused_across_halo_branches(spark):
    df = core.feature_table(spark, SF)
    df.collect()
    assert "ReusedExchange" in _plan(df)


def test_supply_by_dropoff_option(spark):
    t = trips(spark, SF)
    by_pickup = {(r.Zone, r.Time_Bin): r.AvailableDriversProxy for r in bins.imbalance(t).collect()}
    by_drop = {(r.Zone, r.Time_Bin): r.AvailableDriversProxy
               for r in bins.imbalance(t, supply_time="dropoff").collect()}
    assert sum(by_pickup.values()) == sum(by_drop.values())
    assert by_pickup != by_drop  # drop-offs are up to 39 minutes later
