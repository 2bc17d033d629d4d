"""Request validation, request features, decorations, bounds (FIXTURES section 2)."""

import json
import math

from pyspark.sql import functions as F

from zonegrid.functions import bounds as B
from zonegrid.functions import surge
from zonegrid.operators import requests as R

SCENARIOS = {
    "default": dict(zoneId=161, supplyElasticity=0.8, lagDER15=1.2, lagDER30=1.1, demandVelocity=5,
                    lagDemandVelocity15=3, temp=15, precip=0, hour=12, dayOfWeek=4),
    "morning": dict(zoneId=186, supplyElasticity=0.6, lagDER15=1.8, lagDER30=1.6, demandVelocity=15,
                    lagDemandVelocity15=12, temp=10, precip=0, hour=8, dayOfWeek=1),
    "evening": dict(zoneId=161, supplyElasticity=0.4, lagDER15=2.2, lagDER30=2.0, demandVelocity=25,
                    lagDemandVelocity15=20, temp=18, precip=0, hour=18, dayOfWeek=4),
    "rainy": dict(zoneId=132, supplyElasticity=0.3, lagDER15=2.5, lagDER30=2.3, demandVelocity=30,
                  lagDemandVelocity15=28, temp=12, precip=5.2, hour=17, dayOfWeek=5),
}


def _validated_df(spark, bodies: dict):
    df = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in bodies.items()],
                               "request_id string, body string")
    return R.validate(df)


def _validate(spark, bodies: dict):
    return {r.request_id: r for r in _validated_df(spark, bodies).collect()}


def test_scenarios_features_golden(spark):
    v = _validate(spark, SCENARIOS)
    assert all(r.valid for r in v.values())
    valid = _validated_df(spark, SCENARIOS)
    feats = {r.request_id: r for r in R.request_features(valid).collect()}
    flags = {k: (r.is_rush_hour, r.is_weekend, r.is_airport_zone, r.is_manhattan_core) for k, r in feats.items()}
    assert flags == {"default": (0, 0, 0, 1), "morning": (1, 0, 0, 1), "evening": (1, 0, 0, 1),
                     "rainy": (1, 1, 1, 0)}
    d = feats["default"]
    assert d.defaults_used == ["month", "isHoliday", "derRollingMean1h", "derRollingStd1h"]
    assert (d.month, d.month_sin, d.month_cos, d.is_holiday) == (1.0, 0.0, 1.0, 0.0)
    assert d.DER_rolling_mean_1h == 1.2 and d.DER_rolling_std_1h == 0.0
    assert abs(d.hour_sin - math.sin(2 * math.pi * 12 / 24)) < 1e-12


def test_reject_cases_and_coercions(spark):
    base = SCENARIOS["default"]
    cases = {
        "missing_temp": {k: v for k, v in base.items() if k != "temp"},
        "hour_24": {**base, "hour": 24}, "hour_neg": {**base, "hour": -1}, "dow_7": {**base, "dayOfWeek": 7},
        "zone_0": {**base, "zoneId": 0}, "zone_264": {**base, "zoneId": 264}, "month_13": {**base, "month": 13},
        "hour_text_79": {**base, "hour": "7.9"},
        "hour_num_79": {**base, "hour": 7.9}, "hour_text_7": {**base, "hour": "7"},
        "snake": {"zone_id": 161, "supply_elasticity": 0.8, "lag_der_15": 1.2, "lag_der_30": 1.1,
                  "demand_velocity": 5, "lag_demand_velocity_15": 3, "temp": 15, "precip": 0, "hour": 12,
                  "day_of_week": 4},
        "no_zone": {k: v for k, v in base.items() if k != "zoneId"},
    }
    bodies = {k: json.dumps(v) for k, v in cases.items()}
    bodies["precip_nan"] = json.dumps({**base, "precip": "NaN"})
    bodies["precip_inf"] = json.dumps({**base, "precip": "Infinity"})
    bodies["precip_bare_nan"] = json.dumps({**base, "precip": float("nan")})  # not strict JSON
    bodies["broken"] = "{not json"
    v = _validate(spark, bodies)
    for bad in ("missing_temp", "hour_24", "hour_neg", "dow_7", "zone_0", "zone_264", "month_13",
                "hour_text_79", "precip_nan", "precip_inf", "broken"):
        assert not v[bad].valid, bad
    assert v["missing_temp"].reasons == ["temp: field required"]
    assert v["precip_nan"].reasons == ["precip: must be a finite number"]
    assert v["precip_inf"].reasons == ["precip: must be a finite number"]
    assert not v["precip_bare_nan"].valid and v["precip_bare_nan"].reasons[0] == "body: invalid JSON"
    assert v["hour_num_79"].valid and v["hour_num_79"].hour == 7
    assert v["hour_text_7"].valid and v["hour_text_7"].hour == 7
    assert v["snake"].valid and v["snake"].supply_elasticity == 0.8
    assert v["no_zone"].valid and v["no_zone"].zone_id == 161


def test_manifest_alignment_rejects_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert R.align_to_manifest(df, ["b", "a"]).columns == ["b", "a"]
    try:
        R.align_to_manifest(df, ["a", "c"])
        raise AssertionError("expected failure")
    except ValueError as e:
        assert "['c']" in str(e)


def test_surge_levels_and_recommendation(spark):
    rows = [(0.79, 0.0), (0.8, 0.0), (1.2, 0.0), (1.5, 0.0), (2.0, 0.0), (None, 0.0), (1.7, 1.0), (1.7, 1.01),
            (2.5, 9.0)]
    df = spark.createDataFrame(rows, "der double, precip double")
    out = df.select(surge.surge_level(F.col("der")).alias("l"),
                    surge.recommendation(F.col("der"), F.col("precip")).alias("r")).collect()
    assert [r.l for r in out[:6]] == ["Low Demand", "Normal", "Moderate Surge", "High Surge", "Extreme Surge", None]
    assert not out[6].r.endswith("sustained high demand.")
    assert out[7].r.endswith("Rain detected - expect sustained high demand.")
    assert out[8].r.startswith("Extreme surge conditions")


def test_percent_text_and_confidence(spark):
    df = spark.createDataFrame([(0.845, 0.1, 5), (0.5, float("nan"), 5), (0.5, 0.0, 1)],
                               "c double, std double, n int")
    out = df.select(surge.percent_text(F.col("c")).alias("t"),
                    surge.confidence_from_std(F.col("std"), F.col("n")).alias("conf")).collect()
    assert out[0].t == "84%"  # half-to-even like Python's format
    assert round(out[0].conf, 6) == round(1 / 1.1, 6)
    assert out[1].conf == 0.8 and out[2].conf == 0.85


def test_clamp_and_bounds_merge(spark):
    v = spark.createDataFrame([("r1", 300, 20.0, 99.0, 0.0, 0.0, 0.0, -500.0, 60.0, 23.6, 9)],
                              "request_id string, zone_id long, supply_elasticity double, lag_der_15 double, "
                              "lag_der_30 double, demand_velocity double, lag_demand_velocity_15 double, "
                              "temp double, precip double, hour double, day_of_week long")
    r = B.clamp_requests(v, B.default_bounds(0.01, 15.0)).first()
    assert (r.zoneId, r.supplyElasticity, r.lagDER15, r.lagDER30, r.temp, r.precip, r.hour, r.dayOfWeek) == \
        (263, 10.0, 15.0, 0.01, -30.0, 50.0, 23, 6)
    d = B.bounds_frame(spark, 0.01, 15.0)
    o = spark.createDataFrame([("temp", -5.0, 30.0, None), ("precip", 0.0, None, 1.0), ("hour", 1.0, 22.0, 2.0)],
                              B.BOUNDS_SCHEMA)
    m = {r.field: (r.min, r.max, r.step) for r in B.merge_bounds(d, o).collect()}
    assert m["temp"] == (-5.0, 30.0, 0.5)
    assert m["precip"] == (0.0, 50.0, 0.1)  # max missing -> default kept
    assert m["hour"] == (1.0, 22.0, None)
    assert m["lagDER15"] == (0.01, 15.0, 0.05)


def test_factor_tags(spark):
    df = spark.createDataFrame([(2.0, 8, 25.0, 0.3), (0.0, 12, 0.0, 1.0)],
                               "precip double, hour int, v double, e double")
    out = df.select(surge.factor_tags(F.col("precip"), F.col("hour"), F.col("v"), F.col("e")).alias("t")).collect()
    assert out[0].t == ["Rain impact", "Morning rush", "High velocity", "Low supply"]
    assert out[1].t == []


def test_holiday_and_month_coercion(spark):
    base = SCENARIOS["default"]
    cases = {"hol_true": {**base, "isHoliday": True}, "hol_one": {**base, "isHoliday": 1},
             "hol_yes": {**base, "isHoliday": "yes"}, "hol_off": {**base, "isHoliday": "off"},
             "hol_bad": {**base, "isHoliday": "maybe"}, "month_text": {**base, "month": "7"},
             "month_float": {**base, "month": 7.0}, "month_frac": {**base, "month": 7.5}}
    v = _validate(spark, cases)
    assert [v[k].is_holiday for k in ("hol_true", "hol_one", "hol_yes", "hol_off")] == [True, True, True, False]
    assert not v["hol_bad"].valid and v["hol_bad"].reasons == ["isHoliday: must be a boolean"]
    assert v["month_text"].month == 7 and v["month_float"].month == 7
    assert not v["month_frac"].valid and v["month_frac"].reasons == ["month: must be an integer"]
