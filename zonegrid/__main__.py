"""Command-line jobs: ``python -m zonegrid {refresh,retrieve,train,score} ...``.

refresh   files of a folder against a manifest -> their status; the manifest is brought up to date
retrieve  monthly trip Parquet (yellow_tripdata_*.parquet, fhvhv_tripdata_*.parquet)
          -> aggregate checkpoint + feature table partitioned by split
train     feature table + landed hourly weather -> model, registry record, run log
score     landed request bodies (request_id, body) -> validated + scored requests

On a cluster the job uses the active session (and its spark.checkpoint.dir);
locally it starts one.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import fixed
from .ml import registry
from .params import SHIPPED, Params
from .plans import retrieval, training
from .plans.scoring import land_validated, read_landed
from .operators import requests as R
from .operators import weather
from .sources import files, sinks
from .sources.trips import read_trips


def _session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    from .session import get_session
    return get_session()


def _params(a) -> Params:
    p = SHIPPED
    if getattr(a, "split_date", None):
        p = replace(p, split_date=a.split_date)
    if getattr(a, "holidays", None):
        p = replace(p, holidays=tuple(a.holidays.split(",")))
    for name in ("der_outlier_lower", "der_outlier_upper", "min_active_requests", "weather_start", "weather_end"):
        if getattr(a, name, None) is not None:
            p = replace(p, **{name: getattr(a, name)})
    for name in ("n_estimators", "early_stopping_rounds"):
        if getattr(a, name, None) is not None:
            p = replace(p, model=replace(p.model, **{name: getattr(a, name)}))
    if getattr(a, "tune", False):
        p = replace(p, tuning=replace(p.tuning, enabled=True))
    return p


def main(argv=None) -> dict:
    ap = argparse.ArgumentParser(prog="zonegrid")
    sub = ap.add_subparsers(dest="job", required=True)
    r = sub.add_parser("retrieve")
    r.add_argument("--data", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--split-date")
    r.add_argument("--holidays")
    r.add_argument("--der-outlier-lower", type=float)
    r.add_argument("--der-outlier-upper", type=float)
    r.add_argument("--min-active-requests", type=int)
    f = sub.add_parser("refresh")
    f.add_argument("--data", required=True)
    f.add_argument("--manifest", required=True)
    t = sub.add_parser("train")
    t.add_argument("--features", required=True)
    t.add_argument("--weather", required=True, help="hourly table: station, ts, temp, precip")
    t.add_argument("--registry", required=True)
    t.add_argument("--split-date")
    t.add_argument("--n-estimators", type=int)
    t.add_argument("--no-cv", action="store_true")
    t.add_argument("--early-stopping-rounds", type=int)
    t.add_argument("--tune", action="store_true", help="grid search first")
    t.add_argument("--station", default=fixed.DEFAULT_STATION)
    t.add_argument("--weather-start", help="first day of the observations that are read")
    t.add_argument("--weather-end", help="last day")
    t.add_argument("--run", help="name of the run: a run of this name that was ended goes on")
    s = sub.add_parser("score")
    s.add_argument("--requests", required=True, help="Parquet with request_id, body")
    s.add_argument("--registry", required=True)
    s.add_argument("--out", required=True)
    a = ap.parse_args(argv)
    spark = _session()
    p = _params(a)
    if a.job == "retrieve":
        res = retrieval.run_retrieval(spark, read_trips(spark, a.data), p, a.out)
        out = {"features": res["features"], "aggregate": res["aggregate"], "audit": res["audit"]}
    elif a.job == "refresh":
        status = files.refresh_manifest(spark, a.data, a.manifest)
        out = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
    elif a.job == "train":
        hourly = weather.in_window(spark.read.parquet(a.weather), p.weather_start, p.weather_end)
        hourly = hourly.where(F.col("station") == a.station).withColumn("station", F.lit(fixed.DEFAULT_STATION))
        if hourly.limit(1).count() == 0:
            raise ValueError(f"no observations of station {a.station} from {p.weather_start} to {p.weather_end}")
        w15 = weather.upsample(hourly, "exact", p.series_chunk_days)
        res = training.train_and_save(spark, sinks.read_split(spark, a.features), w15, p, a.registry,
                                      run_cv=not a.no_cv, run=a.run)
        out = {"model": res["path"], "n_trees": res["n_trees"], "metrics": res["metrics"]}
    else:
        from pyspark.ml.regression import GBTRegressionModel
        from .ml import trees
        from .plans.scoring import score_valid
        rec = registry.latest(registry.registry(spark, a.registry)).first()
        model = GBTRegressionModel.load(rec["artifact"])
        landed = f"{a.out.rstrip('/')}/validated"
        land_validated(R.validate(spark.read.parquet(a.requests)), landed)
        scored = score_valid(read_landed(spark, landed, valid=True), model, list(rec["features"]),
                             dict(rec["calibration"]),
                             trees.leaf_table(trees.load_forest(spark, rec["artifact"], len(rec["features"]))))
        scored.write.mode("overwrite").parquet(f"{a.out.rstrip('/')}/scored")
        counts = read_landed(spark, landed, valid=None).groupBy("valid").count().collect()
        out = {"scored": f"{a.out.rstrip('/')}/scored", "valid_counts": {str(c["valid"]).lower(): c["count"] for c in counts}}
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
