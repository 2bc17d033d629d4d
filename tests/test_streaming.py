"""Stream scoring (file source, availableNow) equals batch scoring."""

import json

from pyspark.sql import functions as F

from zonegrid.ml import train
from zonegrid.ml import trees as T
from zonegrid.operators import matrix
from zonegrid.operators import requests as R
from zonegrid.params import ModelParams
from zonegrid.streaming import scoring as S

from test_requests import SCENARIOS


def test_stream_equals_batch(spark, tmp_path):
    bodies = spark.createDataFrame([(k, json.dumps(v)) for k, v in SCENARIOS.items()], S.BODY_SCHEMA)
    feats = R.request_features(R.validate(bodies))
    names = list(R.INFERENCE_FEATURES)
    data = matrix.assemble(feats.withColumn("Target_DER_t+15", F.col("`Lag_DER_t-15`") * 0.9), names)
    model = train.fit(data, ModelParams(n_estimators=3, learning_rate=0.5, max_depth=2,
                                        early_stopping_rounds=0)).model
    cal = {"p10": -0.1, "p90": 0.2}
    src = str(tmp_path / "src")
    bodies.write.parquet(src)
    model.write().save(str(tmp_path / "model"))
    leaves = T.leaf_table(T.load_forest(spark, str(tmp_path / "model"), len(names)))
    q = S.start(spark, src, str(tmp_path / "out"), str(tmp_path / "ckpt"), model, names, cal, leaves)
    q.awaitTermination()
    streamed = sorted(S.read_scored(spark, str(tmp_path / "out")).drop("batch_id").collect())
    valid = R.validate(bodies).where("valid")
    batch = sorted(S.score_valid(valid, model, names, cal, leaves).collect())
    assert len(streamed) == 4 and streamed == batch
    assert all(abs((r.band_upper - r.band_lower) - 0.3) < 1e-9 for r in streamed)
    assert {r.band_level for r in streamed} == {0.8} and all(r.confidence.endswith("%") for r in streamed)
    bare = S.score_valid(valid, model, names, {"p10": -0.1}, leaves).first()
    assert bare.band_lower is None and bare.band_level is None      # half a calibration is none
