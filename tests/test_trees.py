"""Boosted trees: node-table walk == Spark prediction, TreeSHAP exactness (fixture 1.4)."""

import itertools
from math import factorial

import numpy as np
import pytest

from zonegrid.ml import train
from zonegrid.ml import trees as T
from zonegrid.operators.matrix import assemble
from zonegrid.params import ModelParams

FEATS = ["SupplyElasticity", "Lag_DER_t-15", "Lag_DER_t-30", "DemandVelocity_t", "Lag_DemandVelocity_t-15",
         "temp", "precip", "hour_sin", "hour_cos"]


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    rng = np.random.default_rng(42)
    n = 50
    cols = {
        "SupplyElasticity": rng.uniform(0.5, 2, n), "Lag_DER_t-15": rng.uniform(0.8, 2.5, n),
        "Lag_DER_t-30": rng.uniform(0.8, 2.5, n), "DemandVelocity_t": rng.uniform(-50, 50, n),
        "Lag_DemandVelocity_t-15": rng.uniform(-50, 50, n), "temp": rng.uniform(-5, 25, n),
        "precip": rng.uniform(0, 5, n), "hour_sin": rng.uniform(-1, 1, n), "hour_cos": rng.uniform(-1, 1, n),
    }
    y = 0.5 * cols["SupplyElasticity"] + 0.3 * cols["Lag_DER_t-15"] + rng.normal(0, 0.2, n)
    rows = [tuple(float(cols[c][i]) for c in FEATS) + (float(y[i]), i) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in FEATS) + ", `Target_DER_t+15` double, i int")
    data = assemble(df, FEATS).cache()
    tr, te = data.where("i < 35"), data.where("i >= 35")
    res = train.fit(tr, ModelParams(n_estimators=8, learning_rate=0.3, max_depth=3, early_stopping_rounds=0))
    path = str(tmp_path_factory.mktemp("gbt") / "m")
    res.model.write().overwrite().save(path)
    forest = T.load_forest(spark, path, len(FEATS))
    pred = res.model.transform(te).orderBy("i")
    X = np.array([[r[c] for c in FEATS] for r in pred.collect()])
    return res, forest, X, np.array([r.prediction for r in pred.collect()]), path


def test_predictions_sane_and_walk_matches(fitted):
    res, forest, X, spark_pred, _ = fitted
    assert len(spark_pred) == 15 and np.all((spark_pred > -5) & (spark_pred < 10))
    walked = T.tree_outputs(forest, X).sum(axis=1)
    assert np.allclose(walked, spark_pred, atol=1e-9)


def test_shap_sums_to_prediction(fitted):
    _, forest, X, spark_pred, _ = fitted
    base, phi = T.shap_values(forest, X)
    assert np.allclose(base + phi.sum(axis=1), spark_pred, atol=1e-9)


def _cond_expectation(tree, x, S):
    """Path-dependent E[f | x_S] by direct recursion (reference definition)."""
    def rec(node):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if f in S:
            return rec(left if x[f] <= tree.threshold[node] else right)
        c = tree.cover[node]
        return (tree.cover[left] * rec(left) + tree.cover[right] * rec(right)) / c
    return rec(0)


def test_shap_equals_brute_force_shapley(fitted):
    _, forest, X, _, _ = fitted
    tree = forest.trees[1]
    single = T.Forest([tree], np.array([1.0]), len(FEATS))
    used = sorted({int(f) for f in tree.feature if f >= 0})
    x = X[0]
    _, phi = T.shap_values(single, x[None, :])
    M = len(used)
    for i in used:
        others = [j for j in used if j != i]
        val = 0.0
        for k in range(M):
            for S in itertools.combinations(others, k):
                w = factorial(k) * factorial(M - k - 1) / factorial(M)
                val += w * (_cond_expectation(tree, x, set(S) | {i}) - _cond_expectation(tree, x, set(S)))
        assert abs(val - phi[0, i]) < 1e-9


def test_shap_cases_are_worked_out_once_a_leaf(fitted, monkeypatch):
    """With tables no contribution is computed per row; without room for them the values are the same."""
    _, forest, X, _, _ = fitted
    groups = T.path_groups(forest)
    assert [g.table.shape for g in groups if g.feature.size] == [
        (len(g.value), 2 ** g.feature.shape[1], g.feature.shape[1]) for g in groups if g.feature.size]
    monkeypatch.setattr(T, "TABLE_BYTES", 0)
    plain = T.path_groups(forest)
    assert all(g.table.size == 0 for g in plain)
    base, phi = T.shap_values(forest, X, plain)
    monkeypatch.setattr(T, "contributions", None)
    again, quick = T.shap_values(forest, X, groups)
    assert base == again and np.allclose(phi, quick, atol=1e-12)


def test_gain_fractions_sum_to_one(spark, fitted):
    from zonegrid.ml.explain import gain_importance
    _, forest, _, _, path = fitted
    rows = gain_importance(spark, path, FEATS).collect()
    assert abs(sum(r[2] for r in rows) - 1) < 1e-9
    used = {FEATS[i] for tree in forest.trees for i in tree.feature if i >= 0}
    assert {r.feature for r in rows} == used
    assert [r[1] for r in rows] == sorted((r[1] for r in rows), reverse=True)


def test_patience_rule():
    assert train.best_with_patience([3, 2, 1, 2, 3, 4], 2) == 3
    assert train.best_with_patience([1, 2, 3, 4], 2) == 1
    assert train.best_with_patience([5, 4, 3], 10) == 3


def test_grid_search_prefix_scores(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [tuple(float(v) for v in np.random.default_rng(i).uniform(0, 1, len(FEATS)))
            + (float(i % 7), t0 + dt.timedelta(minutes=15 * i), 1) for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in FEATS)
                               + ", `Target_DER_t+15` double, Time_Bin timestamp_ntz, Zone long")
    found = train.grid_search(assemble(df, FEATS), {"n_estimators": [2, 4], "max_depth": [2], "learning_rate": [0.1]}, 2)
    out = found.collect()
    assert {(r["n_estimators"], r["n_folds"]) for r in out} == {(2, 2), (4, 2)}
    assert all(r["mean_mae"] >= 0 for r in out)
    assert train.best_of(found).first()["mean_mae"] == min(r["mean_mae"] for r in out)


def test_grid_fits_equal_spark_trees(spark):
    """Few values a feature: the bins are the same, and so are the trees."""
    import datetime as dt
    r = np.random.default_rng(7)
    x = r.integers(0, 12, size=(400, len(FEATS))).astype(float)
    y = x[:, 0] * 0.7 - (x[:, 1] > 5) * x[:, 2] + r.normal(0, 0.5, 400)
    t0 = dt.datetime(2024, 1, 1)
    df = assemble(spark.createDataFrame(
        [(*map(float, row), float(v), t0 + dt.timedelta(minutes=15 * i), 1) for i, (row, v) in enumerate(zip(x, y))],
        ", ".join(f"`{c}` double" for c in FEATS) + ", `Target_DER_t+15` double, Time_Bin timestamp_ntz, Zone long"), FEATS)
    found = {(r["n_estimators"], r["max_depth"]): r["mean_mae"] for r in train.grid_search(
        df, {"n_estimators": [1, 5, 9], "max_depth": [2, 4], "learning_rate": [0.2]}, 2).collect()}
    folds, _ = train.fold_frames(df, 2)
    for depth in (2, 4):
        errors = [train.regressor(9, 0.2, depth, 42, 32).fit(tr).evaluateEachIteration(va, "absolute")
                  for tr, va in folds]
        for n in (1, 5, 9):
            # In small nodes splits tie, and rounding decides: deep trees differ a little.
            near = 1e-6 if depth == 2 else 0.02
            assert found[n, depth] == pytest.approx(np.mean([e[n - 1] for e in errors]), rel=near)


def test_first_trees_equal_a_refit(spark, fitted, tmp_path):
    from pyspark.ml.regression import GBTRegressionModel
    res, _, X, _, _ = fitted
    rows = spark.createDataFrame([(i, *[float(v) for v in x], 0.0) for i, x in enumerate(X)],
                                 "i int, " + ", ".join(f"`{c}` double" for c in FEATS) + ", `Target_DER_t+15` double")
    data = assemble(rows, FEATS)
    cut = train.first_trees(res.model, 3)
    assert cut.getNumTrees == 3 and train.first_trees(res.model, 8) is res.model
    cut.write().overwrite().save(str(tmp_path / "m"))
    forest = T.load_forest(spark, str(tmp_path / "m"), len(FEATS))
    again = GBTRegressionModel.load(str(tmp_path / "m"))
    walked = T.tree_outputs(T.Forest(forest.trees, forest.weights, len(FEATS)), X).sum(axis=1)
    for model in (cut, again):
        assert np.allclose([r.prediction for r in model.transform(data).orderBy("i").collect()], walked, atol=1e-12)


def test_train_tail_early_stopping(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [tuple(float(v) for v in np.random.default_rng(i).uniform(0, 1, len(FEATS)))
            + (float(i % 5), t0 + dt.timedelta(minutes=15 * i), 1) for i in range(80)]
    df = assemble(spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in FEATS)
                                        + ", `Target_DER_t+15` double, Time_Bin timestamp_ntz, Zone long"), FEATS)
    head, tail = train.train_tail_split(df, 0.1)
    assert (head.count(), tail.count()) == (72, 8)
    res = train.fit_with_stopping(df, None, ModelParams(n_estimators=6, learning_rate=0.5, max_depth=2,
                                                        early_stopping_rounds=2, early_stopping_on="train_tail"))
    assert 1 <= res.n_trees <= 6 and len(res.errors) == 6 and res.model.getNumTrees == res.n_trees


def test_distributed_dispersion_and_shap(spark, fitted):
    from zonegrid.ml import explain
    res, forest, X, spark_pred, _ = fitted
    rows = [(f"r{i}", *[float(v) for v in x]) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "request_id string, " + ", ".join(f"`{c}` double" for c in FEATS))
    scored = explain.with_leaves(res.model).transform(assemble(df, FEATS, label=None))
    disp = {r.request_id: r for r in explain.tree_dispersion(scored, T.leaf_table(forest)).collect()}
    per_tree = T.tree_outputs(forest, X)
    for i in range(len(X)):
        assert disp[f"r{i}"].tree_std == pytest.approx(per_tree[i, 1:].std(), rel=1e-9)
    shap = {r.request_id: r for r in explain.shap_topk(df, forest, FEATS, k=4).collect()}
    for i, p in enumerate(spark_pred):
        d, s = disp[f"r{i}"], shap[f"r{i}"]
        assert abs(d.forest_prediction - p) < 1e-9 and d.n_trees == 8 and 0.15 <= d.confidence <= 0.98
        assert abs(s.expected_value + s.shap_sum - p) < 1e-9
        vals = [abs(t.shap_value) for t in s.top_features]
        assert len(vals) == 4 and vals == sorted(vals, reverse=True)


def test_expressions_walk_like_the_model(spark, fitted):
    """Leaf numbers and node covers by column expressions equal those of Spark's model."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from zonegrid.ml import explain, walk
    res, forest, X, _, path = fitted
    df = spark.createDataFrame([tuple(map(float, x)) + (0.5,) for x in X], ", ".join(f"`{c}` double" for c in FEATS) + ", y double")
    own = explain.with_leaves(res.model).transform(assemble(df, FEATS, label=None))
    both = walk.with_leaf_numbers(own, forest, FEATS, "mine")
    assert both.where(vector_to_array("mine") != vector_to_array(explain.LEAF)).count() == 0
    assert both.count() == len(X)
    found = walk.measured(forest, walk.node_statistics(df, forest, FEATS, "y"))
    for tree in found.trees:
        inner = np.flatnonzero(tree.feature >= 0)
        assert tree.cover[0] == len(X)
        assert (tree.cover[inner] == tree.cover[tree.left[inner]] + tree.cover[tree.right[inner]]).all()
        assert np.allclose(tree.gain, 0)      # a constant label gains nothing
    none = walk.node_statistics(df.limit(0), forest, FEATS, "y")
    assert none.count() == 0
    frame = walk.node_frame(spark, forest).select("tree", "id", "feature").where(F.col("feature") >= 0)
    assert frame.count() == sum(int((t.feature >= 0).sum()) for t in forest.trees)


def test_fits_run_in_partitions_of_their_rows(spark, monkeypatch):
    """However many partitions the rows come in, a fit's tasks follow their number."""
    import datetime as dt
    rows = [(float(i % 7), float(i % 3), float(i % 7 - i % 3), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=15 * i), 1)
            for i in range(240)]
    df = assemble(spark.createDataFrame(rows, "a double, b double, `Target_DER_t+15` double, Time_Bin timestamp_ntz, Zone long"),
                  ["a", "b"]).repartition(40).cache()
    seen, real = [], train.GBTRegressor.fit

    def fit(self, data):
        seen.append((data.rdd.getNumPartitions(), data.count()))
        return real(self, data)
    monkeypatch.setattr(train.GBTRegressor, "fit", fit)
    p = ModelParams(n_estimators=2, max_depth=2, early_stopping_rounds=1, early_stopping_on="train_tail")
    train.fit(df, p)
    train.fit_with_stopping(df, None, p)
    assert seen == [(1, 240), (1, 216), (1, 240)]
    del seen[:]
    train.cv_scores(df, p, 2, threads=1)
    assert seen == [(1, 80), (1, 160)]
    monkeypatch.setattr(train, "ROWS_PER_TASK", 100)
    assert train.fit_rows(df).rdd.getNumPartitions() == 3 and train.fit_rows(df).count() == 240
    assert train.fit_rows(df.limit(0)).rdd.getNumPartitions() <= 1


def test_fits_have_no_more_tasks_than_cores_and_a_short_lineage(spark, monkeypatch):
    import datetime as dt
    rows = [(float(i % 7), float(i), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=15 * i), 1) for i in range(240)]
    df = assemble(spark.createDataFrame(rows, "a double, `Target_DER_t+15` double, Time_Bin timestamp_ntz, Zone long"),
                  ["a"]).repartition(40).cache()
    assert train.fold_frames(df, 2)[1].rdd.getNumPartitions() == 1
    found = train.fit_rows(df.where("label >= 100"))
    assert "ExistingRDD" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.label for r in found.collect()) == list(map(float, range(100, 240)))
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(train, "ROWS_PER_TASK", 1)
    assert train.fit_rows(df).rdd.getNumPartitions() == cores
    monkeypatch.setattr(train, "MOST_ROWS", 2)
    assert train.fit_rows(df).rdd.getNumPartitions() == max(cores, 120)


def test_task_functions_need_no_installed_package(fitted, tmp_path):
    import pickle
    import subprocess
    import sys

    from pyspark import cloudpickle
    from zonegrid.ml import boost
    _, forest, X, spark_pred, _ = fitted
    sent = (T.shap_values, T.Forest([], forest.weights, len(FEATS)), X, T.path_groups(forest), boost.fold_errors)
    (tmp_path / "sent").write_bytes(cloudpickle.dumps(sent))
    code = """if True:
        import pickle, sys
        import numpy as np
        shap_values, frame, X, groups, fold_errors = pickle.load(open("sent", "rb"))
        base, phi = shap_values(frame, X, groups)
        fold_errors(X, X[:, 0], np.arange(len(X)) < 9, [1, 2], 2, 0.1, 8)
        assert "zonegrid" not in sys.modules
        pickle.dump(base + phi.sum(axis=1), open("found", "wb"))"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    assert np.allclose(pickle.loads((tmp_path / "found").read_bytes()), spark_pred, atol=1e-9)


def test_cross_validation_and_final_fit_run_at_the_same_time(spark, tmp_path, monkeypatch):
    import datetime as dt
    import threading

    from zonegrid.params import Params
    from zonegrid.plans import training
    t0 = dt.datetime(2024, 1, 1)
    rows = [("train" if i < 60 else "test", 1, t0 + dt.timedelta(minutes=15 * i),
             *map(float, np.random.default_rng(i).uniform(0, 1, len(FEATS))), float(i % 5)) for i in range(80)]
    df = spark.createDataFrame(rows, "split string, Zone long, Time_Bin timestamp_ntz, "
                               + ", ".join(f"`{c}` double" for c in FEATS) + ", `Target_DER_t+15` double")
    data = assemble(df, FEATS).select("split", "Zone", "Time_Bin", "features", "label")
    monkeypatch.setattr(training, "prepare", lambda *_: (data, FEATS))
    both = threading.Barrier(2, timeout=60)
    for name in ("cv_scores", "fit_with_stopping"):
        real = getattr(train, name)
        monkeypatch.setattr(train, name, lambda *a, real=real, **k: both.wait() >= 0 and real(*a, **k))
    p = Params(model=ModelParams(n_estimators=3, max_depth=2, early_stopping_rounds=2))
    out = training.train_and_save(spark, None, None, p, str(tmp_path / "registry"))
    assert out["metrics"]["cv_mae_mean"] > 0 and out["n_train"] == 60 and 1 <= out["n_trees"] <= 3
