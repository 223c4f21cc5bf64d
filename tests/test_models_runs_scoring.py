import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import metrics as ME
from riskweave.operators import models as MO
from riskweave.operators import scoring as SC
from riskweave.operators.runs import RunStore, best_run, compare_runs
from riskweave.operators.tuning import (DEFAULT_GRIDS, HyperparameterTuner, candidate_rows, distinct_candidates, draw_candidates, expand_grid, fit_key,
                                        tune_hyperparameters)


def data(spark, n=200):
    rng = random.Random(42)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, a, b, c, 1 if a + b > 0 else 0))
    return spark.createDataFrame(rows, "id long, feature1 double, feature2 double, feature3 double, y int")


FEATS = ["feature1", "feature2", "feature3"]


def test_metrics_and_auc(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 1, 0.6), (0, 0, 0.1)],
                               "y int, p int, s double")
    m = ME.classification_metrics(df, "y", "p").first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1_score"]) == (0.6, 0.5, 0.5, 0.5)
    # pairs (pos, neg): 0.9 beats all 3; 0.4 beats 0.1, ties 0.4 (1/2), loses to 0.6 -> (3 + 1.5) / 6
    assert abs(ME.roc_auc_value(df, "y", "s") - 4.5 / 6) < 1e-12
    assert ME.roc_auc_value(df.where("y = 0"), "y", "s") == 0.0
    zero = ME.classification_metrics(df.where("p = 0 and y = 0"), "y", "p").first()
    assert zero["precision"] == 0.0 and zero["f1_score"] == 0.0


def test_train_evaluate_best(spark):
    df = data(spark)
    train, test = df.where("id % 5 != 0"), df.where("id % 5 = 0")
    t = MO.ModelTrainer(42)
    t.train_multiple(["logistic_regression", "decision_tree", "no_such_model"], train, test, FEATS, "y")
    assert set(t.metrics) == {"logistic_regression", "decision_tree"}
    for m in t.metrics.values():
        assert all(0.0 <= v <= 1.0 for v in m.values())
    name, _, score = t.best_model("test_roc_auc")
    assert score == max(m["test_roc_auc"] for m in t.metrics.values())
    assert t.metrics_summary(spark).count() == 2
    t.metrics["decision_tree"].pop("test_roc_auc")  # a model without the metric is passed over
    assert t.best_model("test_roc_auc")[0] == "logistic_regression"
    with pytest.raises(ValueError):
        MO.train_model("svm", train, FEATS, "y")
    with pytest.raises(ValueError):
        t.best_model("nope")


def test_a_failed_model_is_no_result(spark):
    """The others train, but the call raises: a summary without a model must not look whole."""
    df = data(spark, 60)
    t = MO.ModelTrainer(42)
    with pytest.raises(RuntimeError, match="random_forest"):
        t.train_multiple(["random_forest", "decision_tree"], df, df, FEATS, "y", {"random_forest": {"max_depth": 31}})
    assert set(t.metrics) == set(t.models) == {"decision_tree"} and set(t.failures) == {"random_forest"}
    t.train_multiple(["decision_tree", "no_such_model"], df, df, FEATS, "y")
    assert set(t.failures) == {"random_forest", "no_such_model"}


def test_forest_and_boosted_trees_train(spark, tmp_path):
    df = data(spark)
    train, test = df.where("id % 5 != 0"), df.where("id % 5 = 0")
    params = {"random_forest": {"n_estimators": 10, "max_depth": 4, "min_samples_split": 20, "max_features": None}, "xgboost": {"n_estimators": 5, "max_depth": 3, "colsample_bytree": 0.8},
              "lightgbm": {"n_estimators": 5, "num_leaves": 5, "subsample": 0.9}}
    t = MO.ModelTrainer(42)
    t.train_multiple(list(params), train, test, FEATS, "y", params)
    assert set(t.metrics) == set(params) and all(m["test_roc_auc"] > 0.7 for m in t.metrics.values())
    assert t.models["lightgbm"].stages[-1].getMaxDepth() == 2  # at most five leaves
    t.save_model("random_forest", str(tmp_path / "rf"))
    from pyspark.ml import PipelineModel
    assert PipelineModel.load(str(tmp_path / "rf")).transform(test).count() == test.count()
    with pytest.raises(ValueError):
        MO.ModelTrainer().best_model()


def test_train_models_in_one_call(spark):
    df = data(spark)
    assert set(MO.train_models(df, df, FEATS, "y", ["logistic_regression"]).metrics) == {"logistic_regression"}


def test_depth_and_parameters_that_cannot_be_honoured():
    assert MO.not_honoured("decision_tree", {"max_depth": 3, "min_samples_split": 20, "splitter": "best"}) == ["splitter"]
    assert MO.not_honoured("xgboost", {"min_samples_split": 20}) == ["min_samples_split"]


def test_unlimited_depth_is_its_own(spark):
    none, twenty = MO.build_estimator("decision_tree", max_depth=None), MO.build_estimator("decision_tree", max_depth=20)
    assert (none.getMaxDepth(), twenty.getMaxDepth()) == (30, 20)
    assert MO.build_estimator("decision_tree", max_depth=None, unlimited_depth=12).getMaxDepth() == 12


def test_missing_features_are_an_error(spark):
    df = data(spark).withColumn("feature1", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("feature1")))
    with pytest.raises(Exception, match="NaN"):
        MO.train_model("decision_tree", df, FEATS, "y")


def test_grid_and_random_search(spark, tmp_path):
    df = data(spark)
    grid = {"C": [0.1, 1.0], "penalty": ["l2"], "solver": ["lbfgs", "liblinear"]}
    t = HyperparameterTuner(cv=3, seed=42, key_cols=["id"])
    r = t.grid_search("logistic_regression", df, FEATS, "y", grid)
    assert r["best_params"] in expand_grid(grid) and len(r["params"]) == 4 and r["n_fits"] == 2
    assert all(0.5 < s <= 1 for s in r["train_scores"] + r["cv_scores"])
    table = t.candidates_table(spark, "logistic_regression").collect()
    assert len(table) == 4 and sorted(x["rank"] for x in table) == [1, 2, 3, 4] and all(x["mean_train_score"] > 0.5 for x in table)
    r2 = t.random_search("decision_tree", df, FEATS, "y", {"max_depth": [2, 3, 4], "criterion": ["gini"], "min_samples_split": [2, 5]}, n_iter=2)
    assert len(r2["params"]) == 2 and r2["not_honoured"] == [[]] * 2
    assert t.results_summary(spark).count() == 2
    t.save_best("decision_tree", str(tmp_path / "best"))
    from pyspark.ml import PipelineModel
    assert PipelineModel.load(str(tmp_path / "best")).transform(df).count() == df.count()
    with pytest.raises(ValueError):
        t.best("random_forest")
    assert len(expand_grid({"C": [1, 2], "penalty": ["l1", "l2"], "solver": ["liblinear", "lbfgs"]})) == 6


def test_fits_of_later_folds_do_not_wait_and_read_few_parts(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression
    plain, seen, later, waited, lock = LogisticRegression.fit, [], threading.Event(), [], threading.Lock()

    def fit(self, rows, params=None):
        with lock:
            seen.append(rows.rdd.getNumPartitions())
            n = len(seen)
        if n == 3:  # two candidates a fold
            later.set()
        if n == 1:
            waited.append(later.wait(60))
        return plain(self, rows, params)

    monkeypatch.setattr(LogisticRegression, "fit", fit)
    t = HyperparameterTuner(cv=3, seed=42, key_cols=["id"], parallelism=3)
    r = t.grid_search("logistic_regression", data(spark).repartition(24), FEATS, "y", {"C": [0.1, 1.0], "penalty": ["l2"], "solver": ["lbfgs"]})
    assert waited == [True] and max(seen[:6]) <= 4 and all(0.5 < s <= 1 for s in r["cv_scores"])


def test_one_call_tuning(spark):
    t = tune_hyperparameters(data(spark), FEATS, "y", ["decision_tree"], "random", n_iter=2, cv=2, key_cols=["id"], grids={"decision_tree": {"max_depth": [1, 2, 3]}})
    assert len(t.results["decision_tree"]["params"]) == 2
    with pytest.raises(ValueError):
        tune_hyperparameters(data(spark), FEATS, "y", method="other")


def test_candidates_of_the_default_grids(spark):
    """Every candidate is reported; those MLlib cannot tell apart name the one they share a fit with."""
    full = {"decision_tree": (160, 160), "random_forest": (405, 405), "xgboost": (324, 324), "lightgbm": (324, 108)}
    for name, (n, n_fits) in full.items():
        rows = candidate_rows(spark, name, expand_grid(DEFAULT_GRIDS[name])).collect()
        assert len(rows) == n and len({r["fitted_as"] for r in rows}) == n_fits == len(distinct_candidates(name, expand_grid(DEFAULT_GRIDS[name]))), name
        assert not any(r["not_honoured"] for r in rows)
    assert len({fit_key("decision_tree", c) for c in expand_grid(DEFAULT_GRIDS["decision_tree"])}) == 40
    assert len(draw_candidates("decision_tree", expand_grid(DEFAULT_GRIDS["decision_tree"]), 20, 42)) == 20


def test_run_store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"), "mine")
    assert store.runs().count() == store.versions().count() == store.stage_events().count() == 0
    ids = [store.log_run(f"m{i}", {"C": 1}, {"test_roc_auc": v}) for i, v in enumerate([0.85, 0.90, 0.88])]
    assert best_run(store.runs(), "test_roc_auc").first()["metrics"]["test_roc_auc"] == 0.90
    assert best_run(store.runs(), "test_roc_auc", ascending=True).first()["metrics"]["test_roc_auc"] == 0.85
    assert compare_runs(store.runs(), ids).count() == 3
    v1 = store.register_model("risk", ids[1], "/x/1")
    v2 = store.register_model("risk", ids[2], "/x/2")
    assert (v1, v2) == (1, 2) and store.register_model("other", ids[2], "/y/1") == 1
    store.transition_stage("risk", 1, "Production")
    store.transition_stage("risk", 2, "Staging")
    assert store.current("risk", "Production") == (1, "/x/1")
    store.transition_stage("risk", 2, "Production")
    assert store.current("risk") == (2, "/x/2")
    with pytest.raises(ValueError, match="No version"):
        store.current("nothing")
    assert best_run(store.runs(), "missing_metric").isEmpty()
    other = RunStore(spark, str(tmp_path / "runs"), "another")
    other.log_run("m9", {"C": 2}, {"test_roc_auc": 0.99, "loss": float("nan")})
    assert best_run(store.runs(), "test_roc_auc").first()["run_name"] == "m1" and compare_runs(store.runs()).count() == 3
    assert best_run(other.runs(), "test_roc_auc").first()["run_name"] == "m9" and best_run(other.runs(), "loss").isEmpty()


def test_two_writers_cannot_take_one_version(spark, tmp_path):
    """8 threads register 40 versions and log as many stages: numbers 1 to 40, once each, nothing lost."""
    from concurrent.futures import ThreadPoolExecutor
    stores = [RunStore(spark, str(tmp_path / "runs"), "mine") for _ in range(8)]

    def work(k):
        version = stores[k % 8].register_model("risk", f"run{k}", f"/x/{k}")
        stores[k % 8].transition_stage("risk", version, "Staging")
        return version

    with ThreadPoolExecutor(8) as pool:
        assert sorted(pool.map(work, range(40))) == list(range(1, 41))
    kept = stores[0].versions().collect()
    assert sorted(r["version"] for r in kept) == list(range(1, 41)) and len({r["model_path"] for r in kept}) == 40
    assert sorted(r["seq"] for r in stores[0].stage_events().collect()) == list(range(1, 41))


def test_readers_stop_at_a_gap(spark, tmp_path):
    from riskweave.sources.records import append_numbered, publish
    store = RunStore(spark, str(tmp_path / "runs"), "mine")
    store.register_model("risk", "r", "/x/1")
    text = store._text("model_name string, version int", "risk", 3)
    assert publish(spark, f"{tmp_path}/runs/model_versions/risk/{3:012d}.json", text) and not publish(spark, f"{tmp_path}/runs/model_versions/risk/{3:012d}.json", "{}")
    assert [r["version"] for r in store.versions().collect()] == [1]
    assert append_numbered(spark, f"{tmp_path}/runs/model_versions/risk", lambda n: store._text("model_name string, version int", "risk", n)) == 2
    assert sorted(r["version"] for r in store.versions().collect()) == [1, 2, 3]


def test_a_broken_run_table_is_an_error(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"), "mine")
    assert store.runs().count() == 0
    (tmp_path / "runs" / "runs").mkdir(parents=True)
    (tmp_path / "runs" / "runs" / "x.json").write_text("no record")
    with pytest.raises(Exception, match="(?i)malformed"):
        store.runs().collect()


def test_log_tuning(spark, tmp_path):
    """The best candidate's mean and its spread over the folds, not the candidates' own."""
    store = RunStore(spark, str(tmp_path / "runs"), "mine")
    result = {"cv_scores": [0.5, 0.7, float("nan")], "std_scores": [0.3, 0.02, 0.0], "best_score": 0.7, "best_params": {"max_depth": 3}, "params": [1, 2, 3]}
    df = data(spark, 50)
    store.log_tuning("decision_tree", result, "grid_search", 5, test_metrics={"test_roc_auc": 0.66}, dataset=df, label_col="y")
    run = store.runs().first()
    m = run["metrics"]
    assert (m["cv_best_score"], m["cv_mean_score"], m["cv_std_score"], m["test_roc_auc"], m["n_rows"], m["n_features"]) == (0.7, 0.7, 0.02, 0.66, 50.0, 4.0)
    assert m["n_positive"] == df.where("y = 1").count()
    assert run["params"] == {"max_depth": "3", "tuning_method": "grid_search", "cv_folds": "5", "n_combinations": "3"} and run["run_name"] == "decision_tree_grid_search"
    store.log_tuning("random_forest", result, "random_search", n_iter=20)
    random_run = store.runs().where("run_name = 'random_forest_random_search'").first()
    assert random_run["params"]["n_iter"] == "20" and "n_combinations" not in random_run["params"]


def test_logged_search_is_the_one_that_ran(spark, tmp_path):
    df = data(spark, 120)
    t = HyperparameterTuner(cv=3, seed=1, key_cols=["id"])
    r = t.grid_search("decision_tree", df, FEATS, "y", {"max_depth": [1, 2, 4]})
    store = RunStore(spark, str(tmp_path / "runs"), "mine")
    store.log_tuning("decision_tree", r, cv=3)
    m = store.runs().first()["metrics"]
    best = max(range(3), key=lambda k: (r["cv_scores"][k], -k))
    assert m["cv_mean_score"] == r["best_score"] == r["cv_scores"][best] and m["cv_std_score"] == r["std_scores"][best]


def test_a_nan_feature_is_not_scored(spark):
    d = data(spark)
    m = MO.train_model("logistic_regression", d, FEATS, "y")
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1, [nan, 1.0, 2.0]), (2, [1.0, None, 2.0]), (3, [inf, -inf, 1.0]), (4, [1.0, 1.0, 1.0])], "id long, features array<double>")
    for scored in (SC.batch_score(m, rows, "features", 3), SC.linear_score(rows, [1.0, 1.0, 1.0], 0.0)):
        got = {r["id"]: r for r in SC.with_risk_bands(scored).collect()}
        assert [got[i]["reject_reason"] for i in (1, 2, 3, 4)] == ["missing value in features"] * 2 + [None] * 2
        assert all(got[i][c] is None for i in (1, 2, 3) for c in ("probability", "prediction", "risk_level", "risk_band", "decision"))
        assert got[4]["prediction"] == 1 and got[4]["risk_level"] == "high"


def test_scoring_bands_and_width(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (0.6,), (0.61,)], "probability double")
    out = [(r["risk_band"], r["decision"]) for r in SC.with_risk_bands(df).collect()]
    assert out == [("low", "approve"), ("medium", "review"), ("medium", "review"), ("high", "reject")]
    d = data(spark)
    m = MO.train_model("logistic_regression", d, FEATS, "y")
    arr = d.select("id", F.array(*FEATS).alias("features"))
    bad = spark.createDataFrame([(999, [1.0, 2.0])], "id long, features array<double>")
    rows = arr.unionByName(bad).unionByName(spark.createDataFrame([(998, None), (997, [1.0, None, 2.0])], "id long, features array<double>"))
    scored = {r["id"]: r for r in SC.batch_score(m, rows, "features", 3).collect()}
    assert len(scored) == 203
    assert {r["risk_level"] for i, r in scored.items() if i < 900} <= {"high", "low"}
    assert scored[999]["reject_reason"] == "expected 3 features, got 2" and scored[998]["reject_reason"] == "expected 3 features, got 0"
    assert "missing" in scored[997]["reject_reason"] and all(scored[i]["prediction"] is None and scored[i]["risk_level"] is None for i in (997, 998, 999))
    _, quarantined = SC.split_valid(arr.unionByName(bad), "features", 3)
    assert quarantined.count() == 1
    missing = spark.createDataFrame([(None,), (float("nan"),)], "probability double")
    assert {(r["risk_band"], r["decision"]) for r in SC.with_risk_bands(missing).collect()} == {(None, None)}
    lr = m.stages[-1]
    card = {r["id"]: r for r in SC.linear_score(rows, list(lr.coefficients), lr.intercept).collect()}
    assert all(abs(card[i]["probability"] - scored[i]["probability"]) < 1e-9 for i in range(200)) and card[999]["prediction"] is None


def test_logistic_optimum(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.4 + 1.5 * x[:, 0] - x[:, 1])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    model = MO.train_model("logistic_regression", df, ["a", "b"], "y", C=0.1, tol=1e-12)
    got = {r.feature: r for r in MO.logistic_optimum(model, df, ["a", "b"], "y", 0.1).collect()}
    assert set(got) == {"(intercept)", "a", "b"}
    assert all(abs(r.gradient) < 1e-6 for r in got.values())
    # The gradient at the same coefficients under another penalty, by hand.
    w = np.array([got["a"].coefficient, got["b"].coefficient])
    off = 1 / (1 + np.exp(-(got["(intercept)"].coefficient + x @ w))) - y
    other = {r.feature: r.gradient for r in MO.logistic_optimum(model, df, ["a", "b"], "y", 1.0).collect()}
    assert np.allclose([other["(intercept)"], other["a"], other["b"]], [off.mean(), *(off @ x / 400 + w / 400)])
    holes = df.unionByName(spark.createDataFrame([(None, 1.0, 1)], "a double, b double, y int"))
    assert all(r.gradient is None for r in MO.logistic_optimum(model, holes, ["a", "b"], "y", 0.1).collect())
    unlabelled = df.unionByName(spark.createDataFrame([(1.0, 1.0, None)], "a double, b double, y int"))
    assert all(abs(r.gradient) < 1e-6 for r in MO.logistic_optimum(model, unlabelled, ["a", "b"], "y", 0.1).collect())


def test_labelled_features_are_computed_once(spark, monkeypatch):
    """Splits, fits and metrics read stored rows: the feature processor's and the split's plans are run once."""
    from riskweave.plans import q_model as QM
    from riskweave.plans.catalog import table
    rows = table(spark, "/root/testdata/sf0.001", "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 2).cast("int").alias(QM.LABEL))
    runs = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda v: runs.add(1) or v, "double")
    train, test = QM._split_labelled(rows.withColumn("o_totalprice", seen("o_totalprice")).localCheckpoint())
    n = rows.count()
    for _ in range(2):
        assert train.agg(F.sum("o_totalprice")).count() + test.agg(F.sum("o_totalprice")).count() == 2
    assert runs.value == n and train.count() + test.count() == n
    assert not any(op in train._jdf.queryExecution().optimizedPlan().toString() for op in ("Join", "Aggregate", "Window"))


def test_forests_keep_their_rows_nodes_between_passes(spark):
    from pyspark.ml.feature import VectorAssembler
    rows = spark.range(600).select((F.col("id") % 37).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), (F.col("id") * 7919 % 5 > 1).cast("double").alias("y"))
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).select("features", "y").repartition(3).cache()
    est = MO.build_estimator("random_forest", seed=3, label_col="y", n_estimators=5, max_depth=6)
    assert est.getCacheNodeIds()
    kept, walked = est.fit(data), est.copy({est.cacheNodeIds: False}).fit(data)
    assert kept.toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]
