"""Hand-made frames for the model layer: planted forecasts, categorical
features in every task, save - load - score, kernels, far and null rows."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.models import anomaly as A
from quarry.models import clustering as C
from quarry.models import fit_model
from quarry.models.catalog import CATALOG, ignored_params
from quarry.models.served import load_model
from quarry.operators.profile import profile_nulls, profile_numeric
from quarry.plans.train import TrainConfig, train_many
from quarry.plans.tune import checked_trials, tune_cv, tune_holdout

SMALL = {"n_estimators": 5, "max_depth": 3}


def series(spark, f, n=400, per_day=1.0):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(days=i / per_day), float(f(i / per_day)), i, "s") for i in range(n)]
    return spark.createDataFrame(rows, "id long, t timestamp, label double, position long, key string")


@pytest.mark.parametrize("f", [lambda d: 1000.0, lambda d: 50.0 + 3.0 * d, lambda d: 200.0 + 40.0 * np.sin(2 * np.pi * d / 7)])
@pytest.mark.parametrize("n", [20, 400])
def test_trend_and_season_are_met(spark, f, n):
    df = series(spark, f, n)
    for mode in ("additive", "multiplicative") if n == 400 else ("additive",):
        if n == 20 and abs(f(1.7) - f(0)) > 1 and abs(f(7) - f(0)) < 1e-6:
            continue  # a season needs two weeks of data
        if mode == "multiplicative" and f(5) - f(0) == 15.0:
            continue  # a line is not a line on the log scale
        m = fit_model("timeseries", "prophet", df, [], {"seasonality_mode": mode}, time_col="t")
        err = m.transform(df).agg(F.max(F.abs(F.col("prediction") / F.col("label") - 1))).first()[0]
        assert err < (0.01 if mode == "additive" else 0.05), (mode, err)


def test_series_decide_alone_and_names_do_not_clash(spark):
    a = series(spark, lambda d: 100.0, 60).withColumn("key", F.lit("a"))
    b = series(spark, lambda d: -5.0, 60).withColumn("key", F.lit("b"))
    df = a.unionByName(b).withColumn("phi", F.lit(1)).withColumn("T", F.lit(2)).withColumn("theta", F.lit(3)).withColumn("coef", F.lit(4))
    m = fit_model("timeseries", "prophet", df, [], {}, time_col="t", series_key="key")
    r = {x["key"]: x["p"] for x in m.transform(df).groupBy("key").agg(F.avg("prediction").alias("p")).collect()}
    assert abs(r["a"] - 100) < 0.5 and abs(r["b"] + 5) < 0.1
    ar = fit_model("timeseries", "arima", df, [], {"order": (1, 1, 1)}, series_key="key")
    out = ar.transform(df)
    assert out.columns == df.columns + ["prediction"] and out.count() == 120
    # other orders are fitted, too (tests/test_arima.py); what is no order is refused
    assert fit_model("timeseries", "arima", df, [], {"order": (3, 0, 0)}, series_key="key").transform(df).count() == 120
    with pytest.raises(ValueError):
        fit_model("timeseries", "arima", df, [], {"order": (3, -1, 0)}, series_key="key")


def ts_config(**kw):
    return TrainConfig(task="timeseries", target="label", key="id", time_col="t", lookback=3, features=["label"], **kw)


def test_horizon_and_text_times(spark, tmp_path):
    df = series(spark, lambda d: 10 + 2 * d, 120).withColumn("t", F.date_format("t", "yyyy-MM-dd HH:mm:ss")).drop("position", "key")
    df = df.withColumnRenamed("label", "v").withColumn("label", F.col("v")).drop("v")
    res = train_many(spark, df, ts_config(models=["linear_regression", "arima", "prophet"], horizon=3))
    assert res.runs.where("status = 'FINISHED'").count() == 3
    m = res.models["linear_regression"]
    row = m.transform(res.prepared).orderBy("position").first()
    assert np.allclose(row["prediction"], row["label"], rtol=1e-3) and len(row["label"]) == 3
    m.save(str(tmp_path / "h"))
    again = load_model(spark, str(tmp_path / "h")).transform(res.prepared).orderBy("position").first()
    assert np.allclose(again["prediction"], row["prediction"])


def mixed(spark, n=240):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(i % 5), ["red", "green", "blue"][i % 3], int(i % 3 == 0)) for i, x in enumerate(rng.normal(size=n))]
    return spark.createDataFrame(rows, "id long, x double, z double, colour string, y int")


UNSUPERVISED = [("anomaly_detection", n) for n in ("isolation_forest", "one_class_svm", "local_outlier_factor", "elliptic_envelope")] + [
    ("clustering", n) for n in CATALOG["clustering"]]
QUICK = {"isolation_forest": {"n_estimators": 10}, "kmeans": {"n_init": 2, "max_iter": 20}, "meanshift": {"bandwidth": 2.0},
         "random_forest": SMALL, "gradient_boosting": SMALL, "xgboost": SMALL, "lightgbm": SMALL, "random_forest_supervised": SMALL,
         "xgboost_supervised": SMALL, "dbscan": {"eps": 1.0}}


# every class of fitted model; the other catalogue entries share the pipeline class
@pytest.mark.parametrize("task,name", UNSUPERVISED + [("classification", "svm"), ("regression", "lasso"), ("anomaly_detection", "random_forest_supervised")])
def test_text_features_save_load_score(spark, tmp_path, task, name):
    df = mixed(spark)
    target = None if (task, name) in UNSUPERVISED else "z" if task == "regression" else "y"
    feats = ["x", "colour"] + ([] if target == "z" else ["z"])
    cfg = TrainConfig(task=task, target=target, key="id", features=feats, models=[name], overrides={name: QUICK.get(name, {})})
    res = train_many(spark, df, cfg)
    m = res.models[name]
    raw = df.drop("y") if target != "z" else df.drop("z", "y")
    out = m.transform(raw)
    first = {r["id"]: r["prediction"] for r in out.collect()}
    assert len(first) == 240 and all(v is not None for v in first.values())
    assert dict(out.dtypes)["colour"] == "string"
    m.save(str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert again.features == feats
    assert {r["id"]: r["prediction"] for r in again.transform(raw).collect()} == first
    res.release()


def test_rows_with_nulls_come_back(spark):
    df = mixed(spark, 50).select("id", F.when(F.col("id") % 5 > 0, F.col("x")).alias("x"), "z")
    train = df.where("x is not null")
    for name in ("kmeans", "gaussian_mixture"):
        out = fit_model("clustering", name, train, ["x", "z"], {}, key="id").transform(df).collect()
        assert len(out) == 50 and sum(r["prediction"] is None for r in out) == 10
    with pytest.raises(ValueError, match="x"):
        fit_model("clustering", "kmeans", df, ["x", "z"], {}, key="id")
    lof = A.fit_lof(train, ["x", "z"], "id", 5)
    far = spark.createDataFrame([(1, 1e6, 0.0), (2, -1e9, 1e9), (3, 0.0, 2.0), (4, None, 1.0)], "id long, x double, z double")
    got = {r["id"]: (r["score"], r["prediction"]) for r in lof.transform(far).collect()}
    assert got[1][1] == got[2][1] == 1.0 and got[1][0] > 1e3 and got[3][1] == 0.0 and got[4] == (None, None)


@pytest.mark.parametrize("nu", [0.05, 0.1, 0.3])
def test_one_class_share(spark, nu):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))], "id long, a double, b double")
    m = A.fit_one_class_svm(df, ["a", "b"], nu)
    share = m.transform(df).agg(F.avg("prediction")).first()[0]
    assert abs(share - nu) < 0.02
    assert m.transform(spark.createDataFrame([(1, 9.0, 9.0)], "id long, a double, b double")).first()["prediction"] == 1.0


def test_dbscan_long_chain(spark):
    rnd = np.random.default_rng(1)
    for n in (261, 2000):
        ids = rnd.permutation(n)
        df = spark.createDataFrame([(int(i), k * 0.45) for k, i in enumerate(ids)], "id long, x double")
        labels, _ = C.dbscan(df, "id", ["x"], eps=0.5, min_samples=2)
        assert {r["cluster"] for r in labels.collect()} == {0}


def test_poly_kernel_is_its_kernel(spark):
    from quarry.models.supervised import PolynomialKernelFeatures
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(1.0, -2.0, 0.5), (0.3, 1.0, 2.0)], "a double, b double, c double")
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    z = [r["rff"].toArray() for r in PolynomialKernelFeatures(inputCol="features", outputCol="rff", gamma=0.7, degree=3, dim=3).transform(v).collect()]
    x = np.array([[1.0, -2.0, 0.5], [0.3, 1.0, 2.0]])
    assert np.allclose(np.array(z) @ np.array(z).T, (0.7 * x @ x.T) ** 3)


def test_tuning_runs_what_was_asked(spark, monkeypatch):
    import quarry.models as models

    df = mixed(spark).withColumn("label", F.col("y").cast("double"))
    seen = []
    real = models.fit_model
    monkeypatch.setattr(models, "fit_model", lambda t, n, tr, f, p, **kw: (seen.append(p), real(t, n, tr, f, {**p, **SMALL}, **kw))[1])
    space = {"min_samples_split": {"type": "int", "low": 2, "high": 9}, "max_depth": {"type": "int", "low": 2, "high": 4}}
    t = tune_holdout(spark, "classification", "random_forest", df, df, ["x", "z"], space, n_trials=3).collect()
    assert len(t) == 3 and all(p["n_estimators"] == 300 for p in seen) and all(r["ignored"] == [] for r in t)
    t = tune_cv(spark, "classification", "random_forest", df, ["x", "z"], 2, space, n_trials=1, overrides={"max_depth": 2}, timeout_min=5).collect()
    assert t[0]["params"]["max_depth"] == "2" and t[0]["status"] == "FINISHED"
    t = tune_cv(spark, "classification", "svm", df, ["x", "z"], 2, {"kernel": {"type": "categorical", "choices": ["sigmoid"]}}, n_trials=1).collect()
    assert t[0]["status"] == "FAILED" and "sigmoid" in t[0]["error"]
    with pytest.raises(ValueError):
        checked_trials(0)
    # trees honour min_samples_split and any depth (tests/test_trees.py); what they have no option for is named
    assert ignored_params("random_forest", {"max_depth": 31, "warm_start": True}) == ["warm_start"]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    r = profile_numeric(df).first()
    assert (r["null_count"], r["min"], r["max"], r["mean"], r["median"]) == (2, 1.0, 3.0, 2.0, 2.0)
    assert profile_nulls(df).first()["null_count"] == 2


def test_registered_tuning_asks_for_its_whole_search(spark, monkeypatch):
    from quarry.plans import queries_models as qm

    class Asked(Exception):
        pass

    def asked(_, __, cfg):
        raise Asked(cfg.hpo["n_trials"])

    monkeypatch.setattr(qm, "quality_frame", lambda *_: None)
    monkeypatch.setattr(qm, "train_many", asked)
    with pytest.raises(Asked) as e:
        qm.q_train_many_tuned(spark, "")
    assert e.value.args[0] >= 10
