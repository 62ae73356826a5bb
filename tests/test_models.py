"""Model sanity on planted signal, save/load, and the custom algorithms."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.models import anomaly as A
from quarry.models import clustering as C
from quarry.operators import metrics as M
from quarry.plans.train import TrainConfig, train_many

SF = "/root/testdata/sf0.001"


def test_planted_regression(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").withColumn("k", (F.col("p_partkey") % 1000).cast("double"))
    cfg = TrainConfig(task="regression", target="p_retailprice", key="p_partkey", features=["k"],
                      models=["linear_regression", "ridge"])
    res = train_many(spark, part, cfg)
    best = res.leaderboard.where("rank = 1").first()
    assert best["score"] > 0.999


def test_planted_classification_beats_majority(spark):
    df = spark.range(0, 600).withColumn("x", F.rand(7) * 10).withColumn("z", F.rand(8))
    df = df.withColumn("y", F.when(F.col("x") > 5, "hi").otherwise("lo"))
    cfg = TrainConfig(task="classification", target="y", key="id", features=["x", "z"],
                      models=["logistic_regression", "random_forest"], overrides={"random_forest": {"n_estimators": 10}})
    res = train_many(spark, df, cfg)
    assert res.leaderboard.where("rank = 1").first()["score"] > 0.9


def test_isolation_forest_finds_planted(spark):
    rng = np.random.default_rng(0)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, size=(500, 2)))]
    pts += [(1000 + i, 8.0 + i, -8.0) for i in range(5)]
    df = spark.createDataFrame(pts, "id long, a double, b double")
    m = A.fit_isolation_forest(df, ["a", "b"], "id", n_estimators=50, contamination=0.02)
    flagged = {r["id"] for r in m.transform(df).where("prediction = 1").collect()}
    assert {1000, 1001, 1002, 1003, 1004} <= flagged


def test_dbscan_two_blobs_and_noise(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(0, 0.1, size=(60, 2))
    b = rng.normal(5, 0.1, size=(60, 2))
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([a, b]))] + [(999, 20.0, 20.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    labels, _ = C.dbscan(df, "id", ["x", "y"], eps=0.5, min_samples=5)
    lab = {r["id"]: r["cluster"] for r in labels.collect()}
    assert lab[999] == -1
    assert len({lab[i] for i in range(60)}) == 1 and len({lab[i] for i in range(60, 120)}) == 1
    assert lab[0] != lab[60]


def test_silhouette_matches_mllib(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(2)
    pts = [(i, float(x), float(y), int(i % 3)) for i, (x, y) in enumerate(rng.normal(0, 1, size=(90, 2)))]
    df = spark.createDataFrame(pts, "id long, x double, y double, k int")
    ours = C.silhouette_score(df, ["x", "y"], "k").first()["silhouette_score"]
    v = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df.withColumn("prediction", F.col("k").cast("double")))
    ref = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(v)
    assert abs(ours - ref) < 1e-9


def test_save_load_same_predictions(spark, tmp_path):
    from quarry.models import PipelineFitted
    from quarry.sources.sinks import load_model, write_model

    df = spark.range(0, 200).withColumn("x", F.col("id") % 17).withColumn("y", (F.col("x") > 8).cast("string"))
    res = train_many(spark, df, TrainConfig(task="classification", target="y", key="id", features=["x"],
                                            models=["logistic_regression"]))
    m = res.models["logistic_regression"]
    write_model(m.model, str(tmp_path))
    again = PipelineFitted(load_model(str(tmp_path)), ["x"], "classification", "lr")
    a = m.transform(res.prepared).select("id", "prediction").collect()
    b = again.transform(res.prepared).select("id", "prediction").collect()
    assert sorted(a) == sorted(b)


def test_leaderboard_rmse_minimises(spark):
    from quarry.operators.selection import leaderboard

    runs = spark.createDataFrame([("e", "a", 0, 2.0), ("e", "b", 1, 1.0)], "experiment string, model string, model_order int, score double")
    best = leaderboard(runs, "score", M.PRIMARY_METRIC["timeseries"][1]).where("rank = 1").first()
    assert best["model"] == "b"


def _dbscan_brute(ids, X, eps, min_samples):
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1) <= eps * eps
    core = D.sum(1) >= min_samples
    label = {}
    for i in np.argsort(ids):
        if not core[i] or ids[i] in label:
            continue
        comp, stack = [], [i]
        seen = {i}
        while stack:
            j = stack.pop()
            comp.append(j)
            for k in np.flatnonzero(D[j] & core):
                if k not in seen:
                    seen.add(k)
                    stack.append(k)
        lab = min(ids[j] for j in comp)
        for j in comp:
            label[ids[j]] = lab
    out = {}
    for i in range(len(ids)):
        if core[i]:
            out[ids[i]] = label[ids[i]]
        else:
            nb = [label[ids[k]] for k in np.flatnonzero(D[i] & core)]
            out[ids[i]] = min(nb) if nb else -1
    return out


@pytest.mark.parametrize("scale", [0.15, 0.4])
def test_dbscan_matches_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    X = np.vstack([rng.normal(c, scale, size=(120, 2)) for c in ((0, 0), (1.2, 0.3), (4, 4))] + [rng.uniform(-2, 6, size=(40, 2))])
    ids = np.arange(len(X)) * 3 + 7
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in zip(ids, X)], "id long, x double, y double")
    labels, _ = C.dbscan(df, "id", ["x", "y"], eps=0.3, min_samples=5)
    got = {r["id"]: r["cluster"] for r in labels.collect()}
    assert got == _dbscan_brute(ids, X, 0.3, 5)


def test_lof_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    X = np.vstack([rng.normal(0, 0.05, size=(300, 2)), rng.normal(3, 1.0, size=(100, 2)), rng.uniform(-5, 8, size=(20, 2))])
    ids = np.arange(len(X))
    k = 10
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in zip(ids, X)], "id long, x double, y double")
    got = {r["id"]: r["lof"] for r in A.local_outlier_factor(df, "id", ["x", "y"], k).collect()}
    D2 = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(D2, np.inf)
    nn = np.array([sorted(range(len(X)), key=lambda j: (D2[i, j], j))[:k] for i in range(len(X))])
    dist = np.sqrt(np.take_along_axis(D2, nn, 1))
    kd = dist.max(1)
    lrd = 1.0 / (np.maximum(kd[nn], dist).mean(1) + 1e-10)
    lof = lrd[nn].mean(1) / lrd
    for i in ids:
        assert got[int(i)] == pytest.approx(lof[i], rel=1e-9)
