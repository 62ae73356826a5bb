"""Passes of the one-class SVM over packed random features."""
import math

import numpy as np
import pytest

from quarry.models import anomaly as A


def frame(spark, x):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"x{i} double" for i in range(x.shape[1])))


def test_cut_and_mean_of_the_lowest_margins(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 2))
    x[200:260] = x[0]  # equal rows stay together
    W, b, w = rng.normal(size=(20, 2)), rng.uniform(0, 6, 20), rng.normal(size=20)
    z = A.FourierRows.build(frame(spark, x).repartition(3), W, b)
    plain = A.fourier(x, W, b)
    m = plain @ w
    assert np.allclose(z.mean(), plain.mean(axis=0))
    for rank in (1, 70, 350, int((m < m[0]).sum()) + 5, 700):
        at = np.sort(m)[rank - 1]
        cut = z.cut(w, rank, 1)
        assert (m <= cut).sum() == (m <= at + 1e-12).sum()
        assert np.allclose(z.mean(w, cut), plain[m <= at + 1e-12].mean(axis=0))
    assert 350 <= (m <= z.cut(w, 350, 40)).sum() < 390
    z.rows.unpersist()


def test_fit_equals_a_plain_one(spark):
    rng = np.random.default_rng(6)
    x, nu, tol = rng.normal(size=(500, 2)), 0.1, 0.05
    df = frame(spark, x)
    model = A.fit_one_class_svm(df, ["x0", "x1"], nu, tol=tol)
    z = A.fourier(x, *(np.array(model.rff.getOrDefault(p)) for p in (model.rff.weights, model.rff.offsets)))
    w = z.mean(axis=0)
    for step in range(500):
        m = z @ w
        target = z[m <= np.sort(m)[math.ceil(nu * len(m)) - 1] + 1e-13].mean(axis=0)
        new = w + (target - w) * 2.0 / (step + 3.0)
        moved = np.linalg.norm(new - w) / max(np.linalg.norm(w), np.linalg.norm(target))
        w = new
        if moved < tol:
            break
    assert np.allclose(model.w, w) and model.rho == pytest.approx(np.quantile(z @ w, nu))
    got = {(r["x0"], r["x1"]): r["score"] for r in model.transform(df).collect()}
    assert all(got[tuple(r)] == pytest.approx(s) for r, s in zip(x, model.rho - z @ w))


def test_missing_features(spark):
    x = np.random.default_rng(7).normal(size=(100, 2))
    df = frame(spark, x)
    model = A.fit_one_class_svm(df, ["x0", "x1"], 0.2, tol=0.1)
    odd = spark.createDataFrame([(0.0, None), (float("nan"), 1.0)], "x0 double, x1 double")
    assert [(math.isnan(r["score"]), r["prediction"]) for r in model.transform(odd).collect()] == [(True, 1.0)] * 2
    with pytest.raises(ValueError, match="x1"):
        A.fit_one_class_svm(df.unionByName(odd.limit(1)), ["x0", "x1"])


def test_a_pass_has_as_few_tasks_as_its_rows_need(spark):
    """A step of the fit is short: its tasks do not follow the shuffle partitions."""
    x = np.random.default_rng(8).normal(size=(200, 2))
    kept, tracker = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext.statusTracker()
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.sparkContext.setJobGroup("one-class-passes", "")
    try:
        A.fit_one_class_svm(frame(spark, x), ["x0", "x1"], 0.2, tol=0.1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    infos = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("one-class-passes")]
    tasks = [s.numTasks for i in infos if i for s in (tracker.getStageInfo(k) for k in i.stageIds) if s]
    assert tasks and max(tasks) <= max(8, spark.sparkContext.defaultParallelism)


@pytest.mark.parametrize("size", [1.0, 1e9])  # angles of many turns are not reduced in single precision
def test_only_the_rows_are_kept(spark, size):
    rng = np.random.default_rng(9)
    x, W, b, w = rng.normal(size=(900, 2)) * size, rng.normal(size=(300, 2)), rng.uniform(0, 6, 300), rng.normal(size=300)
    z = A.FourierRows.build(frame(spark, x).repartition(3), W, b)
    assert not z.rows.storageLevel.useMemory
    assert z.rows.selectExpr("sum(length(x))").first()[0] == x.nbytes
    plain = A.fourier(x, W, b)
    m, near = plain @ w, z.near(w)(x)
    assert np.abs(near - m).max() <= z.slack(w)
    assert size > 1 or (near != m).any()
    at = np.sort(m)[89]
    assert (m <= z.cut(w, 90, 1)).sum() == 90
    assert np.allclose(z.mean(w, z.cut(w, 90, 1)), plain[m <= at].mean(axis=0), atol=1e-12)
