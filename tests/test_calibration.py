"""Probabilities of margin classifiers."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.models import calibration, fit_model
from quarry.models.served import ServedModel, load_model


def test_curves_are_the_best_logistic_ones(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=4000)
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-(1.7 * m - 0.4)))).astype(float)
    rows = spark.createDataFrame([([float(a)], float(b)) for a, b in zip(m, y)], "m array<double>, label double")
    (a, b), = calibration.fit_curves(rows, 2)
    assert abs(a - 1.7) < 0.15 and abs(b + 0.4) < 0.1
    # separable margins stay finite, one class too
    rows = spark.createDataFrame([([float(i - 5) * 100], float(i >= 5)) for i in range(10)], "m array<double>, label double")
    assert np.isfinite(calibration.fit_curves(rows, 2)).all()
    assert np.isfinite(calibration.fit_curves(rows.filter("label = 1"), 2)).all()


@pytest.mark.parametrize("classes", [2, 3])
def test_every_classifier_has_probabilities(spark, tmp_path, classes):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 2))
    z = np.column_stack([np.zeros(1500), 1.5 * x[:, 0], -1.0 + 1.5 * x[:, 1]])[:, :classes]
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.array([rng.choice(classes, p=r) for r in p])
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, label double")
    m = fit_model("classification", "svm", df, ["a", "b"], {"kernel": "linear", "probability": True}, n_classes=classes, key="id")
    got = {r["id"]: r["probability"] for r in m.transform(df).collect()}
    q = np.array([got[i] for i in range(1500)])
    assert np.allclose(q.sum(1), 1) and q.min() >= 0
    # expected calibration error over ten bins, of every class
    for c in range(classes):
        cell = np.minimum((q[:, c] * 10).astype(int), 9)
        gap = sum(abs(q[cell == b, c].sum() - (y[cell == b] == c).sum()) for b in range(10)) / 1500
        assert gap < 0.08, (c, gap)
    ServedModel(m, ["a", "b"]).save(str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m")).transform(df).filter("id = 7").first()
    assert np.allclose(again["probability"], got[7])
    assert m.transform(df.withColumn("probability_x", F.lit(1))).count() == 1500


def test_a_solver_gets_few_partitions_and_the_same_margins(spark):
    from quarry.models import supervised

    df = spark.range(600).selectExpr("cast(id % 7 as double) as a", "cast(id % 11 as double) as b", "cast(id % 3 as double) as label").repartition(40, "a", "b")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        few = supervised.few_parts(df, 600)
        assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < df.rdd.getNumPartitions()
        assert supervised.few_parts(df, 600, rows=60).rdd.getNumPartitions() == 10  # as many as the rows need
        assert sorted(few.collect()) == sorted(df.collect())
        model = supervised.fit_classifier(df, ["a", "b"], "logistic_regression", {"max_iter": 5}, 3)
        assert model.stages[-1].numClasses == 3
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
