"""Hand-made edge cases for the metric aggregates."""
import pytest

from quarry.operators import metrics as M


def test_weighted_metrics_unseen_classes(spark):
    # class c is never predicted, class d is never true
    df = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, "b", "b"), (4, "c", "d")], "id long, y string, p string")
    r = M.classification_metrics(df, "y", "p").first()
    assert r["accuracy"] == pytest.approx(0.5)
    # per class: a P=1 R=.5 ; b P=.5 R=1 ; c P=0 R=0 ; supports 2,1,1
    assert r["precision_weighted"] == pytest.approx((2 * 1 + 1 * 0.5) / 4)
    assert r["recall_weighted"] == pytest.approx(r["accuracy"])
    f_a, f_b = 2 * 1 * 0.5 / 1.5, 2 * 0.5 * 1 / 1.5
    assert r["f1_weighted"] == pytest.approx((2 * f_a + f_b) / 4)


def test_single_class(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "a", "a")], "id long, y string, p string")
    r = M.classification_metrics(df, "y", "p").first()
    assert r["accuracy"] == 1.0 and r["f1_weighted"] == 1.0


def test_regression_constant_target(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0), (2, 2.0, 2.0)], "id long, y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert r["r2"] == 1.0 and r["mse"] == 0.0
    df2 = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 3.0)], "id long, y double, p double")
    assert M.regression_metrics(df2, "y", "p").first()["r2"] == 0.0


def test_rmse_squared_is_mse_and_mape_zero_target(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 4.0, 2.0)], "id long, y double, p double")
    r = M.timeseries_metrics(df, "y", "p").first()
    assert r["rmse"] ** 2 == pytest.approx(r["mse"])
    assert r["mape"] == pytest.approx(100 * (1 / 1e-10 + 0.5) / 2)


def test_anomaly_metrics_single_class_auc_zero(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "id long, y int, p int")
    r = M.anomaly_metrics(df, "y", "p").first()
    assert r["roc_auc"] == 0.0 and r["false_positives"] == 1 and r["true_negatives"] == 1


def test_anomaly_map_and_ratio(spark):
    df = spark.createDataFrame([(1, -1), (2, 1), (3, 1)], "id long, raw int")
    m = df.withColumn("p", M.anomaly_map("raw"))
    r = M.anomaly_ratio(m, "p").first()
    assert r["n_anomalies"] == 1 and r["n_normal"] == 2
