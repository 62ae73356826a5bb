"""Tuning of linear models from moments: the models of plain fits, in one pass over the training rows."""
import numpy as np
import pytest

from quarry.models import supervised as S
from quarry.plans.tune import tune_cv, tune_holdout

FEATURES = ["a", "b", "c"]


def rows(spark, n=300, missing=False):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(50, 3, n), rng.integers(0, 4, n), np.full(n, 7.0)])
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(size=n)
    out = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    if missing:
        out[3] = (3, None, *out[3][2:])
    return spark.createDataFrame(out, "id long, a double, b double, c double, label double")


@pytest.mark.parametrize("name, alpha", [("ridge", 0.5), ("ridge", 80.0), ("lasso", 0.01), ("lasso", 2.0)])
def test_a_model_from_moments_is_that_of_the_table(spark, name, alpha):
    df = rows(spark)
    parts = [S.Moments.of(df.filter(f"id % 3 = {k}"), FEATURES) for k in range(3)]
    got = S.fit_regressor_from(spark, S.Moments.together(parts), FEATURES, name, {"alpha": alpha}).stages[-1]
    want = S.fit_regressor(df, FEATURES, name, {"alpha": alpha}).stages[-1]
    assert np.allclose(got.coefficients.toArray(), want.coefficients.toArray(), atol=1e-6) and np.isclose(got.intercept, want.intercept, atol=1e-4)


def test_trials_share_a_pass(spark, monkeypatch):
    df = rows(spark)
    fits = []
    monkeypatch.setattr(S, "fit_regressor", lambda *a, **k: fits.append(1))
    got = tune_holdout(spark, "regression", "ridge", df.filter("id % 5 > 0"), df.filter("id % 5 = 0"), FEATURES, n_trials=3)
    assert got.filter("status = 'FINISHED' and score > 0.9").count() == 3
    got = tune_cv(spark, "regression", "lasso", df, FEATURES, folds=3, n_trials=2, space={"alpha": {"type": "float", "low": 0.01, "high": 0.1}})
    assert got.filter("status = 'FINISHED' and score > 0.9").count() == 2 and not fits


def test_missing_values_fail_each_trial(spark):
    df = rows(spark, missing=True)
    got = tune_holdout(spark, "regression", "ridge", df, df, FEATURES, n_trials=2).collect()
    assert [r["status"] for r in got] == ["FAILED"] * 2 and "missing values" in got[0]["error"]
