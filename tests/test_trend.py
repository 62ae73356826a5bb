"""Change points of the trend, and intervals."""
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from quarry.models import fit_model, forecast
from quarry.models.forecast import sparse_solution, sparse_solutions


def test_sparse_solution_is_the_minimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8))
    y = x @ np.array([1, -2, 0, 0, 3, 0, 0, 0.5]) + 0.1 * rng.normal(size=200)
    A, b, pen = x.T @ x, x.T @ y, np.array([False, False, True, True, True, True, True, True])
    c = sparse_solution(A, b, pen, 30.0)
    g = A @ c - b
    assert np.abs(g[~pen]).max() < 1e-6
    for j in np.flatnonzero(pen):  # the conditions of the minimum
        assert abs(g[j] + 30 * np.sign(c[j])) < 1e-4 if c[j] else abs(g[j]) <= 30 + 1e-4
    assert (c[[2, 3, 5, 6]] == 0).sum() >= 3 and c[4] != 0


def test_planted_breaks_are_found_and_the_rest_is_zero(spark):
    n, t0 = 1000, dt.datetime(2020, 1, 1)
    rng = np.random.default_rng(3)
    t = np.arange(n) / (n - 1)
    at = [0.8 * j / 26 for j in range(1, 26)]
    breaks = {7: 60.0, 17: -90.0}
    lines = {"broken": 20 + 10 * t + sum(s * np.maximum(t - at[j], 0) for j, s in breaks.items()), "straight": 50 - 20 * t}
    rows = [(s, t0 + dt.timedelta(days=i), float(v + rng.normal() * 0.3)) for s, y in lines.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "s string, t timestamp, label double")
    m = fit_model("timeseries", "prophet", df, [], {"seasonality_mode": "additive"}, time_col="t", series_key="s")
    coef = {r["__series"]: np.array(r["__f_coef"])[2:27] for r in m.coefs.collect()}
    slope = coef["broken"]
    for j, size in breaks.items():  # the change is at its place or the one beside it
        assert abs(slope[max(0, j - 2):j + 1].sum() - size) < 0.2 * abs(size)
    assert (slope == 0).sum() >= 15 and np.abs(np.delete(slope, [5, 6, 7, 15, 16, 17])).max() < 9
    assert np.abs(coef["straight"]).sum() < 2 and (coef["straight"] == 0).sum() >= 23
    out = m.intervals(df).collect()
    inside = np.mean([r["prediction_lower"] <= r["label"] <= r["prediction_upper"] for r in out])
    assert 0.75 < inside < 0.85
    later = spark.createDataFrame([("broken", t0 + dt.timedelta(days=n + 10 * i), 0.0) for i in range(5)], "s string, t timestamp, label double")
    wide = [r["prediction_upper"] - r["prediction_lower"] for r in m.intervals(later).orderBy("t").collect()]
    assert all(b > a for a, b in zip(wide, wide[1:]))
    assert m.intervals(df.withColumn("prediction_x", F.lit(1))).count() == 2000


def test_systems_solved_together_are_those_solved_alone():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6, 80, 7))
    x[3, :, 5] = x[3, :, 4]  # not unique
    x[4, :, 6] = 0.0
    y = np.einsum("ijk,k->ij", x, [1, -2, 0, 0, 3, 0, 0.5]) + 0.1 * rng.normal(size=(6, 80))
    A, b, pen = np.einsum("ijk,ijl->ikl", x, x), np.einsum("ijk,ij->ik", x, y), np.arange(7) > 1
    weight = np.array([1.0, 5.0, 30.0, 5.0, 5.0, 1e6])
    together = sparse_solutions(A, b, pen, weight)
    for i in range(6):
        assert np.allclose(together[i], sparse_solution(A[i], b[i], pen, weight[i]), atol=1e-9)
        g = A[i] @ together[i] - b[i]
        assert np.abs(g[~pen]).max() < 1e-6
        for j in np.flatnonzero(pen):
            assert abs(g[j] + weight[i] * np.sign(together[i][j])) < 1e-3 if together[i][j] else abs(g[j]) <= weight[i] + 1e-3


def test_trend_sums_of_split_series_and_many_series_at_once(spark, monkeypatch):
    monkeypatch.setattr(forecast, "SERIES_AT_ONCE", 3)
    rng = np.random.default_rng(5)
    t = np.arange(60) / 59
    rows = [(f"s{s}", float(v), float(s + 2 * v + 0.01 * rng.normal())) for s in range(8) for v in t]
    rows += [("long", float(v), float(5 - v)) for v in np.arange(3000) / 2999]  # more than a task's share
    df = spark.createDataFrame(rows, "__series string, t double, y double").repartition(5)
    xs = [F.lit(1.0), F.col("t"), F.greatest(F.col("t") - 0.5, F.lit(0.0))]
    got = {r["__series"]: np.array(r["coef"]) for r in forecast.solve_trend(df, xs, F.col("y"), [0.0, 0.0, 1.0], 1).collect()}
    assert len(got) == 9 and np.allclose(got["long"], [5, -1, 0], atol=1e-6)
    for s in range(8):
        assert np.allclose(got[f"s{s}"][:2], [s, 2], atol=0.05)
