"""Trials that learn: better than independent draws, reproducible, in bounds."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.plans import tpe
from quarry.plans.train import TrainConfig, train_many
from quarry.plans.tune import sample_trials, tune_holdout, tune_rules

SPACE = {
    "x": {"type": "float", "low": -5.0, "high": 5.0},
    "rate": {"type": "float", "low": 1e-5, "high": 1.0, "log": True},
    "n": {"type": "int", "low": 10, "high": 100, "step": 5},
    "kind": {"type": "categorical", "choices": ["a", "b", "c", None]},
}


def goal(p):
    return -(p["x"] - 1.7) ** 2 - (math.log10(p["rate"]) + 3) ** 2 - ((p["n"] - 40) / 20) ** 2 - (0 if p["kind"] == "b" else 2)


def study(seed, learn, n=60):
    rng = np.random.default_rng(seed)
    history = []
    for t in range(n):
        if learn and t >= tpe.STARTUP:
            p = tpe.propose(SPACE, history, t, seed)
        else:
            p = {"x": rng.uniform(-5, 5), "rate": 10 ** rng.uniform(-5, 0), "n": 10 + 5 * int(rng.integers(0, 19)), "kind": ["a", "b", "c", None][rng.integers(0, 4)]}
        history.append((p, goal(p)))
    return history


def test_learns_more_than_independent_draws():
    """60 trials, 20 studies: the best score of learning studies is better in the
    mean, and in at least three studies of four."""
    a = [max(s for _, s in study(seed, True)) for seed in range(20)]
    b = [max(s for _, s in study(seed, False)) for seed in range(20)]
    assert np.mean(a) > np.mean(b) and sum(x > y for x, y in zip(a, b)) >= 15


def test_values_are_in_the_space_and_repeat():
    h = study(3, True)
    assert h == study(3, True)
    for p, _ in h:
        assert -5 <= p["x"] <= 5 and 1e-5 <= p["rate"] <= 1 and p["n"] in range(10, 101, 5) and p["kind"] in SPACE["kind"]["choices"]
    assert tpe.propose(SPACE, h, 60, 1) != tpe.propose(SPACE, h, 61, 1)
    # failed and missing scores
    odd = h[:12] + [(h[0][0], float("nan")), (h[1][0], float("-inf")), (h[2][0], None)]
    best, rest = tpe.split_history(odd)
    assert len(best) == 2 and len(rest) == 11
    assert set(tpe.propose(SPACE, [], 0, 1)) == set(SPACE)


def test_rounds_over_many_experiments(spark):
    rows = [(f"e{i % 3}", float(v), float(v > 20 * (i % 3 + 1))) for i in range(3) for v in np.linspace(0, 100, 200)]
    data = spark.createDataFrame(rows, "experiment string, v double, y double")
    space = {"cut": {"type": "float", "low": 0.0, "high": 1000.0}}
    right = ((F.col("v") > F.col("cut")).cast("double") == F.col("y")).cast("double")
    exps = data.select("experiment").distinct()
    t = tune_rules(exps, data, ["experiment"], right, space, 32)
    assert t.groupBy("experiment").agg(F.count("*").alias("n"), F.countDistinct("trial_id").alias("d")).filter("n = 32 and d = 32").count() == 3
    learned = {r["experiment"]: r["m"] for r in t.groupBy("experiment").agg(F.max("score").alias("m")).collect()}
    drawn = tune_rules(exps, data, ["experiment"], right, space, 32, sampler="random")
    drawn = {r["experiment"]: r["m"] for r in drawn.groupBy("experiment").agg(F.max("score").alias("m")).collect()}
    assert sum(learned.values()) >= sum(drawn.values())
    assert sorted(map(tuple, tune_rules(exps, data, ["experiment"], right, space, 32).collect())) == sorted(map(tuple, t.collect()))


def test_holdout_goes_on_in_rounds(spark):
    df = spark.range(200).withColumn("x", (F.col("id") % 23).cast("double")).withColumn("label", F.col("x") * 2 + F.rand(1))
    space = {"alpha": {"type": "float", "low": 0.001, "high": 1e6, "log": True}}
    t = tune_holdout(spark, "regression", "ridge", df, df, ["x"], space, n_trials=14, seed=5).orderBy("trial_id").collect()
    assert [r["trial_id"] for r in t] == list(range(14)) and all(r["status"] == "FINISHED" for r in t)
    first = sample_trials(spark.createDataFrame([("tune",)], "experiment string"), space, 10, 5).orderBy("trial_id").collect()
    assert [float(r["params"]["alpha"]) for r in t[:10]] == [r["alpha"] for r in first]
    with pytest.raises(ValueError):
        tune_holdout(spark, "regression", "ridge", df, df, ["x"], space, n_trials=1, sampler="grid")


@pytest.mark.parametrize("values", [(-1, 1), (1, 2), (2.5, 7.0, 9.5)])
def test_any_numbers_are_class_labels(spark, values):
    rows = [(i, float(i % len(values)) + 0.1 * (i % 5), values[i % len(values)]) for i in range(150)]
    df = spark.createDataFrame(rows, f"id long, x double, y {'int' if isinstance(values[0], int) else 'double'}")
    cfg = TrainConfig(task="classification", target="y", key="id", features=["x"], models=["logistic_regression", "gradient_boosting", "random_forest"],
                      overrides={"gradient_boosting": {"n_estimators": 5}, "random_forest": {"n_estimators": 5}})
    res = train_many(spark, df, cfg)
    assert res.runs.where("status = 'FINISHED' and score = 1.0").count() == 3
    m = res.models["gradient_boosting"]
    out = m.decode(m.transform(df))
    shown = {str(v) for v in values}
    assert {r["prediction_label"] for r in out.collect()} == shown
    assert out.filter(F.col("prediction_label").cast("double") != F.col("y")).count() == 0
    res.release()
