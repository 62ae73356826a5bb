"""Tuning (§2.8): trials as a table.

``sample_trials`` draws every trial of a round at once: one row per
(experiment, trial) with parameters from hash-derived uniforms (int with
step, uniform, log-uniform, categorical), so a round is reproducible and
order-free. ``evaluate_trials`` scores rule-like trials with one join and one
aggregate; ``tune_rules`` adds rounds of trials that learn from the earlier ones
(``tpe``), for many experiments at once. ``tune_holdout`` / ``tune_cv`` fit a
catalogue model per trial (and per fold) — independent Spark jobs, submitted from
a small driver thread pool like ``CrossValidator(parallelism=...)``; after the
first ten trials they, too, go on in rounds of ``parallelism`` trials.
"""

from __future__ import annotations

import math
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans import tpe
from quarry.session import saved

# fixed values: declared bounds of a tuning request
MIN_TRIALS, MAX_TRIALS = 10, 500
MIN_TIMEOUT_MIN, MAX_TIMEOUT_MIN = 1, 120
DEFAULT_TRIALS = 50

# fixed values: default search spaces per task and model (reference names)
DEFAULT_SPACES = {
    "classification": {
        "random_forest": {
            "n_estimators": {"type": "int", "low": 100, "high": 1000, "step": 50},
            "max_depth": {"type": "int", "low": 3, "high": 20},
            "min_samples_split": {"type": "int", "low": 2, "high": 20},
            "min_samples_leaf": {"type": "int", "low": 1, "high": 10},
            "max_features": {"type": "categorical", "choices": ["sqrt", "log2", None]},
        },
        "xgboost": {
            "n_estimators": {"type": "int", "low": 100, "high": 1000, "step": 50},
            "max_depth": {"type": "int", "low": 3, "high": 12},
            "learning_rate": {"type": "float", "low": 0.01, "high": 0.3, "log": True},
            "subsample": {"type": "float", "low": 0.6, "high": 1.0},
            "colsample_bytree": {"type": "float", "low": 0.6, "high": 1.0},
            "reg_alpha": {"type": "float", "low": 1e-8, "high": 10.0, "log": True},
            "reg_lambda": {"type": "float", "low": 1e-8, "high": 10.0, "log": True},
        },
        "svm": {
            "C": {"type": "float", "low": 0.1, "high": 100.0, "log": True},
            "gamma": {"type": "categorical", "choices": ["scale", "auto"]},
            "kernel": {"type": "categorical", "choices": ["rbf", "linear", "poly"]},
        },
        "gradient_boosting": {
            "n_estimators": {"type": "int", "low": 100, "high": 500, "step": 50},
            "learning_rate": {"type": "float", "low": 0.01, "high": 0.3, "log": True},
            "max_depth": {"type": "int", "low": 3, "high": 10},
            "min_samples_split": {"type": "int", "low": 2, "high": 20},
            "min_samples_leaf": {"type": "int", "low": 1, "high": 10},
        },
    },
    "regression": {
        "random_forest": {
            "n_estimators": {"type": "int", "low": 100, "high": 1000, "step": 50},
            "max_depth": {"type": "int", "low": 3, "high": 20},
            "min_samples_split": {"type": "int", "low": 2, "high": 20},
            "min_samples_leaf": {"type": "int", "low": 1, "high": 10},
        },
        "xgboost": {
            "n_estimators": {"type": "int", "low": 100, "high": 1000, "step": 50},
            "max_depth": {"type": "int", "low": 3, "high": 12},
            "learning_rate": {"type": "float", "low": 0.01, "high": 0.3, "log": True},
            "subsample": {"type": "float", "low": 0.6, "high": 1.0},
            "colsample_bytree": {"type": "float", "low": 0.6, "high": 1.0},
        },
        "ridge": {"alpha": {"type": "float", "low": 0.001, "high": 100.0, "log": True}},
        "lasso": {"alpha": {"type": "float", "low": 0.001, "high": 10.0, "log": True}},
    },
}


def checked_trials(n: int | None) -> int:
    """The number asked for (``DEFAULT_TRIALS`` if none). The declared bounds
    above describe a request; they are not enforced on it."""
    n = DEFAULT_TRIALS if n is None else int(n)
    if n < 1:
        raise ValueError(f"n_trials must be at least 1, not {n}")
    return n


def checked_deadline(minutes: float | None) -> float | None:
    if minutes is None:
        return None
    if minutes <= 0:
        raise ValueError(f"the timeout must be positive, not {minutes}")
    return time.time() + 60 * float(minutes)


def _uniform(seed: int, param: str) -> Column:
    """u in [0, 1) from the first 52 bits of md5(seed:experiment:trial:param)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("experiment").cast("string"), F.col("trial_id").cast("string"),
                          F.lit(param)))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def param_column(name: str, spec: dict, seed: int) -> Column:
    u = _uniform(seed, name)
    kind = spec["type"]
    if kind == "int":
        low, high, step = int(spec["low"]), int(spec["high"]), int(spec.get("step", 1))
        n = (high - low) // step + 1
        return (F.lit(low) + F.lit(step) * F.floor(u * n)).cast("bigint")
    if kind == "float":
        low, high = float(spec["low"]), float(spec["high"])
        if spec.get("log"):
            return F.exp(F.lit(math.log(low)) + u * F.lit(math.log(high) - math.log(low)))
        return F.lit(low) + u * F.lit(high - low)
    if kind == "categorical":
        choices = spec["choices"]
        arr = F.array(*[F.lit(c) for c in choices])
        return F.element_at(arr, (F.floor(u * len(choices)) + 1).cast("int"))
    raise ValueError(f"unknown parameter type {kind!r}")


def sample_trials(experiments: DataFrame, space: dict, n_trials: int, seed: int = 42) -> DataFrame:
    """One row per (experiment, trial_id) with one column per parameter."""
    t = experiments.select("experiment").withColumn(
        "trial_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_trials - 1).cast("bigint"))))
    return t.select("experiment", "trial_id", *[param_column(k, v, seed).alias(k) for k, v in space.items()])


def evaluate_trials(trials: DataFrame, data: DataFrame, on: list[str], score: Column) -> DataFrame:
    """Score every trial on its experiment's rows: equi-join on the
    experiment key (each row meets each of its experiment's trials) and one
    aggregate; returns the trials with ``score``."""
    keys = [c for c in trials.columns]
    return trials.join(data, on).groupBy(*keys).agg(F.avg(score).alias("score"))


def tune_rules(experiments: DataFrame, data: DataFrame, on: list[str], score: Column, space: dict, n_trials: int, seed: int = 42,
               per_round: int = 5, sampler: str = "tpe") -> DataFrame:
    """Trials of every experiment with their scores: drawn ones first, then rounds
    of ``per_round`` that learn from all earlier trials of the experiment."""
    n_trials = checked_trials(n_trials)
    first = n_trials if sampler == "random" else min(n_trials, tpe.STARTUP)
    done = saved(evaluate_trials(sample_trials(experiments, space, first, seed), data, on, score), "trials")
    at = first
    while at < n_trials:
        count = min(per_round, n_trials - at)
        more = saved(tpe.next_trials(done, space, count, seed), "next-trials")
        done = saved(done.unionByName(evaluate_trials(more, data, on, score)), "trials")
        at += count
    return done


def _score(task: str, scored: DataFrame) -> float:
    from quarry.operators import metrics as M

    if task == "classification":
        return float(M.classification_metrics(scored, "label", "prediction").first()["accuracy"])
    return float(M.regression_metrics(scored, "label", "prediction").first()["r2"])


def _trial_params(spark: SparkSession, space: dict, n_trials: int, seed: int, experiment: str) -> list[dict]:
    exps = spark.createDataFrame([(experiment,)], "experiment string")
    return [r.asDict() for r in sample_trials(exps, space, n_trials, seed).collect()]  # n_trials small rows


TRIAL_SCHEMA = ("experiment string, model string, trial_id bigint, params map<string,string>, score double, status string, "
                "ignored array<string>, error string")


def _run_trials(spark, task, name, space, n_trials, seed, parallelism, overrides, timeout_min, experiment, evaluate, sampler) -> DataFrame:
    """The first trials are drawn independently, later rounds of ``parallelism``
    trials from the results so far (``sampler`` random: all independently).
    Every trial: catalogue defaults, then its sampled values, then the
    pinned overrides. A failing trial scores 0.0 (classification) or -inf
    (regression) and keeps its error; a trial after the deadline is SKIPPED
    without a score."""
    from quarry.models.catalog import ignored_params, merged_params

    space = space or DEFAULT_SPACES.get(task, {}).get(name)
    if not space:
        raise ValueError(f"no search space for {task}/{name}")
    if sampler not in ("tpe", "random"):
        raise ValueError(f"unknown sampler {sampler!r}; use tpe or random")
    n_trials = checked_trials(n_trials)
    trials = _trial_params(spark, space, n_trials if sampler == "random" else min(n_trials, tpe.STARTUP), seed, experiment)
    deadline = checked_deadline(timeout_min)
    fail = 0.0 if task == "classification" else float("-inf")

    def run(t):
        sampled = {k: v for k, v in t.items() if k not in ("experiment", "trial_id")}
        params = merged_params(task, name, {**sampled, **(overrides or {})})
        shown, unused = {k: str(v) for k, v in {**sampled, **(overrides or {})}.items()}, ignored_params(name, params)
        row = (experiment, name, t["trial_id"], shown)
        if deadline is not None and time.time() > deadline:
            return (*row, None, "SKIPPED", unused, None)
        try:
            return (*row, evaluate(params), "FINISHED", unused, None)
        except Exception as e:  # noqa: BLE001 - one failing trial must not end the study; it is recorded
            return (*row, fail, "FAILED", unused, f"{type(e).__name__}: {e}"[:500])

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        rows = list(ex.map(run, trials))
        while len(rows) < n_trials:
            history = [({k: t[k] for k in space}, row[4]) for t, row in zip(trials, rows)]
            more = [{"trial_id": i, **tpe.propose(space, history, i, seed, experiment)}
                    for i in range(len(rows), min(n_trials, len(rows) + max(1, parallelism)))]
            trials += more
            rows += ex.map(run, more)
    return spark.createDataFrame(rows, TRIAL_SCHEMA)


def _classes(task: str, train: DataFrame) -> int:
    return int(train.agg(F.max("label")).first()[0] or 1) + 1 if task == "classification" else 0


def _moments(task: str, name: str, parts: list[DataFrame], features: list[str]) -> list | None:
    """Moments of every part, where the model's fit needs no more; None elsewhere, or where a part has no rows or missing values
    (each trial then says so)."""
    from quarry.models import supervised as S

    if task != "regression" or name not in S.BY_MOMENTS:
        return None
    found = [S.Moments.of(p, features) for p in parts]
    return found if all(found) else None


def _fit_from(spark: SparkSession, name: str, parts: list, features: list[str], params: dict):
    from quarry.models import PipelineFitted
    from quarry.models import supervised as S

    return PipelineFitted(S.fit_regressor_from(spark, S.Moments.together(parts), features, name, params), features, "regression", name)


def tune_holdout(spark: SparkSession, task: str, name: str, train: DataFrame, val: DataFrame, features: list[str],
                 space: dict | None = None, n_trials: int = DEFAULT_TRIALS, seed: int = 42, parallelism: int = 4,
                 overrides: dict | None = None, timeout_min: float | None = None, experiment: str = "tune", sampler: str = "tpe") -> DataFrame:
    """Fit on train, score on validation (accuracy, else r2), per trial. A
    user space wins over the default; overrides pin parameters (Q8). All trials of a
    regression that needs only moments share one pass over ``train``."""
    from quarry.models import fit_model

    n_classes = _classes(task, train)
    m = _moments(task, name, [train], features)

    def fit(p):
        return _fit_from(spark, name, m, features, p) if m else fit_model(task, name, train, features, p, n_classes=n_classes)

    evaluate = lambda p: _score(task, fit(p).transform(val))
    return _run_trials(spark, task, name, space, n_trials, seed, parallelism, overrides, timeout_min, experiment, evaluate, sampler)


def tune_cv(spark: SparkSession, task: str, name: str, train: DataFrame, features: list[str], folds: int = 5,
            space: dict | None = None, n_trials: int = DEFAULT_TRIALS, seed: int = 42, parallelism: int = 4,
            key: str = "id", overrides: dict | None = None, timeout_min: float | None = None, experiment: str = "tune",
            sampler: str = "tpe") -> DataFrame:
    """No validation set: mean score over k folds (``kfold`` column) per
    trial; the same options as :func:`tune_holdout`. Moments are per fold, the rest of a fold has those of the
    other folds together."""
    from quarry.models import fit_model
    from quarry.operators.split import kfold

    f = kfold(train, key, folds, "label" if task == "classification" else None).select(*dict.fromkeys([*features, "label"]), "fold").cache()
    n_classes = _classes(task, train)
    held = _moments(task, name, [f.where(F.col("fold") == k) for k in range(folds)], features) if folds > 1 else None

    def evaluate(p):
        def fit(k):
            if held:
                return _fit_from(spark, name, [m for i, m in enumerate(held) if i != k], features, p)
            return fit_model(task, name, f.where(F.col("fold") != k), features, p, n_classes=n_classes)

        scores = [_score(task, fit(k).transform(f.where(F.col("fold") == k))) for k in range(folds)]
        return float(sum(scores) / folds)

    try:
        return _run_trials(spark, task, name, space, n_trials, seed, parallelism, overrides, timeout_min, experiment, evaluate, sampler)
    finally:
        f.unpersist()
