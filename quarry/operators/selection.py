"""Model selection over run tables (§2.8): leaderboards, best run, best
trial, cross-validation summaries. Run tables can hold many thousands of
rows (one pipeline per segment); all of this is window / aggregate work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.metrics import PRIMARY_METRIC


def _direction_order(score: str, direction: str):
    c = F.col(score)
    return c.asc_nulls_last() if direction == "min" else c.desc_nulls_last()


def leaderboard(runs: DataFrame, score: str, direction: str = "max", partition: list[str] = ("experiment",),
                tiebreak: str = "model_order") -> DataFrame:
    """Rank runs per experiment by score; metric direction comes from the
    task (rmse minimises — quirk Q1); null scores rank last; ties go to the
    first model in the requested list (``tiebreak`` ascending)."""
    order = [_direction_order(score, direction)]
    if tiebreak in runs.columns:
        order.append(F.col(tiebreak).asc())
    w = Window.partitionBy(*partition).orderBy(*order)
    return runs.withColumn("rank", F.row_number().over(w))


def best_run(runs: DataFrame, score: str, direction: str = "max", partition: list[str] = ("experiment",),
             tiebreak: str = "model_order") -> DataFrame:
    return leaderboard(runs, score, direction, partition, tiebreak).where(F.col("rank") == 1).drop("rank")


def task_direction(task: str) -> tuple[str, str]:
    return PRIMARY_METRIC[task]


def best_trial(trials: DataFrame, score: str = "score", partition: list[str] = ("model",)) -> DataFrame:
    """Maximum score per model with its parameters and the trial count;
    ties -> lowest trial id."""
    best = F.max_by(F.struct("trial_id", "params"), F.struct(F.col(score), -F.col("trial_id")))
    return trials.groupBy(*partition).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.max(score).alias("best_score"),
        best["trial_id"].alias("best_trial_id"),
        best["params"].alias("best_params"),
    )


def cross_validate(fold_scores: DataFrame, score: str = "score", partition: list[str] = ("model",)) -> DataFrame:
    """Mean and population std (ddof=0) of the fold scores."""
    return fold_scores.groupBy(*partition).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg(score).alias("cv_mean"),
        F.stddev_pop(score).alias("cv_std"),
    )


def tuning_summary(runs: DataFrame, partition: list[str] = ("experiment",)) -> DataFrame:
    return runs.groupBy(*partition).agg(
        F.count(F.lit(1)).alias("models_trained"),
        F.count_if(F.col("hpo_used")).alias("models_optimized"),
    )
