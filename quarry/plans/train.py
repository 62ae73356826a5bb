"""``train_many`` (§2.8 / §3.1): one job per training request.

prepare (select, label dictionary) -> split (exact hash / time split) ->
persist the split table -> for each requested model: fit on train, score
val+test in one pass, metrics for every split in one ``groupBy(split)`` ->
run rows -> leaderboard with the task's metric direction -> best model.

Failing models are recorded as FAILED runs and skipped; if every model fails
the job raises. Data rows never reach the driver: only metric rows, counts
and model parameters do.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.models import fit_model
from quarry.functions.columns import categorical_columns
from quarry.models.catalog import ignored_params, validate_models
from quarry.models.served import ServedModel
from quarry.operators import metrics as M
from quarry.operators.encode import apply_dictionary, build_dictionary
from quarry.operators.registry import run_row, runs_frame
from quarry.operators.select import (
    parse_time, select_features, select_features_anomaly, select_features_clustering, select_features_ts,
)
from quarry.operators.selection import leaderboard
from quarry.operators.sequence import lag_features, lag_names
from quarry.operators.split import split_anomaly, split_clustering, split_random, split_stratified, split_time
from quarry.session import saved


@dataclass
class TrainConfig:
    task: str
    target: str | None
    key: str
    features: list[str] | None = None
    models: list[str] | None = None
    overrides: dict = field(default_factory=dict)
    test_size: float = 0.2
    val_size: float = 0.1
    seed: int = 42
    use_cv: bool = False
    cv_folds: int = 5
    experiment: str = "default"
    time_col: str | None = None
    lookback: int = 10
    horizon: int = 1
    series_key: str | None = None
    contamination: float = 0.1
    n_clusters: int = 3
    # tuning: {"enabled": bool, "n_trials": int, "timeout_min": float, "param_space": {model: space}}
    hpo: dict = field(default_factory=dict)


@dataclass
class TrainResult:
    runs: DataFrame
    leaderboard: DataFrame
    models: dict
    label_dictionary: DataFrame | None
    features: list[str]
    prepared: DataFrame
    feature_dictionary: DataFrame | None = None
    trials: DataFrame | None = None

    def release(self) -> None:
        """Give back the split table that training keeps."""
        self.prepared.unpersist()


@dataclass
class Prepared:
    """Split table with ``label`` and ``split``, feature names and dictionaries."""

    data: DataFrame
    features: list[str]
    labels: DataFrame | None = None
    dictionary: DataFrame | None = None
    categories: dict = field(default_factory=dict)


#: of a numeric class label
MOST_CLASSES = 1000


def _label(df: DataFrame, target: str, classes: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """String targets, and numeric ones of a classifier that are not 0, 1, ... -> sorted
    codes (single dictionary, quirk Q5)."""
    if dict(df.dtypes)[target] == "string":
        d = build_dictionary(df, [target])
        out = apply_dictionary(df, d, [target], suffix="__code")
        return out.withColumn("label", F.col(f"{target}__code").cast("double")).drop(f"{target}__code"), d
    if classes:  # any numbers: codes in the order of the values; as many rows as classes
        values = df.filter(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("v")).distinct()
        seen = sorted(r["v"] for r in values.limit(MOST_CLASSES + 1).collect())
        if len(seen) > MOST_CLASSES:
            raise ValueError(f"{target!r} has more than {MOST_CLASSES} values; it is no class label")
        if seen != [float(i) for i in range(len(seen))]:
            whole = dict(df.dtypes)[target] not in ("double", "float")
            shown = [str(int(v)) if whole and v.is_integer() else str(v) for v in seen]
            spark = df.sparkSession
            d = spark.createDataFrame([(target, s, i) for i, s in enumerate(shown)], "column string, value string, code int")
            code = F.array_position(F.array(*[F.lit(v) for v in seen]), F.col(target).cast("double")) - 1
            code = F.when(code >= 0, code).cast("double")
            return df.withColumn("label", code), d
    return df.withColumn("label", F.col(target).cast("double")), None


def _encode(df: DataFrame, feats: list[str]) -> tuple[DataFrame, DataFrame | None, dict[str, int]]:
    """String features -> sorted codes (nulls stay null); returns the frame,
    the dictionary and the number of values of each encoded feature."""
    cats = categorical_columns(df.select(*feats))
    if not cats:
        return df, None, {}
    d = saved(build_dictionary(df, cats), "dictionary")
    sizes = {r["column"]: r["n"] for r in d.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return apply_dictionary(df, d, cats).select(*df.columns), d, {c: int(sizes.get(c, 0)) for c in cats}


def prepare_all(df: DataFrame, cfg: TrainConfig) -> Prepared:
    """Select, encode, label and split for the task."""
    t = cfg.task
    kw = dict(test=cfg.test_size, val=cfg.val_size, seed=cfg.seed)
    if t in ("classification", "regression"):
        feats = select_features(df, cfg.target, cfg.features)
        rows = df.select(cfg.key, *[c for c in feats if c != cfg.key], cfg.target)
        x, d, cats = _encode(rows, [c for c in feats if c != cfg.target])
        data, labels = _label(x, cfg.target, t == "classification")
        if t == "classification":
            return Prepared(split_stratified(data, cfg.key, "label", **kw), feats, labels, d, cats)
        return Prepared(split_random(data, cfg.key, **kw), feats, None, d, cats)
    if t == "timeseries":
        base = select_features_ts(df, cfg.target, cfg.time_col, cfg.features)
        base = [c for c in base if c not in (cfg.key, cfg.series_key)]
        if dict(df.dtypes)[cfg.time_col] == "string":
            df = parse_time(df, cfg.time_col).drop(cfg.time_col).withColumnRenamed(f"{cfg.time_col}_ts", cfg.time_col)
        x, d, cats = _encode(df, base)
        samples = lag_features(x, base, cfg.target, cfg.time_col, cfg.key, cfg.series_key, cfg.lookback, cfg.horizon)
        kind = "double" if cfg.horizon == 1 else "array<double>"
        samples = samples.withColumn("label", F.col("y").cast(kind))
        split = split_time(samples, "position", cfg.key, cfg.test_size, cfg.val_size, series=cfg.series_key)
        return Prepared(split, lag_names(base, cfg.lookback), None, d, cats)
    if t == "anomaly_detection":
        feats = select_features_anomaly(df, cfg.target, cfg.features)
        feats = [c for c in feats if c != cfg.key]
        labelled = bool(cfg.target) and cfg.target in df.columns
        data, d, cats = _encode(df.select(cfg.key, *feats, *([cfg.target] if labelled else [])), feats)
        if labelled:
            data = data.withColumn("label", F.col(cfg.target).cast("double"))
        return Prepared(split_anomaly(data, cfg.key, "label" if labelled else None, **kw), feats, None, d, cats)
    if t == "clustering":
        feats = [c for c in select_features_clustering(df, cfg.features) if c != cfg.key]
        data, d, cats = _encode(df.select(cfg.key, *feats), feats)
        return Prepared(split_clustering(data, cfg.key, **kw), feats, None, d, cats)
    raise ValueError(f"unknown task {t!r}")


def prepare(df: DataFrame, cfg: TrainConfig) -> tuple[DataFrame, list[str], DataFrame | None]:
    """(split table, features, label dictionary) of :func:`prepare_all`."""
    p = prepare_all(df, cfg)
    return p.data, p.features, p.labels


def _metrics(scored: DataFrame, cfg: TrainConfig, labelled: bool, fitted) -> dict[str, dict[str, float]]:
    t = cfg.task
    if t == "classification":
        rows = M.evaluate_splits(scored, "classification", "label", "prediction").collect()
    elif t == "regression":
        rows = M.evaluate_splits(scored, "regression", "label", "prediction").collect()
    elif t == "timeseries":
        if cfg.horizon > 1:  # every step of every row counts
            step = F.explode(F.arrays_zip(F.col("label").alias("label"), F.col("prediction").alias("prediction"))).alias("s")
            scored = scored.select("split", step).select("split", "s.label", "s.prediction")
        rows = M.evaluate_splits(scored, "timeseries", "label", "prediction").collect()
    elif t == "anomaly_detection":
        if labelled:
            rows = M.evaluate_splits(scored, "anomaly_detection", "label", "prediction").collect()
        else:
            rows = M.anomaly_ratio(scored, "prediction", ["split"]).collect()
    else:
        from quarry.models.clustering import silhouette_score

        feats = getattr(fitted, "feature_cols", None)
        rows = silhouette_score(scored, feats, "prediction", ["split"]).collect()
    return {r["split"]: {k: v for k, v in r.asDict().items() if k != "split"} for r in rows}


def train_many(spark: SparkSession, df: DataFrame, cfg: TrainConfig, persist: bool = True) -> TrainResult:
    v = validate_models(cfg.task, cfg.models, cfg.overrides)
    if not v["valid"]:
        raise ValueError(f"no valid model for task {cfg.task!r}: {v['invalid']}")
    prep = prepare_all(df, cfg)
    prepared, feats, d = prep.data, prep.features, prep.labels
    if persist:
        prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    train = prepared.where(F.col("split") == "train")
    held = prepared.where(F.col("split") != "train")
    labelled = "label" in prepared.columns
    n_classes = 0
    if cfg.task == "classification":
        n_classes = int(prepared.agg(F.max("label")).first()[0] or 0) + 1
    metric, direction = M.PRIMARY_METRIC[cfg.task]
    rows, models = [], {}
    trials_tables = []
    for order, (name, params) in enumerate(v["valid"].items()):
        start = time.time()
        hpo_used = False
        try:
            tuned = _tune(spark, cfg, name, train, prepared, feats)
            if tuned is not None:
                best, table_ = tuned
                trials_tables.append(table_)
                # tuned values replace the defaults; user overrides stay pinned (Q8)
                params = {**params, **best, **(cfg.overrides or {}).get(name, {})}
                hpo_used = True
            unused = ignored_params(name, params)
            fitted = fit_model(cfg.task, name, train, feats, params, n_classes=n_classes, labelled=labelled,
                               key=cfg.key, series_key=cfg.series_key, time_col=cfg.time_col, horizon=cfg.horizon,
                               contamination=cfg.contamination, n_clusters=cfg.n_clusters)
            scored = fitted.transform(held if cfg.task not in ("clustering",) else prepared)
            per_split = _metrics(scored, cfg, labelled, fitted)
            score = per_split.get("test", {}).get(metric)
            flat = {f"{s}_{k}": val for s, m in per_split.items() for k, val in m.items() if isinstance(val, (int, float))}
            if cfg.use_cv and cfg.task in ("classification", "regression"):
                flat.update(_cross_validate(spark, cfg, name, params, train, feats, n_classes))
            params = {**params, **({"ignored": unused} if unused else {})}
            rows.append(run_row(cfg.experiment, name, order, cfg.task, type(fitted).__name__, params, flat, score,
                                hpo_used, start))
            models[name] = ServedModel(fitted, feats, cfg.task, name, prep.dictionary, d, prep.categories)
        except Exception as exc:  # a failing model is skipped, as in the reference
            rows.append(run_row(cfg.experiment, name, order, cfg.task, "", params, {}, None, False, start,
                                status="FAILED", error=f"{type(exc).__name__}: {exc}"[:2000]))
    if not models:
        raise RuntimeError(f"all models failed: {[(r[2], r[12]) for r in rows]}")
    runs = runs_frame(spark, rows)
    board = leaderboard(runs.where(F.col("status") == "FINISHED"), "score", direction)
    res = TrainResult(runs, board, models, d, feats, prepared, prep.dictionary)
    for t in trials_tables:
        res.trials = t if res.trials is None else res.trials.unionByName(t)
    return res


def _tune(spark: SparkSession, cfg: TrainConfig, name: str, train: DataFrame, prepared: DataFrame, feats: list[str]):
    """Tuning gate: enabled, a search space (the user's, else the default
    one), and a supervised task. Holdout on the validation split when there
    is one, else k-fold on train. Returns (best params, trials table)."""
    from quarry.plans.tune import DEFAULT_SPACES, tune_cv, tune_holdout

    h = cfg.hpo or {}
    if not h.get("enabled") or cfg.task not in ("classification", "regression"):
        return None
    space = (h.get("param_space") or {}).get(name) or DEFAULT_SPACES.get(cfg.task, {}).get(name)
    if not space:
        return None
    n_trials = int(h.get("n_trials", 50))
    if cfg.val_size > 0:
        val = prepared.where(F.col("split") == "val")
        t = tune_holdout(spark, cfg.task, name, train, val, feats, space, n_trials, cfg.seed,
                         overrides=(cfg.overrides or {}).get(name), timeout_min=h.get("timeout_min"),
                         experiment=cfg.experiment)
    else:
        t = tune_cv(spark, cfg.task, name, train, feats, cfg.cv_folds, space, n_trials, cfg.seed, key=cfg.key,
                    overrides=(cfg.overrides or {}).get(name), timeout_min=h.get("timeout_min"), experiment=cfg.experiment)
    # NaN would sort first
    best = t.where((F.col("status") == "FINISHED") & ~F.isnan("score")).orderBy(F.col("score").desc(), "trial_id").first()
    if best is None:
        return None
    return {k: _typed(v) for k, v in best["params"].items()}, t


def _typed(v: str):
    for conv in (int, float):
        try:
            return conv(v)
        except (TypeError, ValueError):
            pass
    return None if v == "None" else v


def _cross_validate(spark: SparkSession, cfg: TrainConfig, name: str, params: dict, train: DataFrame,
                    feats: list[str], n_classes: int) -> dict:
    """k-fold scores on train (accuracy or r2): mean and population std."""
    from quarry.operators.split import kfold
    from quarry.plans.tune import _score

    f = kfold(train, cfg.key, cfg.cv_folds, "label" if cfg.task == "classification" else None).cache()
    scores = []
    try:
        for k in range(cfg.cv_folds):
            m = fit_model(cfg.task, name, f.where(F.col("fold") != k), feats, params, n_classes=n_classes)
            scores.append(_score(cfg.task, m.transform(f.where(F.col("fold") == k))))
    finally:
        f.unpersist()
    mean = sum(scores) / len(scores)
    std = (sum((x - mean) ** 2 for x in scores) / len(scores)) ** 0.5
    return {"cv_mean": mean, "cv_std": std}
