"""Model catalogue (§2.7): 30 entries across five tasks.

Fixed values: the catalogue defaults below are the reference's defaults,
stated as given (reference parameter names). Every estimator is seeded (seed
42, quirk Q12).
"""

from __future__ import annotations

# --- fixed values: catalogue defaults (reference parameter names) ---------
CATALOG: dict[str, dict[str, dict]] = {
    "classification": {
        "logistic_regression": {"max_iter": 1000},
        "svm": {"kernel": "rbf", "C": 1.0, "gamma": "scale"},
        "random_forest": {"n_estimators": 300, "max_depth": 12},
        "gradient_boosting": {"n_estimators": 300, "learning_rate": 0.05, "max_depth": 3},
        "xgboost": {"n_estimators": 300, "max_depth": 6, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.8},
        "lightgbm": {"n_estimators": 300, "learning_rate": 0.1, "max_depth": 6},
    },
    "regression": {
        "linear_regression": {},
        "ridge": {"alpha": 1.0},
        "lasso": {"alpha": 0.001, "max_iter": 5000},
        "random_forest": {"n_estimators": 400, "max_depth": 14},
        "xgboost": {"n_estimators": 300, "max_depth": 6, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.8},
        "lightgbm": {"n_estimators": 300, "learning_rate": 0.1, "max_depth": 6},
    },
    "timeseries": {
        "random_forest": {"n_estimators": 300, "max_depth": 10},
        "xgboost": {"n_estimators": 200, "max_depth": 5, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.8},
        "lightgbm": {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 5},
        "gradient_boosting": {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 4},
        "linear_regression": {},
        "arima": {"order": (1, 1, 1)},
        "prophet": {"seasonality_mode": "multiplicative"},
    },
    "anomaly_detection": {
        "isolation_forest": {"contamination": 0.1, "n_estimators": 200, "max_samples": 256},
        "one_class_svm": {"nu": 0.1, "kernel": "rbf", "gamma": "auto"},
        "local_outlier_factor": {"n_neighbors": 20, "novelty": True, "contamination": 0.1},
        "elliptic_envelope": {"contamination": 0.1},
        "random_forest_supervised": {"n_estimators": 200, "max_depth": 10, "class_weight": "balanced"},
        "xgboost_supervised": {"n_estimators": 200, "max_depth": 5, "scale_pos_weight": 10},
    },
    "clustering": {
        "kmeans": {"n_clusters": 3, "n_init": 10, "max_iter": 300},
        "dbscan": {"eps": 0.5, "min_samples": 5},
        "hierarchical": {"n_clusters": 3, "linkage": "ward"},
        "gaussian_mixture": {"n_components": 3, "covariance_type": "full"},
        "meanshift": {"bandwidth": None},
    },
}

DEFAULT_MODEL_COUNT = 3
SEED = 42


def task_models(task: str) -> list[str]:
    if task not in CATALOG:
        raise ValueError(f"unknown task {task!r}; expected one of {sorted(CATALOG)}")
    return list(CATALOG[task])


def merged_params(task: str, name: str, overrides: dict | None = None) -> dict:
    """Defaults <- overrides (merge_params)."""
    p = dict(CATALOG[task][name])
    p.update(overrides or {})
    return p


def validate_models(task: str, names: list[str] | None, overrides: dict | None = None) -> dict:
    """Split requested names into valid (with merged params) and invalid;
    none requested -> the first three of the catalogue (default_models)."""
    known = task_models(task)
    names = names or known[:DEFAULT_MODEL_COUNT]
    valid = {n: merged_params(task, n, (overrides or {}).get(n)) for n in names if n in known}
    invalid = [n for n in names if n not in known]
    return {"valid": valid, "invalid": invalid}


def ignored_params(name: str, params: dict) -> list[str]:
    """Parameters of a tree ensemble that no option stands for."""
    from quarry.models.tree_models import PARAMETERS

    own = {"class_weight", "scale_pos_weight", "contamination"}
    return sorted(k for k in params if k not in PARAMETERS[name] and k not in own) if name in PARAMETERS else []
