"""Metrics (§2.9) as one-pass aggregates over a predictions table.

Every function takes ``group_cols`` (split, model, segment, ...) so a single
scan scores every model/split at once. Classification metrics go through a
confusion-count table (groups x classes^2 rows) — the only data that is
aggregated further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import safe_div

PRIMARY_METRIC = {
    "classification": ("accuracy", "max"),
    "regression": ("r2", "max"),
    "timeseries": ("rmse", "min"),
    "anomaly_detection": ("roc_auc", "max"),
    "clustering": ("silhouette_score", "max"),
}


def confusion(df: DataFrame, y: str, p: str, group_cols: list[str] = ()) -> DataFrame:
    g = list(group_cols)
    return df.groupBy(*g, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, y: str, p: str, group_cols: list[str] = ()) -> DataFrame:
    """accuracy, precision/recall/f1 weighted by true support; per-class
    values are 0 where undefined (zero_division=0)."""
    g = list(group_cols)
    conf = confusion(df, y, p, g)
    true_side = conf.groupBy(*g, F.col("y").alias("c")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp")
    )
    pred_side = conf.groupBy(*g, F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    per = true_side.join(pred_side, [*g, "c"], "full")
    support = F.coalesce(F.col("support"), F.lit(0))
    tp = F.coalesce(F.col("tp"), F.lit(0))
    predicted = F.coalesce(F.col("predicted"), F.lit(0))
    prec = safe_div(tp.cast("double"), predicted.cast("double"))
    rec = safe_div(tp.cast("double"), support.cast("double"))
    per = per.select(*g, support.alias("support"), tp.alias("tp"), prec.alias("prec"), rec.alias("rec"))
    f1 = safe_div(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec"))
    tot = F.sum("support")
    return per.groupBy(*g).agg(
        safe_div(F.sum("tp").cast("double"), tot.cast("double")).alias("accuracy"),
        safe_div(F.sum(F.col("support") * F.col("prec")), tot.cast("double")).alias("precision_weighted"),
        safe_div(F.sum(F.col("support") * F.col("rec")), tot.cast("double")).alias("recall_weighted"),
        safe_div(F.sum(F.col("support") * f1), tot.cast("double")).alias("f1_weighted"),
    )


def _r2(sse: F.Column, sst: F.Column) -> F.Column:
    return F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(1 - sse / sst)


def regression_metrics(df: DataFrame, y: str, p: str, group_cols: list[str] = ()) -> DataFrame:
    """mse, rmse, r2 = 1 - SSE/SST (not ``regr_r2``)."""
    e = F.col(y).cast("double") - F.col(p).cast("double")
    agg = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(e * e).alias("_sse"), (F.var_pop(F.col(y).cast("double")) * F.count(F.lit(1))).alias("_sst"),
    )
    mse = F.col("_sse") / F.col("_n")
    return agg.select(*group_cols, mse.alias("mse"), F.sqrt(mse).alias("rmse"), _r2(F.col("_sse"), F.col("_sst")).alias("r2"))


def timeseries_metrics(df: DataFrame, y: str, p: str, group_cols: list[str] = ()) -> DataFrame:
    """mse, rmse, mae, r2 and mape = 100*mean|(y-p)/(y+1e-10)|."""
    yy = F.col(y).cast("double")
    e = yy - F.col(p).cast("double")
    agg = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(e * e).alias("_sse"), (F.var_pop(yy) * F.count(F.lit(1))).alias("_sst"),
        F.avg(F.abs(e)).alias("mae"), (F.avg(F.abs(e / (yy + F.lit(1e-10)))) * 100).alias("mape"),
    )
    mse = F.col("_sse") / F.col("_n")
    return agg.select(
        *group_cols, mse.alias("mse"), F.sqrt(mse).alias("rmse"), "mae", _r2(F.col("_sse"), F.col("_sst")).alias("r2"), "mape"
    )


def anomaly_metrics(df: DataFrame, y: str, p: str, group_cols: list[str] = ()) -> DataFrame:
    """precision/recall/f1 of class 1, AUC of the hard labels
    ((TPR+TNR)/2; 0.0 when a class is absent), and the four counts with
    fixed labels {0, 1} (quirk Q14)."""
    yy, pp = F.col(y), F.col(p)
    agg = df.groupBy(*group_cols).agg(
        F.count_if((yy == 1) & (pp == 1)).alias("true_positives"),
        F.count_if((yy != 1) & (pp == 1)).alias("false_positives"),
        F.count_if((yy != 1) & (pp != 1)).alias("true_negatives"),
        F.count_if((yy == 1) & (pp != 1)).alias("false_negatives"),
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("true_positives", "false_positives", "true_negatives", "false_negatives"))
    prec = safe_div(tp, tp + fp)
    rec = safe_div(tp, tp + fn)
    auc = F.when(((tp + fn) == 0) | ((tn + fp) == 0), F.lit(0.0)).otherwise((tp / (tp + fn) + tn / (tn + fp)) / 2)
    return agg.select(
        *group_cols, prec.alias("precision"), rec.alias("recall"), safe_div(2 * prec * rec, prec + rec).alias("f1_score"),
        auc.alias("roc_auc"), "true_positives", "false_positives", "true_negatives", "false_negatives",
    )


def anomaly_map(raw: str) -> F.Column:
    """Outlier-detector output (-1 outlier / 1 inlier) -> 1 anomaly / 0 normal."""
    return F.when(F.col(raw) == -1, F.lit(1)).otherwise(F.lit(0))


def anomaly_ratio(df: DataFrame, p: str, group_cols: list[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols).agg(
        F.avg(F.col(p).cast("double")).alias("anomaly_ratio"),
        F.count_if(F.col(p) == 1).alias("n_anomalies"),
        F.count_if(F.col(p) != 1).alias("n_normal"),
    )


def evaluate_splits(scored: DataFrame, task: str, y: str, p: str, split_col: str = "split", group_cols: list[str] = ()) -> DataFrame:
    """All requested splits of all models in one pass (``groupBy(split)``)."""
    groups = [*group_cols, split_col]
    fn = {
        "classification": classification_metrics,
        "regression": regression_metrics,
        "timeseries": timeseries_metrics,
        "anomaly_detection": anomaly_metrics,
    }[task]
    return fn(scored, y, p, groups)


def flatten_metrics(wide: DataFrame, metric_cols: list[str], split_col: str = "split", group_cols: list[str] = ()) -> DataFrame:
    """Wide per-split metrics -> long ``(name = {split}_{metric}, value)``."""
    stack = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metric_cols)
    long = wide.selectExpr(*[f"`{c}`" for c in group_cols], f"`{split_col}`", f"stack({len(metric_cols)}, {stack}) AS (metric, value)")
    return long.select(*group_cols, F.concat_ws("_", F.col(split_col), F.col("metric")).alias("name"), "value")
