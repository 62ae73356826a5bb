"""Registered queries for §2.7 (closed-form model steps), §2.8 (selection,
tuning tables), §2.9 (metrics), §2.10 (registry) and §2.11 (chunked scoring,
dead letters), with DuckDB oracles.

Predictions for metric queries come from fixed rules over whole tables
(stand-ins for model output); the metric operators are the library's."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quarry.functions.columns import round6
from quarry.models import anomaly as A
from quarry.models import clustering as C
from quarry.models.supervised import FEATURES, LABEL
from quarry.operators import metrics as M
from quarry.operators import registry as G
from quarry.operators import selection as L
from quarry.operators import split as SP
from quarry.operators.sequence import lag_features
from quarry.plans import tune as TU
from quarry.plans.registry import query
from quarry.session import table
from quarry.sources import readers as R
from quarry.streaming import scoring as SC

# --- stand-in prediction rules (same text runs in Spark SQL and DuckDB) ----
RULE_PRICE = ("CASE WHEN o_totalprice < 100000 THEN '1-URGENT' WHEN o_totalprice < 200000 THEN '2-HIGH' "
              "WHEN o_totalprice < 300000 THEN '3-MEDIUM' WHEN o_totalprice < 400000 THEN '4-NOT SPECIFIED' "
              "ELSE '5-LOW' END")
RULE_MONTH = ("CASE WHEN month(o_orderdate) <= 2 THEN '1-URGENT' WHEN month(o_orderdate) <= 4 THEN '2-HIGH' "
              "WHEN month(o_orderdate) <= 6 THEN '3-MEDIUM' WHEN month(o_orderdate) <= 8 THEN '4-NOT SPECIFIED' "
              "ELSE '5-LOW' END")
RULE_CONST = "'1-URGENT'"
RULES = [("price_band", RULE_PRICE), ("month_band", RULE_MONTH), ("constant", RULE_CONST)]


def order_preds(spark, d, rule=RULE_PRICE):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.expr(rule).alias("pred"))


def _clf_sql(src: str, g: str, out: str) -> str:
    """Weighted classification metrics over ``src`` (columns g, y, p)."""
    return f"""
WITH src AS ({src}),
conf AS (SELECT g, y, p, count(*) AS n FROM src GROUP BY g, y, p),
t AS (SELECT g, y AS c, sum(n) AS support, sum(CASE WHEN y = p THEN n ELSE 0 END) AS tp FROM conf GROUP BY g, y),
pp AS (SELECT g, p AS c, sum(n) AS predicted FROM conf GROUP BY g, p),
per AS (SELECT coalesce(t.g, pp.g) AS g, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
               CASE WHEN coalesce(predicted, 0) = 0 THEN 0.0 ELSE coalesce(tp, 0) / predicted END AS prec,
               CASE WHEN coalesce(support, 0) = 0 THEN 0.0 ELSE coalesce(tp, 0) / support END AS rec
        FROM t FULL OUTER JOIN pp ON t.g = pp.g AND t.c = pp.c),
m AS (SELECT g, sum(tp) / sum(support) AS accuracy, sum(support * prec) / sum(support) AS precision_weighted,
             sum(support * rec) / sum(support) AS recall_weighted,
             sum(support * CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END) / sum(support) AS f1_weighted
      FROM per GROUP BY g)
SELECT {out} FROM m"""


ORDERS_SRC = f"SELECT o_orderstatus AS g, o_orderpriority AS y, {RULE_PRICE} AS p FROM orders"


def _clf_query(metric):
    def fn(spark, d):
        m = M.classification_metrics(order_preds(spark, d), "o_orderpriority", "pred", ["o_orderstatus"])
        return m.select("o_orderstatus", round6(metric).alias(metric))
    return fn


for _m in ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted"):
    query(_m, _clf_sql(ORDERS_SRC, "g", f"g AS o_orderstatus, round({_m}, 6) AS {_m}"),
          headline=_m == "f1_weighted")(_clf_query(_m))


# ----------------------------------------------------------------- regression metrics
LINE_SRC = "SELECT l_returnflag AS g, l_extendedprice / 1000.0 AS y, l_quantity * 1.5 AS p FROM lineitem"


def line_preds(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_returnflag", (F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_quantity") * 1.5).alias("p"))


def _reg_sql(out):
    return f"""
WITH s AS ({LINE_SRC}),
a AS (SELECT g, count(*) AS n, sum((y - p) * (y - p)) AS sse, var_pop(y) * count(*) AS sst FROM s GROUP BY g)
SELECT g AS l_returnflag, {out} FROM a"""


R2_SQL = "round(CASE WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sse / sst END, 6) AS r2"


@query("mse", _reg_sql("round(sse / n, 6) AS mse"))
def q_mse(spark, d):
    return M.regression_metrics(line_preds(spark, d), "y", "p", ["l_returnflag"]).select("l_returnflag", round6("mse").alias("mse"))


@query("rmse", _reg_sql("round(sqrt(sse / n), 6) AS rmse"))
def q_rmse(spark, d):
    return M.regression_metrics(line_preds(spark, d), "y", "p", ["l_returnflag"]).select("l_returnflag", round6("rmse").alias("rmse"))


@query("r2", _reg_sql(R2_SQL))
def q_r2(spark, d):
    return M.regression_metrics(line_preds(spark, d), "y", "p", ["l_returnflag"]).select("l_returnflag", round6("r2").alias("r2"))


# ----------------------------------------------------------------- time-series metrics (naive forecast)
TS_SRC = """
SELECT user_id AS g, value AS y, value_lag_1 AS p FROM (
  SELECT user_id, value, lag(value, 1) OVER w AS value_lag_1, row_number() OVER w - 1 AS position
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE position >= 1"""


def naive_forecasts(spark, d):
    s = lag_features(table(spark, d, "events"), ["value"], "value", "ts", "event_id", "user_id", 1, 1)
    return s.select("user_id", F.col("y"), F.col("value_lag_1").alias("p"))


def _ts_sql(out):
    return f"""
WITH s AS ({TS_SRC}),
a AS (SELECT g, count(*) AS n, sum((y - p) * (y - p)) AS sse, var_pop(y) * count(*) AS sst, avg(abs(y - p)) AS mae,
             avg(abs((y - p) / (y + 1e-10))) * 100 AS mape FROM s GROUP BY g)
SELECT g AS user_id, {out} FROM a"""


@query("mae", _ts_sql("round(mae, 6) AS mae"))
def q_mae(spark, d):
    return M.timeseries_metrics(naive_forecasts(spark, d), "y", "p", ["user_id"]).select("user_id", round6("mae").alias("mae"))


@query("mape", _ts_sql("round(mape, 6) AS mape"))
def q_mape(spark, d):
    return M.timeseries_metrics(naive_forecasts(spark, d), "y", "p", ["user_id"]).select("user_id", round6("mape").alias("mape"))


@query("timeseries_metrics", _ts_sql("round(sse / n, 6) AS mse, round(sqrt(sse / n), 6) AS rmse, round(mae, 6) AS mae, "
                                     + R2_SQL + ", round(mape, 6) AS mape"))
def q_timeseries_metrics(spark, d):
    m = M.timeseries_metrics(naive_forecasts(spark, d), "y", "p", ["user_id"])
    return m.select("user_id", *[round6(c).alias(c) for c in ("mse", "rmse", "mae", "r2", "mape")])


# ----------------------------------------------------------------- anomaly metrics
def event_flags(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", "event_type", F.to_date("ts").alias("day"),
                     (F.col("event_type") == "error").cast("int").alias("y"),
                     F.when(F.col("value") > 100, -1).otherwise(1).alias("raw"))


@query("anomaly_metrics", """
WITH s AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
                  CASE WHEN value > 100 THEN 1 ELSE 0 END AS p FROM events),
a AS (SELECT day, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND p = 1) AS fp,
             count(*) FILTER (WHERE y <> 1 AND p <> 1) AS tn, count(*) FILTER (WHERE y = 1 AND p <> 1) AS fn FROM s GROUP BY day),
b AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS pr,
               CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS rc FROM a)
SELECT day, round(pr, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1_score,
       round(CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN 0.0 ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END, 6) AS roc_auc,
       tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives FROM b""")
def q_anomaly_metrics(spark, d):
    s = event_flags(spark, d).withColumn("p", M.anomaly_map("raw"))
    m = M.anomaly_metrics(s, "y", "p", ["day"])
    return m.select("day", *[round6(c).alias(c) for c in ("precision", "recall", "f1_score", "roc_auc")],
                    "true_positives", "false_positives", "true_negatives", "false_negatives")


@query("anomaly_map", """
SELECT event_id, CASE WHEN value > 100 THEN -1 ELSE 1 END AS raw, CASE WHEN value > 100 THEN 1 ELSE 0 END AS anomaly FROM events""")
def q_anomaly_map(spark, d):
    return event_flags(spark, d).select("event_id", "raw", M.anomaly_map("raw").alias("anomaly"))


@query("anomaly_ratio", """
SELECT event_type, round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END), 6) AS anomaly_ratio,
       count(*) FILTER (WHERE value > 100) AS n_anomalies, count(*) FILTER (WHERE NOT value > 100) AS n_normal
FROM events GROUP BY event_type""")
def q_anomaly_ratio(spark, d):
    s = event_flags(spark, d).withColumn("p", M.anomaly_map("raw"))
    r = M.anomaly_ratio(s, "p", ["event_type"])
    return r.select("event_type", round6("anomaly_ratio").alias("anomaly_ratio"), "n_anomalies", "n_normal")


# ----------------------------------------------------------------- customer points (2-D)
CUST_SRC = "SELECT c_custkey AS id, c_acctbal / 1000.0 AS x0, CAST(c_nationkey AS DOUBLE) AS x1, c_mktsegment AS seg FROM customer"


def customer_points(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", (F.col("c_acctbal") / 1000.0).alias("x0"), F.col("c_nationkey").cast("double").alias("x1"),
                    "c_mktsegment")


@query("silhouette_score", f"""
WITH p AS ({CUST_SRC}), p2 AS (SELECT *, x0 * x0 + x1 * x1 AS xx FROM p),
s AS (SELECT seg, count(*) AS n, sum(x0) AS s0, sum(x1) AS s1, sum(xx) AS q FROM p2 GROUP BY seg),
d AS (SELECT p2.id, p2.seg AS own, s.seg AS other, s.n, s.n * p2.xx - 2 * (p2.x0 * s.s0 + p2.x1 * s.s1) + s.q AS tot FROM p2, s),
ab AS (SELECT id, max(CASE WHEN own = other THEN n END) AS n_own,
              max(CASE WHEN own = other THEN tot / (n - 1) END) AS a,
              min(CASE WHEN own <> other THEN tot / n END) AS b FROM d GROUP BY id)
SELECT round(avg(CASE WHEN n_own <= 1 OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette_score FROM ab""")
def q_silhouette(spark, d):
    s = C.silhouette_score(customer_points(spark, d), ["x0", "x1"], "c_mktsegment")
    return s.select(round6("silhouette_score").alias("silhouette_score"))


# ----------------------------------------------------------------- splits + metrics
def orders_split_preds(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.expr(RULE_PRICE).alias("pred"))
    return SP.split_stratified(o, "o_orderkey", "o_orderpriority")


SPLIT_SRC = """
WITH r AS (SELECT o_orderpriority, {rule} AS pred,
                  row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn,
                  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
c AS (SELECT *, CAST(ceil(n * 0.2) AS BIGINT) AS k1 FROM r)
SELECT CASE WHEN rn <= k1 THEN 'test' WHEN rn <= k1 + CAST(ceil((n - k1) * 0.125) AS BIGINT) THEN 'val' ELSE 'train' END AS g,
       o_orderpriority AS y, pred AS p FROM c""".format(rule=RULE_PRICE)


@query("evaluate_splits", _clf_sql(SPLIT_SRC, "g", "g AS split, round(accuracy, 6) AS accuracy, round(precision_weighted, 6) AS "
                                   "precision_weighted, round(recall_weighted, 6) AS recall_weighted, round(f1_weighted, 6) AS f1_weighted"))
def q_evaluate_splits(spark, d):
    m = M.evaluate_splits(orders_split_preds(spark, d), "classification", "o_orderpriority", "pred")
    return m.select("split", *[round6(c).alias(c) for c in ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted")])


@query("flatten_metrics", "WITH m AS (" + _clf_sql(SPLIT_SRC, "g", "g, accuracy, precision_weighted, recall_weighted, f1_weighted") + """)
SELECT g || '_accuracy' AS name, round(accuracy, 6) AS value FROM m
UNION ALL SELECT g || '_precision_weighted', round(precision_weighted, 6) FROM m
UNION ALL SELECT g || '_recall_weighted', round(recall_weighted, 6) FROM m
UNION ALL SELECT g || '_f1_weighted', round(f1_weighted, 6) FROM m""")
def q_flatten_metrics(spark, d):
    m = M.evaluate_splits(orders_split_preds(spark, d), "classification", "o_orderpriority", "pred")
    cols = ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted"]
    f = M.flatten_metrics(m, cols)
    return f.select("name", round6("value").alias("value"))


# ----------------------------------------------------------------- runs: leaderboard, registry
def segment_runs(spark, d):
    """One run per (experiment = order status segment, rule model): the
    segment's accuracy is the run score."""
    parts = None
    for i, (name, rule) in enumerate(RULES):
        p = order_preds(spark, d, rule).select(
            F.col("o_orderstatus").alias("experiment"), F.lit(name).alias("model"), F.lit(i).alias("model_order"),
            "o_orderpriority", "pred")
        parts = p if parts is None else parts.unionByName(p)
    m = M.classification_metrics(parts, "o_orderpriority", "pred", ["experiment", "model", "model_order"])
    return m.select("experiment", "model", "model_order", round6("accuracy").alias("score"),
                    (F.col("model") == "month_band").alias("hpo_used"))


RUNS_SQL = " UNION ALL ".join(
    f"SELECT o_orderstatus AS experiment, '{n}' AS model, {i} AS model_order, o_orderpriority AS y, {r} AS p FROM orders"
    for i, (n, r) in enumerate(RULES))
RUNS_CTE = f"""
runs AS (SELECT experiment, model, model_order, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS score,
                model = 'month_band' AS hpo_used
         FROM ({RUNS_SQL}) GROUP BY experiment, model, model_order)"""


@query("leaderboard", f"""
WITH {RUNS_CTE}
SELECT experiment, model, score,
       CAST(row_number() OVER (PARTITION BY experiment ORDER BY score DESC NULLS LAST, model_order) AS INTEGER) AS rank
FROM runs""")
def q_leaderboard(spark, d):
    return L.leaderboard(segment_runs(spark, d), "score", "max").select("experiment", "model", "score", "rank")


@query("best_run", f"""
WITH {RUNS_CTE}
SELECT experiment, model, score FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY score DESC NULLS LAST, model_order) AS rk FROM runs) WHERE rk = 1""")
def q_best_run(spark, d):
    return L.best_run(segment_runs(spark, d), "score", "max").select("experiment", "model", "score")


@query("tuning_summary", f"""
WITH {RUNS_CTE}
SELECT experiment, count(*) AS models_trained, count(*) FILTER (WHERE hpo_used) AS models_optimized FROM runs GROUP BY experiment""")
def q_tuning_summary(spark, d):
    return L.tuning_summary(segment_runs(spark, d))


def staged_versions(spark, d):
    runs = segment_runs(spark, d)
    versions = runs.select(F.concat(F.lit("orders_"), F.col("experiment")).alias("model_name"),
                           (F.col("model_order") + 1).cast("bigint").alias("version"), "model", "score")
    return G.promote(versions)


VERSIONS_CTE = RUNS_CTE + """,
v AS (SELECT 'orders_' || experiment AS model_name, CAST(model_order + 1 AS BIGINT) AS version, model, score FROM runs),
st AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY model_name ORDER BY version DESC) = 1 THEN 'Production' ELSE 'Archived' END AS stage FROM v)"""


@query("promote", f"WITH {VERSIONS_CTE} SELECT model_name, version, stage FROM st")
def q_promote(spark, d):
    return staged_versions(spark, d).select("model_name", "version", "stage")


@query("production_version", f"WITH {VERSIONS_CTE} SELECT model_name, max(version) AS version FROM st WHERE stage = 'Production' GROUP BY model_name")
def q_production_version(spark, d):
    st = staged_versions(spark, d).withColumn("run_id", F.concat_ws(":", "model_name", "version"))
    return G.production_version(st).select("model_name", "version")


@query("model_info", f"""WITH {VERSIONS_CTE}
SELECT model_name, version, model, score FROM st WHERE stage = 'Production'""")
def q_model_info(spark, d):
    st = staged_versions(spark, d).withColumn("run_id", F.concat_ws(":", "model_name", "version"))
    runs = st.select("run_id", "model", "score")
    return G.model_info(st.select("model_name", "version", "run_id", "stage"), runs).select(
        "model_name", "version", "model", "score")


# ----------------------------------------------------------------- trials
SPACE = {
    "threshold": {"type": "float", "low": 0.0, "high": 10000.0},
    "alpha": {"type": "float", "low": 0.001, "high": 100.0, "log": True},
    "depth": {"type": "int", "low": 3, "high": 20, "step": 1},
    "kernel": {"type": "categorical", "choices": ["rbf", "linear", "poly"]},
}


def _u_sql(param):
    return (f"(CAST(('0x' || substr(md5('42:' || experiment || ':' || CAST(trial_id AS VARCHAR) || ':{param}'), 1, 13)) AS BIGINT)"
            " / 4503599627370496.0)")


TRIALS_SQL = f"""
SELECT experiment, trial_id, round(0.0 + {_u_sql('threshold')} * 10000.0, 6) AS threshold,
       round(exp(ln(0.001) + {_u_sql('alpha')} * (ln(100.0) - ln(0.001))), 6) AS alpha,
       CAST(3 + 1 * floor({_u_sql('depth')} * 18) AS BIGINT) AS depth,
       ['rbf', 'linear', 'poly'][CAST(floor({_u_sql('kernel')} * 3) AS BIGINT) + 1] AS kernel
FROM (SELECT DISTINCT c_mktsegment AS experiment FROM customer) e, range(20) t(trial_id)"""


def segment_trials(spark, d):
    exps = table(spark, d, "customer").select(F.col("c_mktsegment").alias("experiment")).distinct()
    return TU.sample_trials(exps, SPACE, 20, seed=42)


@query("sample_trials", TRIALS_SQL)
def q_sample_trials(spark, d):
    t = segment_trials(spark, d)
    return t.select("experiment", "trial_id", round6("threshold").alias("threshold"), round6("alpha").alias("alpha"),
                    "depth", "kernel")


@query("best_trial", f"""
WITH t AS ({TRIALS_SQL}),
sc AS (SELECT t.experiment, t.trial_id, t.threshold,
              avg(CASE WHEN (c.c_acctbal > t.threshold) = (c.c_nationkey >= 12) THEN 1.0 ELSE 0.0 END) AS score
       FROM t JOIN customer c ON c.c_mktsegment = t.experiment GROUP BY t.experiment, t.trial_id, t.threshold)
SELECT experiment, n_trials, round(score, 6) AS best_score, trial_id AS best_trial_id FROM (
  SELECT *, count(*) OVER (PARTITION BY experiment) AS n_trials,
         row_number() OVER (PARTITION BY experiment ORDER BY score DESC, trial_id) AS rk FROM sc) WHERE rk = 1""")
def q_best_trial(spark, d):
    t = segment_trials(spark, d).withColumn("threshold", round6("threshold"))
    cust = table(spark, d, "customer").select(F.col("c_mktsegment").alias("experiment"), "c_acctbal", "c_nationkey")
    scored = TU.evaluate_trials(t, cust, ["experiment"],
                                ((F.col("c_acctbal") > F.col("threshold")) == (F.col("c_nationkey") >= 12)).cast("double"))
    b = L.best_trial(scored.withColumn("params", F.create_map(F.lit("threshold"), F.col("threshold"))), "score",
                     ["experiment"])
    return b.select("experiment", "n_trials", round6("best_score").alias("best_score"), "best_trial_id")


@query("cross_validate", """
WITH f AS (SELECT c_acctbal, c_nationkey,
                  (row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1) % 5 AS fold
           FROM customer),
s AS (SELECT 'acctbal_4500' AS model, fold, avg(CASE WHEN (c_acctbal > 4500) = (c_nationkey >= 12) THEN 1.0 ELSE 0.0 END) AS score FROM f GROUP BY fold
      UNION ALL
      SELECT 'acctbal_2000', fold, avg(CASE WHEN (c_acctbal > 2000) = (c_nationkey >= 12) THEN 1.0 ELSE 0.0 END) FROM f GROUP BY fold)
SELECT model, count(*) AS n_folds, round(avg(score), 6) AS cv_mean, round(stddev_pop(score), 6) AS cv_std FROM s GROUP BY model""")
def q_cross_validate(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    f = SP.kfold(c, "c_custkey", 5, "c_mktsegment")
    y = F.col("c_nationkey") >= 12
    parts = None
    for name, thr in (("acctbal_4500", 4500), ("acctbal_2000", 2000)):
        p = f.groupBy("fold").agg(F.avg(((F.col("c_acctbal") > thr) == y).cast("double")).alias("score")).withColumn(
            "model", F.lit(name))
        parts = p if parts is None else parts.unionByName(p)
    cv = L.cross_validate(parts, "score", ["model"])
    return cv.select("model", "n_folds", round6("cv_mean").alias("cv_mean"), round6("cv_std").alias("cv_std"))


# ----------------------------------------------------------------- closed-form models
@query("linear_regression", """
SELECT round(regr_intercept(l_extendedprice / 1000.0, l_quantity), 6) AS intercept,
       round(regr_slope(l_extendedprice / 1000.0, l_quantity), 6) AS coef_l_quantity FROM lineitem""", headline=True)
def q_linear_regression(spark, d):
    from quarry.models.supervised import fit_regressor

    li = table(spark, d, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000.0).alias(LABEL))
    m = fit_regressor(li, ["l_quantity"], "linear_regression", {}).stages[-1]
    return spark.createDataFrame([(float(m.intercept), float(m.coefficients[0]))], "intercept double, coef_l_quantity double") \
        .select(round6("intercept").alias("intercept"), round6("coef_l_quantity").alias("coef_l_quantity"))


@query("ridge", """
WITH s AS (SELECT l_quantity AS x1, l_discount * 100 AS x2, l_extendedprice / 1000.0 AS y FROM lineitem),
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, covar_pop(x1, x1) * count(*) AS s11,
             covar_pop(x1, x2) * count(*) AS s12, covar_pop(x2, x2) * count(*) AS s22,
             covar_pop(x1, y) * count(*) AS s1y, covar_pop(x2, y) * count(*) AS s2y FROM s),
r AS (SELECT *, (s11 + 1.0) * (s22 + 1.0) - s12 * s12 AS det FROM m),
c AS (SELECT *, ((s22 + 1.0) * s1y - s12 * s2y) / det AS b1, ((s11 + 1.0) * s2y - s12 * s1y) / det AS b2 FROM r)
SELECT round(my - m1 * b1 - m2 * b2, 6) AS intercept, round(b1, 6) AS coef_l_quantity, round(b2, 6) AS coef_discount_pct FROM c""")
def q_ridge(spark, d):
    from quarry.models.supervised import fit_regressor

    li = table(spark, d, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("discount_pct"),
                                            (F.col("l_extendedprice") / 1000.0).alias(LABEL))
    m = fit_regressor(li, ["l_quantity", "discount_pct"], "ridge", {"alpha": 1.0}).stages[-1]
    row = (float(m.intercept), float(m.coefficients[0]), float(m.coefficients[1]))
    return spark.createDataFrame([row], "intercept double, coef_l_quantity double, coef_discount_pct double").select(
        *[round6(c).alias(c) for c in ("intercept", "coef_l_quantity", "coef_discount_pct")])


KMEANS_SQL = f"""
WITH p AS ({CUST_SRC}),
c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS k, x0, x1 FROM (SELECT * FROM p ORDER BY id LIMIT 3)),
{{steps}}
SELECT id AS c_custkey, CAST(k AS INTEGER) AS cluster FROM a3"""


def _kmeans_step(i):
    prev = f"c{i - 1}"
    return f"""a{i} AS (SELECT id, k FROM (SELECT p.id, c.k, row_number() OVER (PARTITION BY p.id ORDER BY
            (p.x0 - c.x0) * (p.x0 - c.x0) + (p.x1 - c.x1) * (p.x1 - c.x1), c.k) AS rn FROM p, {prev} c) WHERE rn = 1),
c{i} AS (SELECT o.k, coalesce(n.x0, o.x0) AS x0, coalesce(n.x1, o.x1) AS x1 FROM {prev} o LEFT JOIN
            (SELECT a{i}.k, avg(p.x0) AS x0, avg(p.x1) AS x1 FROM p JOIN a{i} ON p.id = a{i}.id GROUP BY a{i}.k) n ON o.k = n.k)"""


@query("kmeans_steps", KMEANS_SQL.replace("{steps}", ",\n".join(_kmeans_step(i) for i in (1, 2)) + ",\n" + f"""a3 AS (SELECT id, k FROM (SELECT p.id, c.k, row_number() OVER (PARTITION BY p.id ORDER BY
            (p.x0 - c.x0) * (p.x0 - c.x0) + (p.x1 - c.x1) * (p.x1 - c.x1), c.k) AS rn FROM p, c2 c) WHERE rn = 1)"""))
def q_kmeans_steps(spark, d):
    pts = customer_points(spark, d)
    init = np.array(pts.orderBy("c_custkey").limit(3).select("x0", "x1").collect(), dtype=float)
    _, assigned = C.kmeans_steps(pts, ["x0", "x1"], init, 2)
    return assigned.select("c_custkey", "cluster")


@query("elliptic_envelope", f"""
WITH p AS ({CUST_SRC}),
m AS (SELECT avg(x0) AS m0, avg(x1) AS m1, avg(x0 * x0) - avg(x0) * avg(x0) AS c00,
             avg(x0 * x1) - avg(x0) * avg(x1) AS c01, avg(x1 * x1) - avg(x1) * avg(x1) AS c11 FROM p),
i AS (SELECT *, c00 * c11 - c01 * c01 AS det FROM m),
d AS (SELECT p.id, (c11 / det) * (x0 - m0) * (x0 - m0) + 2 * (-c01 / det) * (x0 - m0) * (x1 - m1)
                    + (c00 / det) * (x1 - m1) * (x1 - m1) AS d2 FROM p, i),
t AS (SELECT quantile_cont(d2, 0.9) AS thr FROM d)
SELECT id AS c_custkey, round(d2, 6) AS mahalanobis2, d2 > thr AS is_outlier FROM d, t""")
def q_elliptic_envelope(spark, d):
    pts = customer_points(spark, d)
    m = A.fit_elliptic_envelope(pts, ["x0", "x1"], contamination=0.1, robust=False, exact_quantile=True)
    out = m.transform(pts)
    return out.select("c_custkey", round6("score").alias("mahalanobis2"), (F.col("prediction") == 1).alias("is_outlier"))


@query("local_outlier_factor", f"""
WITH p AS ({CUST_SRC}),
pairs AS (SELECT a.id AS q, b.id AS n, (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) AS d2
          FROM p a JOIN p b ON a.id <> b.id),
knn AS (SELECT q, n, sqrt(d2) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, n) AS rk FROM pairs) WHERE rk <= 20),
kd AS (SELECT q, max(dist) AS kdist FROM knn GROUP BY q),
lrd AS (SELECT knn.q, 1.0 / (avg(greatest(kd.kdist, knn.dist)) + 1e-10) AS lrd FROM knn JOIN kd ON knn.n = kd.q GROUP BY knn.q),
nb AS (SELECT knn.q, avg(l2.lrd) AS nb FROM knn JOIN lrd l2 ON knn.n = l2.q GROUP BY knn.q)
SELECT kd.q AS c_custkey, round(kd.kdist, 6) AS kdist, round(lrd.lrd, 6) AS lrd, round(nb.nb / lrd.lrd, 6) AS lof
FROM kd JOIN lrd ON kd.q = lrd.q JOIN nb ON kd.q = nb.q""")
def q_local_outlier_factor(spark, d):
    pts = customer_points(spark, d)
    lof = A.local_outlier_factor(pts, "c_custkey", ["x0", "x1"], 20)
    return lof.select("c_custkey", round6("kdist").alias("kdist"), round6("lrd").alias("lrd"), round6("lof").alias("lof"))


@query("dbscan", f"""
WITH RECURSIVE p AS ({CUST_SRC}),
nb AS (SELECT a.id AS q, b.id AS n FROM p a JOIN p b ON (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) <= 0.25),
core AS (SELECT q AS id FROM nb GROUP BY q HAVING count(*) >= 5),
edges AS (SELECT nb.q AS src, nb.n AS dst FROM nb JOIN core c1 ON nb.q = c1.id JOIN core c2 ON nb.n = c2.id),
cc(id, label) AS (SELECT id, id FROM core UNION SELECT e.dst, cc.label FROM cc JOIN edges e ON cc.id = e.src),
comp AS (SELECT id, min(label) AS label FROM cc GROUP BY id),
border AS (SELECT nb.q AS id, min(comp.label) AS label FROM nb JOIN comp ON nb.n = comp.id
           WHERE nb.q NOT IN (SELECT id FROM core) GROUP BY nb.q)
SELECT p.id AS c_custkey, coalesce(comp.label, border.label, -1) AS cluster, comp.id IS NOT NULL AS is_core
FROM p LEFT JOIN comp ON p.id = comp.id LEFT JOIN border ON p.id = border.id""", headline=True)
def q_dbscan(spark, d):
    labels, _ = C.dbscan(customer_points(spark, d), "c_custkey", ["x0", "x1"], eps=0.5, min_samples=5)
    return labels.select("c_custkey", F.col("cluster").cast("bigint").alias("cluster"), "is_core")


# ----------------------------------------------------------------- chunked scoring and dead letters
def order_records_with_gaps(spark, d):
    """Stand-in request records: orders in status P arrive without a price."""
    o = table(spark, d, "orders")
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    rec = o.select(F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus", price.alias("o_totalprice"),
                                      "o_orderpriority")).alias("record"))
    from quarry.plans.queries_data import RECORD_SCHEMA

    return R.read_records(rec, "record", RECORD_SCHEMA)


@query("dead_letter", "SELECT o_orderkey, 'missing features: o_totalprice' AS reason FROM orders WHERE o_orderstatus = 'P'")
def q_dead_letter(spark, d):
    _, errors = SC.dead_letter(order_records_with_gaps(spark, d), ["o_totalprice", "o_custkey"], "o_orderkey")
    return errors


@query("score_chunks", """
WITH r AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch_index, o_orderstatus = 'P' AS failed FROM orders),
c AS (SELECT batch_index, count(*) AS batch_size, count(*) FILTER (WHERE NOT failed) AS n_ok,
             count(*) FILTER (WHERE failed) AS n_failed FROM r GROUP BY batch_index)
SELECT batch_index, batch_size, n_ok, n_failed, n_ok AS n_scored, CAST(sum(n_ok) OVER (ORDER BY batch_index) AS BIGINT) AS processed,
       (SELECT count(*) FROM orders) AS total,
       round(least(100.0, 100.0 * sum(batch_size) OVER (ORDER BY batch_index) / (SELECT count(*) FROM orders)), 6) AS progress
FROM c""")
def q_score_chunks(spark, d):
    from quarry.models import PipelineFitted
    from quarry.models.supervised import fit_classifier

    feats = ["o_totalprice", "o_custkey"]
    rec = order_records_with_gaps(spark, d)
    train = rec.where(F.col("o_totalprice").isNotNull()).withColumn(
        LABEL, (F.col("o_orderpriority") == "1-URGENT").cast("double"))
    model = PipelineFitted(fit_classifier(train, feats, "logistic_regression", {"max_iter": 50}, 2), feats,
                           "classification", "logistic_regression")
    _, chunks, _ = SC.score_chunks(model, rec, "o_orderkey", feats)
    return chunks.select("batch_index", "batch_size", "n_ok", "n_failed", "n_scored", "processed", "total",
                         round6("progress").alias("progress"))



