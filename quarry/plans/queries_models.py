"""Registered queries for the model catalogue (§2.7), training and tuning
(§2.8), the run log (§2.10) and scoring (§2.11) that no SQL oracle can
express (rows check). Each model query trains through ``train_many`` on the
whole table and returns the scored held-out rows (all rows for clustering).

Every parameter is the catalogue default.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.models.catalog import CATALOG
from quarry.plans.flagship import FEATURES as DOC_FEATURES
from quarry.plans.flagship import document_quality, leaderboard_frame, quality_frame
from quarry.plans.queries_data import LINEITEM_NUMERIC  # noqa: F401 - the oracle below is registered there
from quarry.plans.registry import ORACLE, query
from quarry.plans.train import TrainConfig, train_many
from quarry.session import scratch_path, table

def lineitem_frame(spark, d):
    """lineitem with a whole-row key (no column subset is unique)."""
    li = table(spark, d, "lineitem")
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in li.columns]))
    return li.select(key.alias("row_key"), "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                     (F.col("l_extendedprice") / 1000.0).alias("price_k"))


def events_frame(spark, d):
    ev = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return ev.select("event_id", "user_id", "ts", "value", k.alias("props_k"),
                     F.hour("ts").cast("double").alias("hour"))


def customer_frame(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", (F.col("c_acctbal") / 1000.0).alias("x0"), F.col("c_nationkey").cast("double").alias("x1"))


def toxic_frame(spark, d):
    return quality_frame(spark, d).join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id").drop("quality")


TASK_DATA = {
    "classification": (quality_frame, dict(target="quality", key="doc_id", features=DOC_FEATURES)),
    "regression": (lineitem_frame, dict(target="price_k", key="row_key",
                                        features=["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])),
    "timeseries": (events_frame, dict(target="value", key="event_id", features=["value", "props_k"], time_col="ts",
                                      series_key="user_id", lookback=10)),
    "anomaly_detection": (events_frame, dict(target=None, key="event_id", features=["value", "props_k", "hour"])),
    "clustering": (customer_frame, dict(target=None, key="c_custkey", features=["x0", "x1"])),
}
SUPERVISED_ANOMALY = (toxic_frame, dict(target="toxic", key="doc_id", features=DOC_FEATURES))
PREFIX = {"classification": "clf", "regression": "reg", "timeseries": "ts", "anomaly_detection": "anom",
          "clustering": "clu"}


def run_model(spark, d, task: str, name: str, overrides: dict | None = None):
    build, kw = SUPERVISED_ANOMALY if name.endswith("_supervised") else TASK_DATA[task]
    df = build(spark, d)
    ov = {name: overrides} if overrides else {}
    cfg = TrainConfig(task=task, models=[name], overrides=ov, experiment=f"{PREFIX[task]}_{name}", **kw)
    res = train_many(spark, df, cfg)
    if name not in res.models:
        err = res.runs.select("error").first()[0]
        raise RuntimeError(f"{task}/{name} failed: {err}")
    m = res.models[name]
    rows = res.prepared if task == "clustering" else res.prepared.where(F.col("split") != "train")
    out = m.transform(rows)
    keep = [c for c in (kw["key"], "split", "label", "prediction", "score") if c in out.columns]
    return out.select(*keep)


#: catalogue queries whose answer SQL can express. DBSCAN on the training split; every row takes the
#: label of the nearest core point within the radius
CATALOGUE_SQL = {"clu_dbscan": """
WITH RECURSIVE r AS (
  SELECT c_custkey, row_number() OVER (ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey) AS rn, count(*) OVER () AS n FROM customer),
c AS (SELECT *, CAST(ceil(n * 0.2) AS BIGINT) AS k1 FROM r),
s AS (SELECT c_custkey, CASE WHEN rn <= k1 THEN 'test' WHEN rn <= k1 + CAST(ceil((n - k1) * 0.125) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM c),
p AS (SELECT c_custkey AS id, split, c_acctbal / 1000.0 AS x0, CAST(c_nationkey AS DOUBLE) AS x1 FROM customer JOIN s USING (c_custkey)),
t AS (SELECT * FROM p WHERE split = 'train'),
nb AS (SELECT a.id AS q, b.id AS n FROM t a JOIN t b ON (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) <= 0.25),
core AS (SELECT q AS id FROM nb GROUP BY q HAVING count(*) >= 5),
edges AS (SELECT nb.q AS src, nb.n AS dst FROM nb JOIN core c1 ON nb.q = c1.id JOIN core c2 ON nb.n = c2.id),
cc(id, label) AS (SELECT id, id FROM core UNION SELECT e.dst, cc.label FROM cc JOIN edges e ON cc.id = e.src),
comp AS (SELECT id, min(label) AS label FROM cc GROUP BY id),
near AS (SELECT p.id, comp.label, row_number() OVER (
           PARTITION BY p.id ORDER BY (p.x0 - t.x0) * (p.x0 - t.x0) + (p.x1 - t.x1) * (p.x1 - t.x1), comp.label) AS nth
         FROM p JOIN t ON (p.x0 - t.x0) * (p.x0 - t.x0) + (p.x1 - t.x1) * (p.x1 - t.x1) <= 0.25 JOIN comp ON comp.id = t.id)
SELECT p.id AS c_custkey, p.split, CAST(coalesce(near.label, -1) AS DOUBLE) AS prediction FROM p LEFT JOIN near ON near.id = p.id AND near.nth = 1
"""}


def _register_catalogue():
    for task, models in CATALOG.items():
        for name in models:
            qid = f"{PREFIX[task]}_{name}"
            headline = qid in ("clf_gradient_boosting", "anom_isolation_forest")

            def fn(spark, d, _t=task, _n=name):
                return run_model(spark, d, _t, _n)

            fn.__name__ = f"q_{qid}"
            fn.__doc__ = f"Catalogue model {task}/{name}: train on the whole table, score the held-out rows."
            query(qid, CATALOGUE_SQL.get(qid), headline=headline)(fn)


_register_catalogue()


@query("kmeans")
def q_kmeans(spark, d):
    """MLlib k-means (best of 10 seeds) on the embeddings (64 dims)."""
    from pyspark.ml.functions import array_to_vector

    from quarry.models.clustering import MLlibClusterModel
    from pyspark.ml.clustering import KMeans

    emb = table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    best, cost = None, None
    for i in range(10):
        m = KMeans(k=10, maxIter=300, seed=42 + i, featuresCol="features").fit(emb)
        if cost is None or m.summary.trainingCost < cost:
            best, cost = m, m.summary.trainingCost
    return MLlibClusterModel(best, ["features"], "kmeans").transform(emb).select("vec_id", "prediction")


# ----------------------------------------------------------------- training / tuning / run log
@query("train_many")
def q_train_many(spark, d):
    res = document_quality(spark, d, ["logistic_regression", "random_forest", "gradient_boosting"])
    return leaderboard_frame(res)


@query("train_many_tuned")
def q_train_many_tuned(spark, d):
    """train_many with tuning on (10 trials) and k-fold CV scores; returns the
    runs with their flags."""
    cfg = TrainConfig(task="classification", target="quality", key="doc_id", features=DOC_FEATURES,
                      models=["logistic_regression", "random_forest"], use_cv=True, cv_folds=3,
                      hpo={"enabled": True, "n_trials": 10},
                      experiment="document_quality_tuned")
    res = train_many(spark, quality_frame(spark, d), cfg)
    return res.runs.select("model", "status", "hpo_used", "score", F.col("metrics")["cv_mean"].alias("cv_mean"),
                           F.col("metrics")["cv_std"].alias("cv_std"))


@query("write_manifest")
def q_write_manifest(spark, d):
    from quarry.sources.sinks import write_manifest

    res = document_quality(spark, d)
    path = scratch_path(spark, "manifest")
    write_manifest(res.runs, path, {"source_type": "parquet", "dataset": "documents+labels"})
    return spark.read.json(path)


@query("tune_holdout")
def q_tune_holdout(spark, d):
    from quarry.plans.train import prepare
    from quarry.plans.tune import tune_holdout

    build, kw = TASK_DATA["regression"]
    cfg = TrainConfig(task="regression", **kw)
    prepared, feats, _ = prepare(build(spark, d), cfg)
    prepared = prepared.select(*feats, "label", "split").cache()
    try:
        return tune_holdout(spark, "regression", "ridge", prepared.where("split = 'train'"), prepared.where("split = 'val'"),
                            feats, n_trials=20, experiment="lineitem_ridge")
    finally:
        prepared.unpersist()


@query("tune_rules")
def q_tune_rules(spark, d):
    """For every document source, 40 trials of a rule for quality (least letters, least length), in rounds that
    learn from the earlier ones."""
    from quarry.plans.tune import tune_rules

    rows = quality_frame(spark, d).select(F.col("source").alias("experiment"), "n_chars", "letter_share", "quality").filter("experiment is not null")
    space = {"least_letters": {"type": "float", "low": 0.3, "high": 1.0}, "least_chars": {"type": "int", "low": 1, "high": 4000}}
    right = ((F.col("letter_share") >= F.col("least_letters")) & (F.col("n_chars") >= F.col("least_chars"))).cast("int") == F.col("quality")
    return tune_rules(rows.select("experiment").distinct(), rows, ["experiment"], right.cast("double"), space, 40)


@query("tune_cv")
def q_tune_cv(spark, d):
    from quarry.plans.train import prepare
    from quarry.plans.tune import tune_cv

    build, kw = TASK_DATA["regression"]
    cfg = TrainConfig(task="regression", **kw)
    prepared, feats, _ = prepare(build(spark, d), cfg)
    train = prepared.where("split != 'test'")
    return tune_cv(spark, "regression", "lasso", train, feats, folds=3, n_trials=10, key="row_key",
                   experiment="lineitem_lasso")


@query("log_run")
def q_log_run(spark, d):
    from quarry.operators.registry import log_run

    res = document_quality(spark, d)
    path = scratch_path(spark, "runs")
    log_run(res.runs, path)
    return spark.read.parquet(path).select("run_id", "experiment", "model", "status", "score", "duration_sec")


@query("log_tuning")
def q_log_tuning(spark, d):
    from quarry.operators.registry import log_run

    trials = q_tune_holdout(spark, d)
    path = scratch_path(spark, "trials")
    log_run(trials, path)
    return spark.read.parquet(path)


@query("write_model")
def q_write_model(spark, d):
    """Save the flagship's best model (of any class) with a 5-row input example, load it
    back and score every labelled document with the reloaded model."""
    from quarry.models.served import load_model
    from quarry.sources.sinks import write_model

    res = document_quality(spark, d)
    best = res.leaderboard.where("rank = 1").select("model").first()[0]
    path = scratch_path(spark, "model")
    write_model(res.models[best], path, example=res.prepared.select(*DOC_FEATURES))
    again = load_model(spark, f"{path}/served_model").fitted  # prepared rows are encoded already
    return again.transform(res.prepared).select("doc_id", "split", "label", "prediction")


# ----------------------------------------------------------------- scoring
def _quality_model(spark, d):
    res = document_quality(spark, d, ["logistic_regression"])
    return res, res.models["logistic_regression"]


@query("score")
def q_score(spark, d):
    from quarry.streaming.scoring import score

    res, m = _quality_model(spark, d)
    return score(m, quality_frame(spark, d), DOC_FEATURES, keep=["doc_id"]).select("doc_id", "prediction")


@query("score_proba")
def q_score_proba(spark, d):
    from quarry.streaming.scoring import score

    res, m = _quality_model(spark, d)
    s = score(m, quality_frame(spark, d), DOC_FEATURES, keep=["doc_id"])
    return s.select("doc_id", "prediction", F.col("probability")[0].alias("p_0"), F.col("probability")[1].alias("p_1"))


@query("score_proba_calibrated")
def q_score_proba_calibrated(spark, d):
    """Class probabilities of a one-vs-rest margin classifier on every order."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.month("o_orderdate").cast("double").alias("month"), "o_orderstatus")
    cfg = TrainConfig(task="classification", target="o_orderstatus", key="o_orderkey", features=["o_totalprice", "month"], models=["svm"],
                      overrides={"svm": {"kernel": "linear", "probability": True}}, experiment="orders_status_svm")
    res = train_many(spark, o, cfg)
    s = res.models["svm"].transform(o)
    return s.select("o_orderkey", "prediction", *[F.round(F.col("probability")[i], 6).alias(f"p_{i}") for i in range(3)])


@query("score_decoded")
def q_score_decoded(spark, d):
    """Multiclass model on a string target; codes decoded back to labels."""
    from quarry.operators.encode import decode_label

    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.month("o_orderdate").alias("month"),
                                         "o_orderstatus", "o_orderpriority")
    cfg = TrainConfig(task="classification", target="o_orderpriority", key="o_orderkey",
                      features=["o_totalprice", "month", "o_orderstatus"], models=["logistic_regression"],
                      overrides={"logistic_regression": {"max_iter": 100}}, experiment="orders_priority")
    res = train_many(spark, o, cfg)
    m = res.models["logistic_regression"]
    s = m.transform(res.prepared.where("split != 'train'")).withColumn("prediction_code", F.col("prediction").cast("int"))
    return decode_label(s, res.label_dictionary, "prediction_code", "prediction_label").select(
        "o_orderkey", "split", "prediction_code", "prediction_label", "decoding_failed")


@query("score_batch")
def q_score_batch(spark, d):
    from quarry.streaming.scoring import score_batch

    res, m = _quality_model(spark, d)
    return score_batch(m, quality_frame(spark, d), DOC_FEATURES, keep=["doc_id"]).select("doc_id", "prediction")


@query("score_stream", headline=True)
def q_score_stream(spark, d):
    """Events arrive as files; a Structured Streaming query scores each
    micro-batch with an isolation forest fitted on the events table and
    writes predictions, errors and one progress row per batch."""
    from quarry.models.anomaly import fit_isolation_forest
    from quarry.streaming.scoring import score_stream

    ev = events_frame(spark, d)
    feats = ["value", "props_k", "hour"]
    model = fit_isolation_forest(ev, feats, "event_id", n_estimators=200)
    src = scratch_path(spark, "events_in")
    ev.repartition(4, "event_id").write.mode("overwrite").parquet(src)
    sink = scratch_path(spark, "events_scored")
    paths = score_stream(spark, model, src, ev.schema, feats, "event_id", sink, scratch_path(spark, "stream_ckpt"))
    return spark.read.parquet(paths["predictions"]).select("event_id", "batch_id", "score", "prediction")


@query("score_stream_once")
def q_score_stream_once(spark, d):
    """The events arrive as files, and every third one a second time in a later file; each is scored once."""
    from quarry.models.anomaly import fit_isolation_forest
    from quarry.streaming.scoring import score_stream

    ev = events_frame(spark, d)
    feats = ["value", "props_k", "hour"]
    model = fit_isolation_forest(ev, feats, "event_id", n_estimators=50)
    src = scratch_path(spark, "events_in")
    ev.repartition(2, "event_id").write.mode("overwrite").parquet(src)
    ev.filter("event_id % 3 = 0").coalesce(1).write.mode("append").parquet(src)
    paths = score_stream(spark, model, src, ev.schema, feats, "event_id", scratch_path(spark, "events_scored"), scratch_path(spark, "stream_ckpt"), once=True)
    return spark.read.parquet(paths["predictions"]).select("event_id", "score", "prediction")


@query("write_schema", ORACLE["profile_numeric"])
def q_write_schema(spark, d):
    """Input schema document of lineitem's numeric columns (the numeric
    profile) written as JSON and read back."""
    from quarry.plans.queries_data import q_profile_numeric
    from quarry.sources.sinks import write_schema

    profile = q_profile_numeric(spark, d)
    path = scratch_path(spark, "schema")
    write_schema(profile, path)
    return spark.read.schema(profile.schema).json(path)
