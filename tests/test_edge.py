"""Hand-made frames of FIXTURES §3 not covered elsewhere: runs_small,
bad_records, tiny_anom, tiny_series."""
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import metrics as M
from quarry.operators.selection import best_run, leaderboard
from quarry.operators.sequence import lag_features
from quarry.sources.readers import read_records
from quarry.streaming.scoring import dead_letter, score


def test_runs_small_ties_and_null_score(spark):
    runs = spark.createDataFrame(
        [("e", "b", 1, 0.9), ("e", "a", 0, 0.9), ("e", "c", 2, None), ("f", "x", 0, None)],
        "experiment string, model string, model_order int, score double")
    ranked = {(r["experiment"], r["model"]): r["rank"] for r in leaderboard(runs, "score").collect()}
    assert ranked[("e", "a")] == 1 and ranked[("e", "b")] == 2 and ranked[("e", "c")] == 3
    assert {r["model"] for r in best_run(runs, "score").collect()} == {"a", "x"}


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()),
                       T.StructField("z", T.DoubleType())])


def test_bad_records(spark):
    recs = spark.createDataFrame([('{"id": 1, "x": 1.5, "z": 2.0, "extra": 9}',), ('{"id": 2, "x": "oops", "z": 1.0}',),
                                  ('{"id": 3, "z": 1.0}',), ('not json',)], "record string")
    parsed = read_records(recs, "record", SCHEMA)
    assert "extra" not in parsed.columns
    ok, errors = dead_letter(parsed, ["x", "z"], "id")
    assert [r["id"] for r in ok.collect()] == [1]
    reasons = {r["id"]: r["reason"] for r in errors.collect()}
    assert reasons[2] == "malformed record"  # wrong type
    assert reasons[3] == "missing features: x"
    assert reasons[None] == "malformed record"


def test_empty_batch_rejected(spark):
    empty = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        score(None, empty, ["x", "z"])


@pytest.mark.parametrize("y", [0, 1])
def test_tiny_anom_single_class(spark, y):
    df = spark.createDataFrame([(i, y, -1 if i % 2 else 1) for i in range(6)], "id long, y int, raw int")
    r = M.anomaly_metrics(df.withColumn("p", M.anomaly_map("raw")), "y", "p").first()
    assert r["roc_auc"] == 0.0
    assert r["true_positives"] + r["false_positives"] + r["true_negatives"] + r["false_negatives"] == 6


def test_tiny_series_duplicate_times_are_ordered_by_key(spark):
    df = spark.createDataFrame([(i, "2024-01-01 00:00:00" if i < 3 else f"2024-01-01 00:0{i}:00", float(i)) for i in range(6)],
                               "id long, t string, x double").withColumn("t", F.to_timestamp("t"))
    out = lag_features(df, ["x"], "x", "t", "id", None, lookback=2, horizon=1)
    got = sorted((r["id"], r["x_lag_2"], r["x_lag_1"]) for r in out.collect())
    assert got == [(2, 0.0, 1.0), (3, 1.0, 2.0), (4, 2.0, 3.0), (5, 3.0, 4.0)]


def test_no_validation_split(spark):
    from quarry.operators.split import split_random

    s = split_random(spark.range(0, 50), "id", val=0.0)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"test": 10, "train": 40}
