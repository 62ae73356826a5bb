"""Positions: one second for all rows, a lone far key, null keys, groups."""
from pyspark.sql import functions as F

from quarry.functions.positions import ordered_positions
from quarry.models.clustering import CentroidModel
from quarry.operators.split import split_time
from quarry.streaming.scoring import score_chunks


def test_all_rows_in_one_second_and_an_outlier(spark):
    df = spark.range(0, 20_000).select(F.col("id").alias("k"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("t"))
    df = df.unionByName(spark.createDataFrame([(10**15, "2030-01-01")], "k long, s string").select("k", F.col("s").cast("timestamp").alias("t")))
    got = ordered_positions(df.repartition(7), [F.col("t"), F.col("k")], "p", size="n").collect()
    assert {r["k"]: r["p"] for r in got} == {**{i: i for i in range(20_000)}, 10**15: 20_000} and {r["n"] for r in got} == {20_001}
    counts = {r["split"]: r["count"] for r in split_time(df, "t", "k").groupBy("split").count().collect()}
    assert counts == {"train": 14000, "val": 2000, "test": 4001}


def test_groups(spark):
    df = spark.range(0, 3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 2990, "b").alias("g"))
    got = ordered_positions(df, [F.col("id").desc()], "p", F.coalesce("g", F.lit("none")), "n").collect()
    want = {}
    for r in sorted(got, key=lambda r: -r["id"]):
        assert r["p"] == want.get(r["g"], 0)
        want[r["g"]] = r["p"] + 1
    assert all(r["n"] == want[r["g"]] for r in got)
    assert ordered_positions(df.limit(0), [F.col("id")], "p", F.col("g"), "n").count() == 0


def test_records_without_key_are_dead_letters(spark):
    rows = [(1, 1.0), (None, 2.0), (None, 2.0), (3, None), (10**15, 4.0)]
    df = spark.createDataFrame(rows, "key long, x double")
    scored, chunks, errors = score_chunks(CentroidModel(["x"], [[0.0], [5.0]]), df, "key", ["x"], chunk_size=2)
    assert sorted(r["key"] for r in scored.collect()) == [1, 10**15] and errors.count() == 3
    c = sorted(chunks.collect(), key=lambda r: r["batch_index"])
    assert [r["batch_size"] for r in c] == [2, 2, 1] and c[-1]["progress"] == 100.0 and {r["total"] for r in c} == {5}
    assert sum(r["n_ok"] + r["n_failed"] for r in c) == 5
