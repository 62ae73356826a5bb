"""Structured Streaming scoring: one micro-batch per file, every input row
scored once, dead letters separated, progress rows per batch, and a rerun
on the same checkpoint adds nothing."""
from pyspark.sql import functions as F

from quarry.models.clustering import CentroidModel
from quarry.streaming.scoring import score_chunks, score_stream, stream_progress


def test_score_stream_batches_and_replay(spark, tmp_path):
    df = spark.range(0, 300).select(F.col("id").alias("key"), (F.col("id") % 7).cast("double").alias("x"),
                                    F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.col("id") * 1.0).alias("y"))
    src = str(tmp_path / "in")
    df.repartition(3, "key").write.parquet(src)
    model = CentroidModel(["x", "y"], [[0.0, 0.0], [5.0, 200.0]])
    sink, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    paths = score_stream(spark, model, src, df.schema, ["x", "y"], "key", sink, ck)
    pred = spark.read.parquet(paths["predictions"])
    err = spark.read.parquet(paths["errors"])
    prog = spark.read.parquet(paths["progress"])
    assert pred.count() == 294 and err.count() == 6
    assert pred.select("key").distinct().count() == 294
    assert prog.count() == 3 and prog.agg(F.sum("batch_size")).first()[0] == 300
    score_stream(spark, model, src, df.schema, ["x", "y"], "key", sink, ck)  # nothing new to process
    assert spark.read.parquet(paths["predictions"]).count() == 294


def test_score_chunks_progress(spark):
    df = spark.range(0, 2500).select(F.col("id").alias("key"), (F.col("id") % 5).cast("double").alias("x"),
                                     F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.lit(1.0)).alias("y"))
    model = CentroidModel(["x", "y"], [[0.0, 1.0], [4.0, 1.0]])
    _, chunks, errors = score_chunks(model, df, "key", ["x", "y"], chunk_size=1000)
    rows = sorted(chunks.collect(), key=lambda r: r["batch_index"])
    assert [r["batch_size"] for r in rows] == [1000, 1000, 500]
    assert [r["processed"] for r in rows] == [900, 1800, 2250]
    assert rows[-1]["progress"] == 100.0 and errors.count() == 250


def test_repeated_records_count_once(spark, tmp_path):
    """Repeated in a later batch, in the same batch, after a restart, and replayed."""
    import os

    df = spark.range(0, 120).select(F.when(F.col("id") % 40 != 7, F.col("id")).alias("key"), (F.col("id") % 7).cast("double").alias("x"), F.lit(1.0).alias("y"))
    src, sink, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    df.unionByName(df.filter("key < 10")).repartition(2).write.parquet(src)
    model = CentroidModel(["x", "y"], [[0.0, 0.0], [5.0, 2.0]])
    args = (spark, model, src, df.schema, ["x", "y"], "key", sink, ck)
    paths = score_stream(*args, once=True)
    seen = spark.read.parquet(paths["predictions"])
    assert seen.count() == seen.select("key").distinct().count() == 117
    assert stream_progress(spark, paths["progress"]).agg(F.max("processed")).first()[0] == 120  # three records have no key
    assert spark.read.parquet(paths["errors"]).count() == 3
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    more = spark.range(100, 130).select("id", (F.col("id") % 7).cast("double").alias("x"), F.lit(1.0).alias("y")).withColumnRenamed("id", "key")
    more.coalesce(1).write.mode("append").parquet(src)
    score_stream(*args, once=True)
    seen = spark.read.parquet(paths["predictions"])
    assert seen.count() == seen.select("key").distinct().count() == 127 and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert stream_progress(spark, paths["progress"]).agg(F.max("processed")).first()[0] == 130
    # the last batch is done again, as after a crash before its commit
    last = max((f for f in os.listdir(f"{ck}/commits") if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        os.unlink(f"{ck}/commits/{f}")
    score_stream(*args, once=True)
    assert spark.read.parquet(paths["predictions"]).count() == 127
    assert stream_progress(spark, paths["progress"]).agg(F.max("processed")).first()[0] == 130
