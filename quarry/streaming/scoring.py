"""Scoring — batch, chunked and streaming (§2.11).

* ``score`` / ``score_batch``: align to the trained features, transform;
  no record cap (the reference's 10,000-row limit was a memory guard).
* ``dead_letter``: records that miss a trained feature (or do not parse) go
  to an error table with the reason; the rest are scored. This is per row,
  where the reference failed a whole chunk.
* ``score_chunks``: chunk = (position in key order) div chunk_size, with a
  per-chunk progress table (batch_size, ok, failed, processed, progress).
  Positions come from one range partitioning and prefix sums are two-level,
  so no step sorts all rows or all chunks in one task. A record without a
  key is a dead letter and counts in its chunk.
* ``score_stream``: Structured Streaming from a file source; each micro-batch
  is read once, scored and stored by ``foreachBatch`` (one folder per batch
  id, overwritten => replays are idempotent) plus one progress row per batch;
  ``stream_progress`` sums them up, also while the stream runs. With ``once``, a
  record whose key an earlier batch had is dropped: the keys are streaming state on
  disk (RocksDB, kept in the checkpoint folder), for ever or as long as a
  watermark says.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.columns import bounded_broadcast
from quarry.functions.positions import ordered_positions
from quarry.operators.encode import decode_label
from quarry.operators.select import align_scoring_schema

DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streaming state that starts inside is kept on disk."""
    before = {k: spark.conf.get(k, None) for k in DISK_STATE}
    for k, v in DISK_STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def first_of_each_key(stream: DataFrame, key: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """The first record of every key, over all batches; every record without a
    key. ``watermark`` (time column, delay): a key is forgotten after that time."""
    at = stream.metadataColumn("_metadata")
    # records without a key differ by their place in the source
    place = F.when(F.col(key).isNull(), F.concat(at["file_path"], F.lit(":"), at["row_index"].cast("string")))
    marked = stream.select("*", place.alias("__place"))
    if watermark is None:
        return marked.dropDuplicates([key, "__place"]).drop("__place")
    return marked.withWatermark(*watermark).dropDuplicatesWithinWatermark([key, "__place"]).drop("__place")


def score(model, df: DataFrame, feature_names: list[str] | None, keep: list[str] | tuple = ()) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no records to score")
    return model.transform(align_scoring_schema(df, feature_names, keep))


def score_batch(model, df: DataFrame, feature_names: list[str] | None, keep: list[str] | tuple = (),
                dictionary: DataFrame | None = None) -> DataFrame:
    """Score every record; with a label ``dictionary`` the predicted code is
    kept as ``prediction_code`` and decoded to ``prediction_label``."""
    out = model.transform(align_scoring_schema(df, feature_names, keep))
    if dictionary is None:
        return out
    return decode_label(out.withColumn("prediction_code", F.col("prediction").cast("int")), dictionary, "prediction_code", "prediction_label")


def validity(df: DataFrame, feature_names: list[str]) -> DataFrame:
    """Adds ``_missing`` (array of absent/null trained features)."""
    missing = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in feature_names]), lambda x: x.isNotNull()
    )
    return df.withColumn("_missing", missing)


def _bad(df: DataFrame, key: str) -> F.Column:
    """A row fails when a trained feature or the key is missing or the record
    is malformed."""
    bad = (F.size("_missing") > 0) | F.col(key).isNull()
    if "_corrupt" in df.columns:
        bad = bad | F.col("_corrupt").isNotNull()
    return bad


def dead_letter(df: DataFrame, feature_names: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, error rows ``(key, reason)``)."""
    v = validity(df, feature_names)
    bad = _bad(df, key)
    ok = v.where(~bad).drop("_missing")
    reason = F.when(F.size("_missing") > 0, F.concat(F.lit("missing features: "), F.array_join("_missing", ", ")))
    reason = F.coalesce(reason, F.lit("missing key"))
    if "_corrupt" in df.columns:
        reason = F.when(F.col("_corrupt").isNotNull(), F.lit("malformed record")).otherwise(reason)
    errors = v.where(bad).select(key, reason.alias("reason"))
    return ok, errors


def key_position(df: DataFrame, key: str) -> DataFrame:
    """0-based position in ascending key order. Records without a key come
    first, ordered by a hash of the whole record, so every record has a
    position."""
    content = F.xxhash64(*[F.to_json(F.struct(*[F.col(c) for c in df.columns]))])
    return ordered_positions(df, [F.col(key).asc_nulls_first(), content], "position")


def prefix_sum(df: DataFrame, order_col: str, value_col: str, out: str, inclusive: bool = True,
               block: int = 4096) -> DataFrame:
    """Running sum over an integer-ordered table in two levels: totals per
    block of ``block`` consecutive order values (small), their running sum,
    then a running sum inside each block."""
    x = df.withColumn("__blk", F.floor(F.col(order_col) / block))
    tot = x.groupBy("__blk").agg(F.sum(value_col).alias("__bt"))
    wb = Window.partitionBy(F.lit(0)).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("__boff", F.coalesce(F.sum("__bt").over(wb), F.lit(0)))
    w = Window.partitionBy("__blk").orderBy(order_col).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    y = x.join(bounded_broadcast(tot.select("__blk", "__boff")), "__blk")
    return y.withColumn(out, (F.coalesce(F.sum(value_col).over(w), F.lit(0)) + F.col("__boff")).cast("bigint")).drop(
        "__blk", "__boff")


def score_chunks(model, records: DataFrame, key: str, feature_names: list[str], chunk_size: int = 1000):
    """Returns (scored rows with ``batch_index``, per-chunk progress table)."""
    pos = key_position(records, key)  # written once, so the passes below read it and not their source
    pos = pos.withColumn("batch_index", F.floor(F.col("position") / chunk_size).cast("bigint"))
    ok, errors = dead_letter(pos, feature_names, key)
    scored = model.transform(ok)
    flags = validity(pos, feature_names).select("batch_index", (~_bad(pos, key)).alias("_ok"))
    chunks = flags.groupBy("batch_index").agg(
        F.count(F.lit(1)).alias("batch_size"), F.count_if("_ok").alias("n_ok"), F.count_if(~F.col("_ok")).alias("n_failed"))
    done = scored.groupBy("batch_index").agg(F.count_if(F.col("prediction").isNotNull()).alias("n_scored"))
    chunks = chunks.join(done, "batch_index", "left").withColumn("n_scored", F.coalesce("n_scored", F.lit(0)).cast("bigint"))
    chunks = prefix_sum(chunks, "batch_index", "n_ok", "processed")
    chunks = prefix_sum(chunks, "batch_index", "batch_size", "__handled")
    total = int(pos.agg(F.count(F.lit(1))).first()[0])
    chunks = chunks.withColumn("total", F.lit(total).cast("bigint")).withColumn(
        "progress", F.least(F.lit(100.0), F.col("__handled") * 100.0 / F.lit(float(max(total, 1))))).drop("__handled")
    return scored, chunks, errors


def score_stream(spark: SparkSession, model, source_dir: str, schema, feature_names: list[str], key: str,
                 sink_dir: str, checkpoint_dir: str, max_files_per_trigger: int = 1, dictionary: DataFrame | None = None,
                 once: bool = False, watermark: tuple[str, str] | None = None) -> dict:
    """Score files as they arrive; run with ``availableNow`` (processes what
    is there, then stops). With a label ``dictionary`` the predicted codes
    are decoded too. With ``once`` a record that repeats a key counts nowhere
    (``first_of_each_key``). Returns the sink paths."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    pred_path, prog_path, err_path = f"{sink_dir}/predictions", f"{sink_dir}/progress", f"{sink_dir}/errors"

    def write(df: DataFrame, path: str, batch_id: int) -> None:
        """Replace this batch's folder, also by nothing, so a replay leaves
        exactly its own rows."""
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        # kept while the batch lasts: its source is read by one job only
        records = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            stored(records, batch_id)
        finally:
            records.unpersist()

    def stored(records: DataFrame, batch_id: int) -> None:
        ok, errors = dead_letter(records, feature_names, key)
        scored = model.transform(align_scoring_schema(ok, feature_names, keep=[key]))
        if dictionary is not None:
            scored = decode_label(scored.withColumn("prediction_code", F.col("prediction").cast("int")), dictionary,
                                  "prediction_code", "prediction_label")
        write(scored, pred_path, batch_id)
        write(errors, err_path, batch_id)
        n = validity(records, feature_names).agg(
            F.count(F.lit(1)).alias("batch_size"), F.coalesce(F.sum(_bad(records, key).cast("long")), F.lit(0)).alias("n_failed"))
        write(n, prog_path, batch_id)

    if once:
        stream = first_of_each_key(stream, key, watermark)
    with disk_state(spark):
        q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_dir)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return {"predictions": pred_path, "progress": prog_path, "errors": err_path}


def stream_progress(spark: SparkSession, progress_path: str, total: int | None = None) -> DataFrame:
    """Running progress, one row per micro-batch: ``batch_size, n_failed,
    processed`` (records so far), ``total`` and ``progress`` in percent;
    ``total`` defaults to the records seen."""
    p = spark.read.parquet(progress_path)
    run = F.sum("batch_size").over(Window.orderBy("batch_id"))  # one row per micro-batch
    t = F.lit(total).cast("bigint") if total is not None else F.sum("batch_size").over(Window.partitionBy())
    p = p.select("batch_id", "batch_size", "n_failed", run.alias("processed"), t.alias("total"))
    return p.withColumn("progress", F.when(F.col("total") > 0, F.least(F.lit(100.0), F.col("processed") * 100.0 / F.col("total"))).otherwise(100.0))
