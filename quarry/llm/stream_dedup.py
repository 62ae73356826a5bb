"""Exact dedup by a stateful stream.

Files of a Parquet folder arrive as a stream (at most ``BYTES_PER_BATCH`` a
micro-batch). The state is keyed by the digest of the text, lives on disk
(RocksDB, its changes in the shared checkpoint folder), never expires, and
retains the largest identifier with the content locator of its row (file and
row number) and the number of rows. A stream started again on the same state
folder goes on after the files it has read, so later files meet all earlier ones.

Hits are digests of several rows. Their whole texts are read again and grouped by
digest and text, which compares full bytes; texts of equal digest and
different bytes are groups of their own, found by a second join on the text. The
digest is SHA-256 unless the caller gives another expression.

Skew: state and groups are aggregates with map-side combine, so a text that a third
of all rows share is one row a task. Digests with more than 1/1024 of the
rows are fewer than 1024 and are broadcast; the others are joined by a shuffle. Texts
move only in the check of hits.

Rows: texts are equal when identical, a null text counts as empty; of equal
texts the largest doc_id stays, a null doc_id only if no row has one; of rows
equal in both, one stays (the last by file and row number). An empty table or folder
gives no rows. Only built-in functions are used. ``dedup`` returns the
columns of its frame whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import HOT_SHARE, fresh, lookup, saved
from quarry.session import scratch_path

BYTES_PER_BATCH = str(1 << 40)
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # one bound for all state partitions of an executor
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # files as large as what they hold, however many state partitions there are
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _located(df: DataFrame, digest: Digest, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, digest, file, row) of a batch or streaming Parquet frame."""
    at = df.metadataColumn("_metadata")
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), whole.alias("text"), digest(whole).alias("digest"),
                     at["file_path"].alias("file"), at["row_index"].alias("row"))


def _kept() -> list[Column]:
    """Of a group of rows: the one that stays, and their number."""
    return [F.max(F.struct("doc_id", "file", "row")).alias("kept"), F.count(F.lit(1)).alias("n")]


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def absorb(spark: SparkSession, path: str, schema: StructType, state: str, digest: Digest = sha256,
           options: dict[str, str] | None = None) -> None:
    """Stream the files below ``path`` that the state folder has not seen."""
    # the last character as a pattern: a single file is a source, too
    path = path.rstrip("/")
    source = f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(schema).options(**(options or {"maxBytesPerTrigger": BYTES_PER_BATCH})).parquet(source)
    groups = _located(stream, digest).drop("text").groupBy("digest").agg(*_kept())
    with _state_store(spark):
        q = (groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", state)
             .trigger(availableNow=True).start())
        try:
            q.awaitTermination()
        finally:
            q.stop()


def seen(spark: SparkSession, state: str) -> DataFrame:
    """``digest, kept, n`` of every digest in the state."""
    with _state_store(spark):
        s = spark.read.format("statestore").load(state)
        return s.select("key.digest", F.col("value.max").alias("kept"), F.col("value.count").alias("n"))


def _same_bytes(docs: DataFrame, hits: DataFrame, total: int) -> DataFrame:
    """``digest, text, kept, n`` of the texts whose digest is a hit."""
    least = int(total * HOT_SHARE)
    hot = docs.join(F.broadcast(hits.filter(F.col("n") > least).select("digest")), "digest", "left_semi")
    # always a shuffle: the hits grow with the data
    rest = docs.join(hits.filter(F.col("n") <= least).select("digest").hint("merge"), "digest", "left_semi")
    return hot.groupBy("digest", "text").agg(*_kept()).unionByName(rest.groupBy("digest", "text").agg(*_kept()))


def groups_of(docs: DataFrame, state_rows: DataFrame) -> DataFrame:
    """``doc_id, file, row, digest, kept, n`` for every row of ``docs`` (located
    rows that the state has seen)."""
    rows = saved(docs.drop("text"), "rows")
    total = rows.count()
    hits = saved(state_rows.filter("n > 1"), "hits")
    groups = saved(_same_bytes(docs, hits, total).drop("text"), "groups")
    mixed = saved(groups.groupBy("digest").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "mixed")
    plain = groups.join(mixed.select("digest"), "digest", "left_anti")
    out = lookup(rows, plain, ["digest"], "n", total)
    if not mixed.isEmpty():  # one digest, several texts: these rows meet their group by the text
        texts = _same_bytes(docs, mixed, total).withColumn("at", F.sha2("text", 512))
        exact = docs.join(mixed.select("digest"), "digest", "left_semi")
        exact = saved(exact.withColumn("at", F.sha2("text", 512)).join(texts.select("digest", "text", "at", "kept", "n"), ["digest", "at", "text"])
                      .select("doc_id", "file", "row", "digest", "kept", "n"), "mixed-rows")
        out = out.join(mixed.select("digest"), "digest", "left_anti").unionByName(exact)
    alone = F.struct("doc_id", "file", "row")
    return out.select("doc_id", "file", "row", "digest", F.coalesce("kept", alone).alias("kept"), F.coalesce("n", F.lit(1)).cast("long").alias("n"))


def duplicates(spark: SparkSession, path: str, state: str | None = None, digest: Digest = sha256,
               options: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, file, row, digest, kept, n`` of every row of the Parquet files
    at ``path``. With the ``state`` of an earlier run, only new files are streamed."""
    batch = spark.read.parquet(path)
    docs = _located(batch, digest)
    if batch.isEmpty():
        return docs.select("doc_id", "file", "row", "digest", F.struct("doc_id", "file", "row").alias("kept"), F.lit(1).cast("long").alias("n"))
    state = state or scratch_path(spark, "dedup-state")
    absorb(spark, path, batch.schema, state, digest, options)
    return groups_of(docs, seen(spark, state))


def stays() -> Column:
    """Whether the row is the one of its group that stays."""
    return (F.col("file") == F.col("kept.file")) & (F.col("row") == F.col("kept.row"))


def report(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row."""
    found = duplicates(spark, path)
    return found.select("doc_id", F.col("kept.doc_id").alias("keep_id"), F.col("n").alias("group_size"), stays().alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that stay, with its columns."""
    spark, names = df.sparkSession, df.columns
    path = scratch_path(spark, "dedup-input")
    df.write.parquet(path)
    gone = duplicates(spark, path).filter(~stays())
    docs = spark.read.schema(df.schema).parquet(path)
    file, row = fresh(docs, "file", "row")
    at = docs.metadataColumn("_metadata")
    docs = docs.select(*[F.col(f"`{c}`") for c in names], at["file_path"].alias(file), at["row_index"].alias(row))
    gone = gone.select(F.col("file").alias(file), F.col("row").alias(row))
    return docs.join(gone, [file, row], "left_anti").select(*[F.col(f"`{c}`") for c in names])


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
