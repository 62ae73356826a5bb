"""Registered queries of the training-data operators. Each ``opN_`` query
applies its operator with production parameters to the whole table and
derives the digest columns from the operator's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.llm import fill_in_middle, learned_partitions, license_scan, line_chunks, mixing, prefix_trie, prob_minhash, quality, stream_dedup, syncmers, toxicity
from quarry.llm.common import table
from quarry.llm.elias_fano import token_files
from quarry.llm.prefix_bpe import round_trip

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: where the public vocabulary files are; a deployment may point elsewhere
TOKENIZER_FOLDER: str | None = None


def vocabulary(name: str) -> str:
    if TOKENIZER_FOLDER:
        return f"{TOKENIZER_FOLDER.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn

    return register


@query("op1_learned_partitions")
def op1(spark, d):
    """20 nearest of every 20th vector by inner product."""
    return learned_partitions.search(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op2_license_scan", license_scan.oracle_sql())
def op2(spark, d):
    """Licence phrases and labels of every document."""
    return license_scan.scan(table(spark, d, "documents"))


@query("op3_mix_sources", mixing.ORACLE)
def op3(spark, d):
    """Mix all documents to the sources' target weights."""
    plan = mixing.mix_plan(table(spark, d, "documents"))
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op4_syncmer_fingerprints")
def op4(spark, d):
    """Fingerprints of every document and of its edited text."""
    return syncmers.fingerprints(table(spark, d, "documents"))


@query("op5_quality")
def op5(spark, d):
    """Quality score of every document."""
    return quality.score_documents(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op6_toxicity")
def op6(spark, d):
    """Toxicity score of every document."""
    return toxicity.score_documents(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op7_prob_minhash")
def op7(spark, d):
    """Near-duplicate class of every document."""
    return prob_minhash.near_duplicates(table(spark, d, "documents"))


@query("op8_prefix_bpe")
def op8(spark, d):
    """Byte-level BPE ids and decoded text of every document."""
    return round_trip(table(spark, d, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op9_elias_fano_ids")
def op9(spark, d):
    """Token-id files with Elias-Fano boundaries, reported from the files."""
    return token_files(table(spark, d, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


@query("op10_line_chunks")
def op10(spark, d):
    """Repeated line chunks of every document."""
    return line_chunks.report(table(spark, d, "documents"))


@query("op11_prefix_trie", prefix_trie.ORACLE)
def op11(spark, d):
    """Prefix trie of the rebuilt conversations with subtree rollups."""
    return prefix_trie.rebuilt_trie(table(spark, d, "conversations"))


@query("op12_fill_in_middle", fill_in_middle.ORACLE)
def op12(spark, d):
    """Fill-in-middle form of every document."""
    return fill_in_middle.report(table(spark, d, "documents"))


@query("op13_stream_dedup", stream_dedup.ORACLE)
def op13(spark, d):
    """Exact copies of every document."""
    return stream_dedup.report(spark, f"{d.rstrip('/')}/documents.parquet")
