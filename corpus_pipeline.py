"""From raw documents to encoded training text, in five stages.

quality classifier -> line dedup -> MinHash near-dedup -> mixing sources to
target weights -> BPE encoding and decoding. Each stage takes (spark, docs,
sf_dir), works on all rows its predecessor kept, and returns a DataFrame; the
result is written as Parquet into the shared checkpoint folder and read again as the
next stage's docs. All but the last return the columns of documents.

SQL cannot express the stages (kernel classifier, rolling hashes, ProbMinHash,
BPE), so there is no oracle SQL; tests/llm/test_pipeline.py tests the
stages against plain versions on a small fixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import line_chunks, mixing, prefix_bpe, prob_minhash, quality
from quarry.llm.common import saved, table
from quarry.llm.queries import vocabulary


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where the table has it."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.char_length("text").cast(kind)).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without line chunks that an earlier document holds."""
    return _counted(line_chunks.dedup(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return prob_minhash.distinct_documents(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources say."""
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, digest of the decoded text."""
    return prefix_bpe.round_trip(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mix", mix_stage), ("bpe", bpe_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
