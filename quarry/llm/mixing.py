"""Mixing sources to target weights.

Tokens are aggregated per source (map-side sums, one row per source leaves
each task, so a hot source costs no more than another). Sources, ordered by
code point with null last, weigh 1, 2, 3, 1, 2, ... by default and share all
tokens in proportion to their weights. No source is repeated more than
``max_rate`` times: a target stops there and the excess is shared again by
weight among the others, until none is above. A round of that is one aggregate
over the table of sources; each round either caps a further source or is the
last.

Repetition rate = target / tokens of the source. A document is emitted
floor(rate) times, plus one copy when a hash of (seed, doc_id; the text where
doc_id is null) as a uniform number is below the fraction of the rate (a Bernoulli draw that any
rerun and any partitioning repeats).

Rows: a null or empty text has size 0; a null source is a source; rows that
repeat a document draw alike; a source without tokens has target 0, rate 0 and
emits nothing; an empty table gives an empty result. Columns of the
input are kept by ``mix``; ``mix_plan`` returns its own names only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import fresh, saved

WORD = "[^\\x20\\x09-\\x0D]+"
MAX_RATE = 3
SEED = 11
DRAWS = 2.0**52


def size_of(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, text: Column, seed: int) -> Column:
    """Uniform in [0, 1) from the first 13 hex digits of an md5."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.md5(F.coalesce(text, F.lit(""))))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(DRAWS)


def source_targets(sizes: DataFrame, weights: dict[str | None, float] | None = None, max_rate: int = MAX_RATE) -> DataFrame:
    """``source, source_size, weight, target`` from rows of (source, size).
    ``weights``: by source, default the repeating 1, 2, 3."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    if weights is None:
        # one row per source: its place among the sources sets its weight
        place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
        per = per.withColumn("weight", ((place - 1) % 3 + 1).cast("double"))
    else:
        w = F.lit(0.0)
        for s, x in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(s)), float(x)).otherwise(w)
        per = per.withColumn("weight", w)
    per = saved(per, "sources")
    cap = F.col("source_size") * F.lit(max_rate)
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    level = None  # tokens per unit of weight for the sources below their cap
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= cap
        r = per.agg(F.sum(F.when(capped, cap)).alias("spent"), F.sum(F.when(~capped, F.col("weight"))).alias("w"),
                    F.sum(capped.cast("int")).alias("n")).first()
        if not r["w"]:
            break
        new = (total - (r["spent"] or 0)) / r["w"]
        if level is not None and new <= level:
            break
        level = new
    target = cap.cast("double") if level is None else F.least(cap.cast("double"), F.col("weight") * F.lit(level))
    return per.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(df: DataFrame, weights: dict | None = None, max_rate: int = MAX_RATE, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target,
    copies, taken`` (taken = size x copies)."""
    docs = df.select("doc_id", "source", size_of(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("u"))
    docs = saved(docs, "sizes")
    targets = source_targets(docs, weights, max_rate)
    # a row per source; its key never meets more than one row on this side
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = (F.floor(rate) + (F.col("u") < rate - F.floor(rate)).cast("long")).cast("long")
    both = docs.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix(df: DataFrame, weights: dict | None = None, max_rate: int = MAX_RATE, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every row of ``df`` as many times as its copies say,
    same columns."""
    sizes = df.select("source", size_of(F.col("text")).alias("size"))
    t = source_targets(sizes, weights, max_rate)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    of, share, n, copy = fresh(df, "of", "rate", "copies", "copy")
    t = t.select(F.col("source").alias(of), rate.alias(share))
    copies = F.floor(share) + (draw(F.col("doc_id"), F.col("text"), seed) < F.col(share) - F.floor(share)).cast("long")
    both = df.join(t, F.col("source").eqNullSafe(F.col(of))).withColumn(n, copies.cast("int")).filter(F.col(n) > 0)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in df.columns])


#: The same mix in DuckDB. Water filling in closed form: sources by rising cap
#: per weight, cap while the level that the others then get is not below.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE / {DRAWS:.1f} AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
o AS (SELECT *, sum({MAX_RATE} * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS spent,
             sum(weight) OVER () - sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS rest,
             sum(source_size) OVER () AS total FROM w),
l AS (SELECT max(level) AS level FROM (
        SELECT (total - spent) / rest AS level FROM o WHERE rest > 0 AND (total - spent) / rest >= 0
          AND {MAX_RATE} * source_size <= weight * (total - spent + {MAX_RATE} * source_size) / (rest + weight)
        UNION ALL SELECT (SELECT sum(source_size) FROM w) / (SELECT sum(weight) FROM w))),
t AS (SELECT source, source_size, least({MAX_RATE}.0 * source_size, weight * (SELECT level FROM l)) AS target FROM w),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, round(r.target, 6) AS target, d.size * (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
