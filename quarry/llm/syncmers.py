"""Document fingerprints from closed syncmers.

Units are the words of a text; a k-mer is ``K`` consecutive words, an inner
s-mer ``S`` consecutive ones. A k-mer is chosen when its s-mer of smallest
hash stands first or last in it. The choice depends on the k-mer alone, not on
what is around it, so an unchanged passage keeps all its anchors wherever it
moves, and two neighbouring anchors are never far apart. The text is closed
with ``K - 1`` empty words, so that the shortest text has an anchor.

``anchors`` gives (position, hash) pairs for positional matching. The
fingerprint string is the ``SKETCH`` smallest distinct anchor hashes, eight
hex digits each, ascending; the likeness of two fingerprints is the share of the
smallest hashes of both together that both hold (an estimate of the
Jaccard similarity of the anchor sets; 1 for two empty ones).

Built-in functions only. ``with_next`` pairs every document with the next one
in descending doc_id: buckets of consecutive ids from quantiles, the first
row of each bucket repeated at the end of the one before, and a window per
bucket - one exchange, no global sort.

Rows: a null text counts as empty; a text without words has the empty
fingerprint; null doc_ids come last, equal doc_ids are ordered by a hash of
their text; the only row of a table is its own next; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 4
S = 2
SKETCH = 64


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, "\\s+"), "")


def _chosen(text: Column, make) -> Column:
    """An array of make(position, s-mer hashes) over the closed syncmers."""
    last = K - S
    pad = F.array_repeat(F.lit(0).cast("long"), K - 1)

    def of_words(w):
        h = F.concat(F.transform(w, lambda x: F.xxhash64(x)), pad)
        return let(h, lambda hs: of_hashes(hs, F.size(w)))

    def of_hashes(hs, n):
        g = F.zip_with(hs, F.slice(hs, 2, F.size(hs) - 1), lambda a, b: F.xxhash64(a, b))
        return let(g, lambda gs: F.transform(F.filter(places(n), lambda i: edge(gs, i)), lambda i: make(i, gs)))

    def places(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def edge(gs, i):
        inner = [F.get(gs, i + j) for j in range(1, last)]
        return F.least(F.get(gs, i), F.get(gs, i + last)) <= (F.least(*inner) if len(inner) > 1 else inner[0])

    return let(words(text), of_words)


def _hash(i: Column, gs: Column) -> Column:
    """32 bits of the k-mer, from s-mers that together cover its words."""
    return F.shiftrightunsigned(F.xxhash64(*[F.get(gs, i + j) for j in range(0, K - S + 1, S)]), 32)


def anchors(text: Column) -> Column:
    """array<struct<position, hash>> of the closed syncmers of a text."""
    return _chosen(F.coalesce(text, F.lit("")), lambda i, gs: F.struct(i.alias("position"), _hash(i, gs).alias("hash")))


def sketch(text: Column) -> Column:
    """The smallest distinct anchor hashes, ascending."""
    return F.slice(F.array_sort(F.array_distinct(_chosen(F.coalesce(text, F.lit("")), _hash))), 1, SKETCH)


def fingerprint(sk: Column) -> Column:
    return F.array_join(F.transform(sk, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Of two sketches, 0 to 1."""
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    common = F.size(F.array_intersect(F.array_intersect(a, b), both)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        common / F.greatest(F.size(both), F.lit(1)))


def with_next(rows: DataFrame, carried: list[str], key: str = "doc_id") -> DataFrame:
    """``rows`` with ``next_<c>`` of each carried column, from the next row in
    descending key order (after the last: the first)."""
    spark = rows.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"]
    cuts = F.array(*[F.lit(int(c)).cast("long") for c in sorted(set(cuts or []))])  # at most 4 x partitions
    k = F.col(key)
    bucket = F.when(k.isNull(), -1).otherwise(F.size(F.filter(cuts.cast("array<long>"), lambda c: c < k)))
    tie = F.xxhash64(*carried)
    rows = rows.withColumn("__b", bucket).withColumn("__h", tie)
    # the first row of each bucket: largest key, then smallest hash
    tops = rows.groupBy("__b").agg(F.max(F.struct(k.alias("k"), F.bitwise_not("__h").alias("h"))).alias("m")).collect()
    order = sorted((r["__b"] for r in tops), reverse=True)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    found = spark.createDataFrame([(r["__b"], r["m"]["k"], ~r["m"]["h"], before[r["__b"]]) for r in tops],
                                  "tb int, tk long, th long, into int")
    # as many rows as buckets, so the small side is bounded
    heads = rows.join(F.broadcast(found), (F.col("__b") == F.col("tb")) & k.eqNullSafe(F.col("tk")) & (F.col("__h") == F.col("th")), "left_semi")
    to = F.create_map(*[x for b in order for x in (F.lit(b), F.lit(before[b]))]) if order else F.create_map(F.lit(0), F.lit(0))
    heads = heads.dropDuplicates(["__b"]).withColumn("__b", to[F.col("__b")])
    both = rows.withColumn("__end", F.lit(False)).unionByName(heads.withColumn("__end", F.lit(True)))
    w = W.partitionBy("__b").orderBy(F.col("__end"), k.desc_nulls_last(), "__h")
    for c in carried:
        both = both.withColumn(f"next_{c}", F.lead(c).over(w))
    return both.filter(~F.col("__end")).drop("__b", "__h", "__end")


def edited(text: Column, n: Column, following: Column) -> Column:
    """The text whose last half is replaced by the start of the next one."""
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - half).cast("int")), F.substring(following, F.lit(1), half))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next`` of every row."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    pairs = with_next(rows, ["t"])
    n = F.char_length("t").cast("long")
    pairs = pairs.select("doc_id", n.alias("n_chars"), sketch(F.col("t")).alias("a"), sketch(F.col("next_t")).alias("c"),
                         edited(F.col("t"), n, F.col("next_t")).alias("e"))
    pairs = pairs.select("doc_id", "n_chars", "a", "c", F.sha2("e", 256).alias("edited_sha256"), sketch(F.col("e")).alias("b"))
    return pairs.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"),
                        fingerprint(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"),
                        likeness(F.col("a"), F.col("c")).alias("near_next"))
