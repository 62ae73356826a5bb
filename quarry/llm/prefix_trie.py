"""Prefix trie of conversations with subtree rollups.

1. Turns are put in order once per conversation (null turn first, then turn, ties
   by the SHA-256 of length, role and text) by one range partitioning; texts are
   reduced to that digest and their word count before anything moves.
2. A prefix is named by the sum, modulo 2^128 in four parts, of the hashes of (place,
   turn digest) of its turns. Sums are prefix sums in two levels (blocks of
   ``BLOCK`` turns), so a conversation of any length is spread over tasks.
3. One aggregate by prefix gives the nodes with their smallest member; a node is
   (smallest member, depth) from then on. All nodes with one smallest
   member are a chain, so the parent edges of chains are a forest over conversations.
4. The chains' totals come from the centroid decomposition of that forest
   (``centroid_rollup``); a node's own total is the suffix sum of its chain, in
   two levels again, with the totals of the chains attached below.

Skew: a system prompt that a third of all conversations share is a hot prefix: nodes
are aggregates with map-side combine, and nodes with very many children or
identical conversations are looked up by a broadcast of the fewer than 1024
hot keys. The list of the members that end at a node is formatted in portions of
at most ``IDS_PER_PART`` identifiers and hashed as a stream.

Rows: a null role or text is empty; rows without conv_id take no part; a
repeated row is a turn as often as it stands; a conversation without turns ends at the
root; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.positions import ordered_positions
from quarry.llm.centroid_rollup import LOCAL_NODES, rollup
from quarry.llm.common import column_lists, lookup, saved, with_schema

BLOCK = 4096
IDS_PER_PART = 4096
WORD = r"[^\x20\x09-\x0D]+"
PARTS = ["e1", "e2", "e3", "e4"]
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(df: DataFrame) -> DataFrame:
    """``c, turn, d, words`` per row: conversation, turn, digest of role and
    text, words of the text."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    return df.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn"), F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("d"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def ordered(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``c, i, d, words`` with the place i from 1, ``c, n`` with the number of turns)."""
    placed = saved(ordered_positions(turns(df), [F.col("c"), F.col("turn").asc_nulls_first(), F.col("d")], out="at").drop("turn"), "placed")
    convs = saved(placed.groupBy("c").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n")), "convs")
    rows = lookup(placed, convs, ["c"], "n", placed.count(), "inner")
    return saved(rows.select("c", (F.col("at") - F.col("start") + 1).alias("i"), "n", "d", "words"), "turns"), convs.select("c", "n")


def rebuild(df: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversation c becomes the first h turns of conversation c - c % group,
    then its own turns after its first h; h = crc32(decimal c) % most.
    Returns (``c, p, d, words``, ``c, n``) like ``ordered``."""
    rows, convs = ordered(df)
    c = F.col("c")
    convs = convs.select("c", "n", (F.crc32(c.cast("string")) % most).cast("long").alias("h"), (c - c % group).alias("base"))
    have = convs.select(c.alias("base"), F.col("n").alias("base_n"))
    # at most 2 * group - 1 conversations have one base
    convs = saved(convs.join(have, "base", "left").select("c", "n", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("borrowed")), "rebuilt")
    own = lookup(rows.drop("n"), convs.select("c", "n", "h", "borrowed"), ["c"], "n", rows.count(), "inner")
    own = own.filter("i > h").select("c", (F.col("i") - F.col("h") + F.col("borrowed")).alias("p"), "d", "words")
    heads = rows.filter(F.col("i") < most).select(F.col("c").alias("base"), F.col("i").alias("p"), "d", "words")
    first = convs.filter("borrowed > 0").select("c", "base", "borrowed").join(heads, "base").filter("p <= borrowed")
    n = F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("borrowed")
    return own.unionByName(first.select("c", "p", "d", "words")), convs.select("c", n.alias("n"))


def running(rows: DataFrame, group: str, at: str, columns: list[str], backwards: bool = False) -> DataFrame:
    """``rows`` with ``columns`` replaced by their running sums in the order of
    ``at`` (from 0 or 1 without gaps), in blocks of ``BLOCK`` places."""
    def order(name: str) -> Column:
        return F.col(name).desc() if backwards else F.col(name).asc()

    rows = rows.withColumn("block", F.floor(F.col(at) / BLOCK))
    ends = rows.groupBy(group, "block").agg(*[F.sum(x).alias(f"{x}_block") for x in columns])
    before = W.partitionBy(group).orderBy(order("block")).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(group, "block", *[F.sum(f"{x}_block").over(before).alias(f"{x}_before") for x in columns]).filter(f"{columns[0]}_before is not null")
    inside = W.partitionBy(group, "block").orderBy(order(at)).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(x).over(inside).alias(f"{x}_inside") for x in columns])
    rows = rows.join(saved(ends, "blocks"), [group, "block"], "left")
    sums = [(F.col(f"{x}_inside") + F.coalesce(f"{x}_before", F.lit(0))).alias(x) for x in columns]
    return rows.select(*[x for x in rows.columns if x not in (*columns, "block") and not x.endswith(("_inside", "_before"))], *sums)


def _key(parts: list[Column]) -> list[Column]:
    """Four sums, modulo 2^32 each, as two longs."""
    a, b, c, d = [F.pmod(x, F.lit(1 << 32)) for x in parts]
    return [F.shiftleft(a, 32).bitwiseOR(b), F.shiftleft(c, 32).bitwiseOR(d)]


def prefixes(sequences: DataFrame) -> DataFrame:
    """``c, p, k1, k2, q1, q2, words``: the names of every prefix and of the one
    before it."""
    h = F.sha2(F.concat(F.col("p").cast("string"), F.lit(":"), F.col("d")), 256)
    rows = sequences.withColumn("h", h)
    parts = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = rows.select("c", "p", "words", *[x.alias(n) for n, x in zip(PARTS, parts)], *[x.alias(f"own{i}") for i, x in enumerate(parts)])
    rows = running(rows, "c", "p", PARTS)
    k = _key([F.col(n) for n in PARTS])
    q = _key([F.col(n) - F.col(f"own{i}") for i, n in enumerate(PARTS)])
    return rows.select("c", "p", k[0].alias("k1"), k[1].alias("k2"), q[0].alias("q1"), q[1].alias("q2"), "words")


def ends_digest(ends: DataFrame, key: list[str], member: str) -> DataFrame:
    """``key`` and ``ends_sha256`` of each group: SHA-256 of the members in
    ascending order, comma-joined. Portions are formatted in parallel, then
    hashed one after the other, so no group is held."""
    names = ", ".join(f"{k} long" for k in key)

    def portions(batches):
        now, ids = None, []
        for *ks, ms in column_lists(batches):
            out = {**{k: [] for k in key}, "first": [], "ids": []}

            def emit():
                for k, v in zip(key, now):
                    out[k].append(v)
                out["first"].append(ids[0])
                out["ids"].append(",".join(map(str, ids)))

            for *group, m in zip(*ks, ms):
                if ids and (group != now or len(ids) >= IDS_PER_PART):
                    emit()
                    ids = []
                now = group
                ids.append(m)
            yield out
        if ids:
            yield {**{k: [v] for k, v in zip(key, now)}, "first": [ids[0]], "ids": [",".join(map(str, ids))]}

    def digests(batches):
        now, h = None, None
        for *ks, _, texts in column_lists(batches):
            out = {**{k: [] for k in key}, "ends_sha256": []}
            for *group, t in zip(*ks, texts):
                if group != now:
                    if now is not None:
                        for k, v in zip(key, now):
                            out[k].append(v)
                        out["ends_sha256"].append(h.hexdigest())
                    now, h = group, hashlib.sha256(t.encode())
                else:
                    h.update(b"," + t.encode())
            yield out
        if now is not None:
            yield {**{k: [v] for k, v in zip(key, now)}, "ends_sha256": [h.hexdigest()]}

    parts = with_schema(ends.select(*key, member).repartitionByRange(*key, member).sortWithinPartitions(*key, member), portions, f"{names}, first long, ids string")
    dealt = saved(parts, "ends").repartition(*key).sortWithinPartitions(*key, "first")
    return with_schema(dealt, digests, f"{names}, ends_sha256 string")


def trie(sequences: DataFrame, convs: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """The nodes of the trie of ``sequences`` (c, p from 1, d, words), with
    ``convs`` (c, n turns) for all members: ``conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    rows = saved(prefixes(sequences), "prefixes")
    nodes = rows.groupBy("k1", "k2", "p").agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
                                              F.max("q1").alias("q1"), F.max("q2").alias("q2"))
    nodes = saved(nodes, "nodes")
    kids = nodes.groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = saved(nodes.join(saved(kids, "kids"), ["k1", "k2"], "left").fillna(0, ["n_children"]), "nodes")
    root = convs.agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n")).first()
    parents = nodes.filter("n_children > 0").select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("of"))
    below = saved(lookup(nodes.filter("p > 1"), parents, ["q1", "q2"], "of", nodes.count(), "inner").drop("of"), "below")
    tops = nodes.filter("p = 1").withColumn("parent_conv_id", F.lit(root["c"]).cast("long"))
    tree = below.unionByName(tops).select(
        "k1", "k2", "conv_id", F.col("p").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    tree = saved(tree, "tree")
    sums = ["n_leaves", "saved_tokens"]
    # chains: nodes of one smallest member
    chain_top = tree.filter((F.col("depth") == 1) | (F.col("parent_conv_id") != F.col("conv_id")))
    chains = chain_top.select(F.col("conv_id").alias("node"), F.when(F.col("depth") > 1, F.col("parent_conv_id")).alias("parent"), (F.col("depth") - 1).alias("at"))
    own = tree.groupBy(F.col("conv_id").alias("node")).agg(*[F.sum(x).alias(x) for x in sums])
    chains = saved(chains.join(saved(own, "own"), "node"), "chains")
    totals = saved(rollup(chains, sums, local_nodes), "totals")
    hung = totals.join(chains.filter("parent is not null").select("node", "parent", "at"), "node")
    hung = hung.groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(*[F.sum(x).alias(f"{x}_hung") for x in sums])
    tree = tree.join(saved(hung, "hung"), ["conv_id", "depth"], "left")
    tree = tree.select(*[x for x in tree.columns if x not in sums and not x.endswith("_hung")], *[(F.col(x) + F.coalesce(f"{x}_hung", F.lit(0))).alias(x) for x in sums])
    tree = running(tree, "conv_id", "depth", sums, backwards=True)
    # members that end at a node; the root's name is (0, 0), which is the empty sum
    last = convs.join(rows.groupBy("c").agg(F.max("p").alias("last")), "c", "left").select("c", F.coalesce("last", F.lit(0)).alias("p"))
    ends = last.join(rows.select("c", "p", "k1", "k2"), ["c", "p"], "left").select("c", F.coalesce("k1", F.lit(0)).alias("k1"), F.coalesce("k2", F.lit(0)).alias("k2"))
    digests = saved(ends_digest(ends, ["k1", "k2"], "c"), "digests")
    whole = chains.agg(*[F.sum(x).alias(x) for x in sums], F.count_if(F.col("at") == 0).alias("n_children")).first()
    spark = rows.sparkSession
    top = spark.range(1 if root["n"] else 0).select(
        F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(root["c"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.lit(root["n"]).cast("long").alias("n_convs"), F.lit(whole["n_children"]).cast("long").alias("n_children"),
        F.lit(whole["n_leaves"] if whole["n_children"] else 1).cast("long").alias("n_leaves"), F.lit(whole["saved_tokens"] or 0).cast("long").alias("saved_tokens"))
    out = tree.unionByName(top).join(digests, ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt_trie(df: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """The trie of the rebuilt conversations of ``df``."""
    return trie(*rebuild(df), local_nodes)


#: the reflected polynomial of CRC-32
CRC = ("xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT), "
       "lambda s, b: list_reduce([xor(s, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, 3988292384::UBIGINT * (u & 1)))), 4294967295::UBIGINT)")
ORACLE = rf"""
WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
                  len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words FROM conversations WHERE conv_id IS NOT NULL),
     o AS (SELECT conv_id, d, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS i FROM t),
     c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base, ({CRC}) % 4 AS h FROM t GROUP BY conv_id),
     cb AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS borrowed FROM c LEFT JOIN c b ON b.conv_id = c.base),
     r AS (SELECT o.conv_id, o.i - cb.h + cb.borrowed AS p, d, words FROM o JOIN cb USING (conv_id) WHERE o.i > cb.h
           UNION ALL SELECT cb.conv_id, o.i, d, words FROM cb JOIN o ON o.conv_id = cb.base AND o.i <= cb.borrowed),
     f AS (SELECT a.conv_id, a.p, any_value(a.words) AS words, string_agg(b.d, '' ORDER BY b.p) AS prefix FROM r a JOIN r b ON b.conv_id = a.conv_id AND b.p <= a.p GROUP BY a.conv_id, a.p
           UNION ALL SELECT conv_id, 0, 0, '' FROM c),
     l AS (SELECT conv_id, max(p) AS p FROM f GROUP BY conv_id),
     g AS (SELECT prefix, p AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
                  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (l.p IS NOT NULL), '')) AS ends_sha256
           FROM f LEFT JOIN l USING (conv_id, p) GROUP BY prefix, p),
     k AS (SELECT left(prefix, greatest(length(prefix) - 64, 0)) AS prefix, count(*) AS n FROM g WHERE depth > 0 GROUP BY 1),
     s AS (SELECT up.prefix, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(g.own) AS saved_tokens
           FROM g LEFT JOIN k USING (prefix) JOIN f up ON up.conv_id = g.conv_id AND up.p <= g.depth GROUP BY up.prefix)
SELECT g.conv_id, g.depth, parent.conv_id AS parent_conv_id, g.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, g.ends_sha256
FROM g JOIN s USING (prefix) LEFT JOIN k USING (prefix)
LEFT JOIN g parent ON g.depth > 0 AND parent.prefix = left(g.prefix, greatest(length(g.prefix) - 64, 0))
"""
