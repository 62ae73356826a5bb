"""Near duplicates by ProbMinHash over weighted word shingles.

A document is the multiset of its five-word shingles; a shingle's weight is
its number of places. Probability Jaccard of two documents is the sum, over
shared shingles d, of 1 / sum_e max(v_e / v_d, w_e / w_d) (plain Jaccard when
no shingle repeats).

Signature: every shingle is a Poisson process with a rate of its weight; its
arrivals fall into uniformly drawn slots, and a slot keeps the earliest arrival's
shingle. Two documents agree in a slot with the probability Jaccard. The first
arrivals of all shingles are drawn together, then the second ones, and so on;
a shingle drops out when its time passes the latest slot minimum, so most
shingles of a long text stop after one or two arrivals.

Search: 32 bands of 5 slots. Documents with the same normalised words are one text
first (a hash of the words, compared in full), so that copies are neither compared
nor expanded. A band bucket with several texts links each of its texts to
leaders of the bucket, elected by a hash of round, bucket and text; linked pairs are
verified by the exact measure (0.8 or more) on the whole texts, and classes are
the connected components of verified pairs. Rounds go on in buckets whose
texts are in different classes while they join much (``YIELD``); they only make the
rest small.

Rest: in the buckets that are still open, every pair of texts of different classes is
tested or proven to be below the threshold. A bucket's texts are dealt to tasks in blocks, two
blocks meet in one task, and only links leave it. With a and b the shares of two
documents' weight on shingles that the other lacks, the measure is at most
(1 - a)(1 - b) / (1 - ab), with equality where no shingle repeats; the shares of all pairs of two
blocks are two matrix products, and pairs at or above the threshold by this bound are measured.

Skew: buckets are aggregates with map-side combine; joins are by bucket or
text id, which adaptive execution can split; no group is gathered in a task. In an open
bucket, texts outside its largest class meet the others, never that class itself.

Texts are read once for signatures; texts that share a bucket are moved once
more for the exact measure.

Rows: a null text counts as empty; texts without a word are one class of equal
texts; texts of one to four words have their whole word sequence as the only
shingle; rows with a null doc_id are in the result with a null class, and link
nothing; repeated rows fall into one class, and so do different texts under one
doc_id; an empty table gives no rows.
Other columns are ignored (``distinct_documents`` returns them).
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.components import connected_components
from quarry.llm.common import column_lists, saved, with_schema
from quarry.session import scratch_path

WORDS = 5
SLOTS, BANDS = 160, 32
ROWS = SLOTS // BANDS
LEAST = 0.8
LEADERS = 2
YIELD = 0.2  # share of its pairs that a round must link for another one
PLACES_PER_TASK, PAIRS_PER_TASK = 200_000, 500  # so that late rounds take few tasks
CACHE = 500_000
BLOCK = 512  # texts of one side that meet in a task
SLAB = 4096  # shingles of one product
TOKEN = re.compile(r"\w+")
M64 = (1 << 64) - 1
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


class Shingler:
    """Word hashes are kept in a bounded cache per worker."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, ws: list[str], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
        """(distinct shingle hashes, weights)."""
        if not ws:
            return np.zeros(0, np.uint64), np.zeros(0)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(ws).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
        n = max(1, len(ws) - k + 1)
        s = np.full(n, np.uint64(min(k, len(ws))))
        for i in range(min(k, len(ws))):
            s = mix64(s * GOLD + h[i:i + n])
        x, c = np.unique(s, return_counts=True)
        return x, c.astype(float)


def signature(x: np.ndarray, weight: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """For each slot the shingle with the earliest arrival."""
    first = np.full(slots, np.inf)
    owner = np.zeros(slots, np.uint64)
    time, seed, alive, done = np.zeros(len(x)), mix64(x), np.arange(len(x)), 0
    while len(alive):
        # the next arrivals of each live shingle, several at once when few are
        # live: exponential gaps and slots are functions of the shingle and
        # the number of the arrival only
        n = max(1, 512 // len(alive))
        bits = mix64(seed[:, None] + GOLD * np.arange(done + 1, done + n + 1, dtype=np.uint64))
        gap = -np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight[alive][:, None]
        gap[:, 0] += time
        times = np.cumsum(gap, axis=1)
        slot = (mix64(bits ^ GOLD) % np.uint64(slots)).astype(np.int64).ravel()
        flat, which = times.ravel(), np.repeat(alive, n)
        near = np.flatnonzero(flat < first[slot])
        # latest first, so that the earliest arrival is the last to take a slot
        near = near[np.argsort(flat[near])[::-1]]
        first[slot[near]] = flat[near]
        owner[slot[near]] = x[which[near]]
        keep = times[:, -1] < first.max()
        alive, time, seed, done = alive[keep], times[keep, -1], seed[keep], done + n
    return owner


def band_hashes(sig: np.ndarray) -> list[int]:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = mix64(out * GOLD + sig[i::ROWS])
    return out.view(np.int64).tolist()


def probability_jaccard(a: tuple, b: tuple) -> float:
    """The exact measure, by sorting the ratios of the two weights."""
    (xa, wa), (xb, wb) = a, b
    if not len(xa) or not len(xb):
        return float(len(xa) == len(xb))
    both, ia, ib = np.intersect1d(xa, xb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    v, w = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - v.sum(), wb.sum() - w.sum()
    # sum_e max(v_e / v_d, w_e / w_d): shared e with v_e / w_e above v_d / w_d count by v
    r = v / w
    order = np.argsort(r, kind="stable")
    cv, cw = np.cumsum(v[order]), np.cumsum(w[order])
    end = np.searchsorted(r[order], r, side="right")
    top_v, low_w = v.sum() - cv[end - 1], cw[end - 1]
    return float((1 / ((top_v + only_a) / v + (low_w + only_b) / w)).sum())


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, words, h, bands`` for every row: number of words, SHA-256 of
    the word sequence, 32 band hashes. One pass over the texts."""

    def run(batches):
        shingles = Shingler()
        for ks, ts in column_lists(batches):
            ws = [words(t) for t in ts]
            yield {"doc_id": ks, "words": [len(w) for w in ws], "h": [hashlib.sha256(" ".join(w).encode()).digest() for w in ws],
                   "bands": [band_hashes(signature(*shingles(w))) if w else [] for w in ws]}

    return with_schema(df.select(F.col(key).cast("long"), text), run, "doc_id long, words long, h binary, bands array<long>")


class Bodies:
    """Texts stored in buckets of their id, in the shared folder: every round
    joins a few ids to them without moving the texts."""

    def __init__(self, texts: DataFrame):
        self.spark = texts.sparkSession
        self.name = f"bodies_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = texts.select("text_id", "text").repartition(n, "text_id").write.format("parquet")
        writer.bucketBy(n, "text_id").option("path", scratch_path(self.spark, "bodies")).saveAsTable(self.name)

    def of(self, ids: DataFrame, key: str, text: str) -> DataFrame:
        """``ids`` with the text of ``key``."""
        return ids.join(self.spark.table(self.name).select(F.col("text_id").alias(key), F.col("text").alias(text)), key)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def verify(pairs: DataFrame, bodies: Bodies, least: float = LEAST, tasks: int | None = None) -> DataFrame:
    """The pairs (a, b) whose texts have the measure. The many a texts come by
    a bucketed join, the leaders' texts are looked up once and joined by a
    shuffle that can be split when many pairs share a leader. ``tasks`` bounds
    the number of tasks of a small round."""
    leaders = bodies.of(pairs.select("b").distinct(), "b", "tb")
    both = bodies.of(pairs, "a", "ta").join(leaders, "b").select("a", "b", "ta", "tb")

    def run(batches):
        shingles = Shingler()
        held: dict[int, tuple] = {}  # the last few leaders
        for a, b, ta, tb in column_lists(batches):
            sim = []
            for i, j, x, y in zip(a, b, ta, tb):
                if (j, y) not in held:
                    if len(held) > 64:
                        held.clear()
                    held[j, y] = shingles(words(y))
                sim.append(probability_jaccard(shingles(words(x)), held[j, y]))
            yield {"a": a, "b": b, "similarity": sim}

    found = with_schema(both.coalesce(tasks) if tasks else both, run, "a long, b long, similarity double")
    return found.filter(F.col("similarity") >= least)


def _classes(links: DataFrame) -> DataFrame:
    return saved(connected_components(links).withColumnRenamed("node", "text_id"), "classes")


def _payload(texts: DataFrame) -> DataFrame:
    """(text_id, x, w): the shingles of every text and their weights (null: all 1)."""

    def run(batches):
        shingles = Shingler()
        for ks, ts in column_lists(batches):
            found = [shingles(words(t)) for t in ts]
            yield {"text_id": ks, "x": [x.tobytes() for x, _ in found], "w": [None if (w == 1).all() else w.astype(np.float32).tobytes() for _, w in found]}

    return with_schema(texts.select("text_id", "t"), run, "text_id long, x binary, w binary")


def shared_weights(left: list[tuple], right: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """left x right: the share of each text's weight on shingles that the other has.
    Only shingles of both sides count; the products are taken by slabs of them."""
    both = np.intersect1d(np.unique(np.concatenate([x for x, _ in left])), np.unique(np.concatenate([x for x, _ in right])), assume_unique=True)
    out = [np.zeros((len(left), len(right)), np.float32) for _ in range(2)]

    def cells(side):
        row = np.repeat(np.arange(len(side)), [len(x) for x, _ in side])
        x, w = np.concatenate([x for x, _ in side]), np.concatenate([w / w.sum() for _, w in side])
        at = np.searchsorted(both, x)
        held = at < len(both)
        held[held] = both[at[held]] == x[held]
        order = np.argsort(at[held], kind="stable")
        return row[held][order], at[held][order], w[held][order]

    sides = [cells(side) for side in (left, right)]
    for first in range(0, len(both), SLAB):
        weights, there = [], []
        for side, (row, at, w) in zip((left, right), sides):
            i, j = np.searchsorted(at, [first, first + SLAB])
            m = np.zeros((len(side), min(SLAB, len(both) - first)), np.float32)
            m[row[i:j], at[i:j] - first] = w[i:j]
            weights.append(m)
            there.append((m > 0).astype(np.float32))
        out[0] += weights[0] @ there[1].T
        out[1] += there[0] @ weights[1].T
    return out[0], out[1]


def linked_pairs(left: list[tuple], right: list[tuple] | None, least: float) -> list[tuple[int, int]]:
    """Links between texts (id, class, shingles, weights) of ``left`` and ``right`` (None: inside
    ``left``) of different classes: enough of them to connect what is linked. With a and b
    the unshared shares of two texts, the measure is at most (1 - a)(1 - b) / (1 - ab),
    and equal to it where no shingle repeats; others at or above it are measured."""
    other = left if right is None else right
    s, t = shared_weights([r[2:] for r in left], [r[2:] for r in other])
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = s * t / (s + t - s * t)
    parent: dict = {}

    def root(c):
        while parent.get(c, c) != c:
            parent[c] = parent.get(parent[c], parent[c])
            c = parent[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(bound >= least - 1e-4)):
        a, b = left[i], other[j]
        if a[0] == b[0] or (right is None and j < i):
            continue
        ra, rb = root(a[1]), root(b[1])
        if ra != rb and probability_jaccard(a[2:], b[2:]) >= least:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a[0], b[0]))
    return out


def _rest(places: DataFrame, bodies: Bodies, least: float) -> DataFrame:
    """Links (a, b) between different classes of the texts that share a bucket of ``places``
    (bucket, text_id, c). A bucket is its largest class and the others; the others
    meet each other and that class, block by block, in one task for two blocks, and
    only links leave the task."""
    payload = saved(_payload(bodies.of(places.select("text_id").distinct(), "text_id", "t")), "shingles")
    per_class = places.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_class.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("n"))

    def blocks(n):
        return F.ceil(n / BLOCK).cast("int")

    sizes = saved(sizes.select("bucket", F.col("top.c").alias("top"), blocks(F.col("n") - F.col("top.n")).alias("others"), blocks(F.col("top.n")).alias("tops")), "sizes")
    rows = places.join(sizes, "bucket").withColumn("is_top", F.col("c") == F.col("top"))
    block = F.pmod(F.xxhash64("text_id"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("block", block)

    def pairs(kind, n, i, j, side):
        return F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.struct(F.lit(kind).alias("kind"), i(x).alias("i"), j(x).alias("j"), side(x).alias("side")))

    mine = F.col("block")
    with_others = pairs(0, F.col("others"), lambda x: F.least(mine, x), lambda x: F.greatest(mine, x), lambda x: (mine > x).cast("int"))
    with_top = pairs(1, F.col("tops"), lambda x: mine, lambda x: x, lambda x: F.lit(0))
    of_top = pairs(1, F.col("others"), lambda x: x, lambda x: mine, lambda x: F.lit(1))
    dealt = rows.select("bucket", "text_id", "c", F.explode(F.when(F.col("is_top"), of_top).otherwise(F.concat(with_others, with_top))).alias("g"))
    group = ["bucket", "kind", "i", "j"]
    dealt = dealt.select("bucket", "text_id", "c", "g.kind", "g.i", "g.j", "g.side").join(payload, "text_id")
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)

    def run(batches):
        def links(key, held):
            sides = [[r[1:] for r in held if r[0] == x] for x in (0, 1)]
            inside = key[1] == 0 and key[2] == key[3]
            if inside and len(held) > 1:
                return linked_pairs([r[1:] for r in held], None, least)
            return linked_pairs(sides[0], sides[1], least) if not inside and sides[0] and sides[1] else []

        now, held = None, []
        for *keys, side, ids, cs, xs, ws in column_lists(batches):
            out = []
            for *key, p, k, c, x, w in zip(*keys, side, ids, cs, xs, ws):
                if key != now:
                    out += links(now, held) if held else []
                    now, held = key, []
                x = np.frombuffer(x, np.uint64)
                held.append((p, k, c, x, np.ones(len(x)) if w is None else np.frombuffer(w, np.float32).astype(float)))
            yield {"a": [a for a, _ in out], "b": [b for _, b in out]}
        if held:
            out = links(now, held)
            yield {"a": [a for a, _ in out], "b": [b for _, b in out]}

    return with_schema(dealt.select(*group, "side", "text_id", "c", "x", "w"), run, "a long, b long")


def near_duplicates(df: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, text_id, class_id`` for every row: the smallest doc_id of the
    same words, and of the near-duplicate class."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = saved(signatures(docs), "signatures")
    named = sigs.filter("doc_id is not null")
    # aggregates are written before they are joined: a join straight on an
    # aggregate by its key cannot be split, and a hot key would be one task's
    low = saved(named.groupBy("h").agg(F.min("doc_id").alias("text_id")), "texts")
    member = saved(named.select("doc_id", "h").join(low, "h").select("doc_id", "text_id"), "member")
    # of equal texts one row goes on, of repeated rows too
    heads = saved(named.join(low.withColumnRenamed("text_id", "doc_id"), ["h", "doc_id"]).dropDuplicates(["h", "doc_id"]).select(
        F.col("doc_id").alias("text_id"), F.explode("bands").alias("bucket")), "heads")
    shared = heads.groupBy("bucket").agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi")).filter("lo < hi")
    shared = saved(shared.select("bucket"), "shared")
    places = saved(heads.join(shared, "bucket").select("bucket", "text_id"), "places")
    bodies = Bodies(docs.select(F.col("doc_id").alias("text_id"), "text").join(
        places.select("text_id").distinct(), "text_id", "left_semi"))
    # a doc_id with several texts is one document: its texts are linked
    several = member.groupBy("doc_id").agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi")).filter("lo < hi").select("doc_id")
    same_id = saved(member.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("text_id").alias("b")), "same-id")
    start = None if same_id.isEmpty() else same_id
    tried, turn, going = None, 0, True
    classes = None if start is None else _classes(start)
    few = max(8, places.count() // PLACES_PER_TASK)
    while True:
        now = places.withColumn("c", F.col("text_id")) if classes is None else places.join(
            classes, "text_id", "left").withColumn("c", F.coalesce("component", "text_id")).select("bucket", "text_id", "c").coalesce(few)
        # turn 0: one leader by an order that all buckets share, for few different pairs; later leaders by
        # orders of the bucket's own
        named = [F.col("text_id").alias("id"), F.col("c").alias("c")]
        orders = [F.xxhash64(F.lit(turn), F.lit(i), "bucket", "text_id") for i in range(LEADERS)] if turn else [F.xxhash64("text_id")]
        heads_of = [F.min(F.struct(o.alias("o"), *named)) for o in orders]
        leaders = now.groupBy("bucket").agg(F.array(*[F.struct(h["id"].alias("id"), h["c"].alias("c")) for h in heads_of]).alias("l"),
                                            F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
        leaders = saved(leaders.coalesce(few), "leaders")
        # only buckets with texts of several classes go on
        now = saved(now.join(leaders, "bucket").coalesce(few), "places")
        places = now.select("bucket", "text_id")
        if going:
            led = now.select("text_id", "c", F.explode("l").alias("l")).filter("c != l.c")
            pair = led.select(F.col("text_id").alias("a"), F.col("l.id").alias("b"))
            # in the first round leaders are the b side; later ones are pairs in id order, tried once
            pairs = pair if not turn else pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            pairs = pairs.coalesce(few).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = saved(pairs.coalesce(few), "pairs")
            n = pairs.count()
        found, linked = None, 0
        if not going:
            found = saved(_rest(now.select("bucket", "text_id", "c"), bodies, least).distinct(), "links")
            linked = found.count()
        elif n:
            found = saved(verify(pairs, bodies, least, max(24, n // PAIRS_PER_TASK)).select("a", "b"), "links")
            linked = found.count()
            both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            tried = both if tried is None else tried.unionByName(both)
        if linked:
            # the classes so far are stars: one edge a text
            links = found if classes is None else found.unionByName(classes.select(F.col("text_id").alias("a"), F.col("component").alias("b")))
            classes = _classes(links)
        if not going:
            break
        turn, going = turn + 1, linked > YIELD * n
    bodies.close()
    if classes is None:
        result = member.select("doc_id", "text_id", F.col("text_id").alias("class_id"))
    else:
        result = member.join(classes, "text_id", "left").select("doc_id", "text_id", F.coalesce("component", "text_id").alias("class_id"))
    unnamed = docs.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("text_id"), F.lit(None).cast("long").alias("class_id"))
    return result.unionByName(unnamed)


def distinct_documents(df: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of every class: the one with the smallest doc_id (of repeated
    rows, any one). Rows without doc_id stay. Same columns as ``df``."""
    found = near_duplicates(df, least)
    heads = found.filter("doc_id is not null and doc_id = class_id").select(F.col("doc_id").alias("__head")).distinct()
    kept = df.join(heads, F.col("doc_id") == F.col("__head"), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(df.filter(F.col("doc_id").isNull()))
