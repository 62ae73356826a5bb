"""Approximate nearest neighbours by learned partitions (inner product).

Fit, on a bounded sample of ``FIT_ROWS`` vectors: a graph joins each sample
vector to its nearest others; restreamed greedy assignment splits the graph
into partitions of nearly equal size that cut few edges; a softmax classifier
learns a vector's partition, and a second one, the router, learns over which
partitions the neighbours of a query are spread. Half of the sample, unseen by
the router, sets how much probability a query's partitions must cover so that
``COVER`` of all neighbours lie in them.

Index: the classifier assigns every row. Search: the router sends a query to
its most probable partitions up to that cover, and on until they hold enough
rows; within them the exact inner products in double precision rank all rows.
A query's ``SPARE (k + 1)``-th best product with the sample is a bound: blocks
return only rows that reach it (and at most k). A query that finds fewer than k
rows so searches its partitions again without the bound.

Skew: partitions are cut into blocks of rows and queries, so a partition of
any size is many small tasks. Of vectors that are equal in all components only
the ``k + 1`` smallest ids can be in a result (ties go to the smaller id and a
query leaves out itself); the others leave before the index by a group limit,
which Spark applies on both sides of the shuffle.

Rows: null, zero or non-finite vectors, vectors with a null component, rows
without id and vectors of another length than the most common one take no part;
repeated rows count once; fewer rows than ``k + 1`` give all of them; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import saved, with_schema

FIT_ROWS = 16_384
NEIGHBOURS = 16
ROWS_PER_PARTITION = 500
MOST_PARTITIONS = 512
COVER = 0.94
SPARE = 3
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024
SEED = 3


def usable(v: Column) -> Column:
    """Whole, finite and not zero."""
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~wrong & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the k others of largest inner product, in blocks."""
    x = -x.astype(np.float32)
    out = np.empty((len(x), k), np.int32)
    for at in range(0, len(x), 256):
        s = x[at:at + 256] @ -x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = np.inf
        out[at:at + 256] = np.argpartition(s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rng, passes: int = 8, slack: float = 1.1) -> np.ndarray:
    """Split the graph's nodes into ``parts`` groups of at most ``slack``
    times the mean size: start from directions drawn among the nodes, then
    stream the nodes again and again to the group of most of their neighbours,
    weighted by the room that is left in it."""
    n = len(x)
    cap = int(np.ceil(slack * n / parts))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = unit[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        near = np.argmax(unit @ centre.T, axis=1)
        for p in range(parts):
            if (near == p).any():
                m = unit[near == p].sum(0)
                centre[p] = m / max(1e-12, np.linalg.norm(m))
    back = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            back[j].append(i)
    adjacent = [np.array(row + back[i]) for i, row in enumerate(graph.tolist())]
    part, size = np.full(n, -1), np.zeros(parts)
    score = unit @ centre.T
    for i in rng.permutation(n):  # nearest direction with room
        for p in np.argsort(-score[i])[:64]:
            if size[p] < cap:
                break
        else:
            p = int(np.argmin(size))
        part[i] = p
        size[p] += 1
    for _ in range(passes):
        moved = 0
        for i in rng.permutation(n):
            size[part[i]] -= 1
            gain = np.bincount(part[adjacent[i]], minlength=parts) * (1 - size / cap)
            p = int(np.argmax(gain))
            if gain[p] <= gain[part[i]]:
                p = part[i]
            moved += p != part[i]
            part[i] = p
            size[p] += 1
        if moved < n / 200:
            break
    return part


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train_softmax(x: np.ndarray, target: np.ndarray, rng, epochs: int = 30, batch: int = 256, rate: float = 0.05) -> np.ndarray:
    """Weights of a softmax regression on soft targets (Adam)."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((z.shape[1], target.shape[1]))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 1e-3
        order = rng.permutation(len(z))
        for at in range(0, len(z), batch):
            i = order[at:at + batch]
            g = z[i].T @ (softmax(z[i] @ w) - target[i]) / len(i) + 1e-5 * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


class Partitioner:
    """Classifier of rows, router of queries and the cover they need."""

    SHARP = 8.0  # unit vectors are scaled so that few steps separate directions

    def __init__(self, sample: np.ndarray, parts: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.sample = sample.astype(np.float32)
        self.parts = max(1, min(parts, len(sample) // 4))
        self.norm = float(np.linalg.norm(sample, axis=1).max()) if len(sample) else 1.0
        self.cover = 1.0
        if self.parts == 1:
            return
        graph = nearest(sample, min(NEIGHBOURS, len(sample) - 1))
        part = balanced_partition(sample, graph, self.parts, rng)
        own = np.zeros((len(sample), self.parts), np.float32)
        own[np.arange(len(sample)), part] = 1
        self.rows = train_softmax(self.row_features(sample), own, rng)
        now = self.assign(sample)  # where the index will put them
        spread = own
        spread[:] = 0
        for j in range(graph.shape[1]):
            spread[np.arange(len(sample)), now[graph[:, j]]] += 1 / graph.shape[1]
        half = rng.permutation(len(sample))
        fit, held = half[:len(half) // 2], half[len(half) // 2:]
        self.router = train_softmax(self.query_features(sample[fit]), spread[fit], rng)
        tries = np.array([0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999])
        found = np.zeros(len(tries))
        for at in range(0, len(held), 512):
            p = self.route(sample[held[at:at + 512]])
            order = np.argsort(-p, axis=1)
            p = np.take_along_axis(p, order, 1)
            before = np.cumsum(p, axis=1) - p
            mass = np.take_along_axis(spread[held[at:at + 512]], order, 1)
            found += [(mass * (before < c)).sum() for c in tries]
        enough = tries[found >= COVER * len(held)]
        self.cover = float(enough[0]) if len(enough) else 1.0

    def row_features(self, x: np.ndarray) -> np.ndarray:
        """A row within the ball of the sample's largest norm, with the
        coordinate that turns inner products into angles."""
        y = x / self.norm
        last = np.sqrt(np.clip(1 - (y * y).sum(1, keepdims=True), 0, None))
        return self.SHARP * np.hstack([y, last])

    def query_features(self, x: np.ndarray) -> np.ndarray:
        return self.SHARP * x / np.linalg.norm(x, axis=1, keepdims=True)

    def assign(self, x: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.zeros(len(x), np.int64)
        f = self.row_features(x)
        return np.argmax(f @ self.rows[:-1] + self.rows[-1], axis=1)

    def route(self, x: np.ndarray) -> np.ndarray:
        f = self.query_features(x)
        return softmax(f @ self.router[:-1] + self.router[-1])

    def probes(self, x: np.ndarray, sizes: np.ndarray, least: int) -> list[list[int]]:
        """Partitions of each query: most probable first until they cover
        enough probability and hold ``least`` rows (or all rows)."""
        if self.parts == 1:
            return [[0]] * len(x)
        p = self.route(x)
        out = []
        for row, order in zip(p, np.argsort(-p, axis=1, kind="stable")):
            before = np.cumsum(row[order]) - row[order]
            rows = np.cumsum(sizes[order]) - sizes[order]
            out.append(order[(before < self.cover) | (rows < least)].tolist())
        return out


    def bounds(self, x: np.ndarray, least: int) -> np.ndarray:
        """A score that the ``least`` best rows of each query reach: its
        ``least``-th best product with the sample, whose rows are rows of the
        table, less the rounding of single precision."""
        if len(self.sample) < least:
            return np.full(len(x), -np.inf)
        out = np.empty(len(x))
        slip = 1e-5 * self.norm * np.linalg.norm(x, axis=1)
        for at in range(0, len(x), 128):
            s = x[at:at + 128].astype(np.float32) @ self.sample.T
            out[at:at + 128] = np.partition(s, s.shape[1] - least, axis=1)[:, s.shape[1] - least]
        return out - slip


def best_in_block(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best rows of the block for each of its queries, exactly, as far
    as they reach the query's bound."""
    out_q, out_v, out_s = [], [], []
    if rows.num_rows and queries.num_rows:
        ids, x = rows.column("vec_id").to_numpy(), matrix(rows.column("v"))
        qids, y, bound = queries.column("query_id").to_numpy(), matrix(queries.column("q")), queries.column("bound").to_numpy()
        for at in range(0, len(y), 128):
            s = y[at:at + 128] @ x.T
            for i, row in enumerate(s):
                row[ids == qids[at + i]] = -np.inf
                near = np.flatnonzero(np.isfinite(row) & (row >= bound[at + i]))
                if len(near) > k:
                    limit = np.partition(row[near], len(near) - k)[len(near) - k]
                    near = near[row[near] >= limit - 1e-9 * (1 + abs(limit))]
                # the same order of additions for every pair, so equal vectors tie
                exact = (x[near] * y[at + i]).sum(axis=1)
                top = near[np.lexsort((ids[near], -exact))][:k]
                out_q += [qids[at + i]] * len(top)
                out_v += ids[top].tolist()
                out_s += (x[top] * y[at + i]).sum(axis=1).tolist()
    return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})


def search(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", fit_rows: int = FIT_ROWS,
           rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row
    where ``is_query`` holds, among all other rows."""
    spark = df.sparkSession
    base = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), is_query.alias("is_q"))
    base = base.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    base = saved(base.withColumn("v", F.col("v").cast("array<double>")).distinct(), "vectors")
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = base.filter(F.size("v") == sizes["d"])
    # about fit_rows rows by a hash of their id, and never more
    share = min(1.0, fit_rows / sizes["count"])
    sample = base.filter(F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow()
    model = Partitioner(matrix(sample.column("v"))[:fit_rows], min(MOST_PARTITIONS, sizes["count"] // rows_per_partition))
    del sample

    same = W.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    few = base.select("vec_id", "v").withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                yield {"vec_id": b.column(0), "v": b.column(1), "part": model.assign(matrix(b.column(1)))}

    rows = saved(with_schema(few.select("vec_id", "v"), assign, "vec_id long, v array<double>, part int"), "index")
    count = np.zeros(model.parts, np.int64)
    for r in rows.groupBy("part").count().collect():  # one row per partition
        count[r["part"]] = r["count"]

    def route(batches):
        for b in batches:
            if b.num_rows:
                yield {"query_id": b.column(0), "q": b.column(1), "bound": model.bounds(matrix(b.column(1)), SPARE * (k + 1)),
                       "parts": model.probes(matrix(b.column(1)), count, k + 1)}

    queries = with_schema(base.filter("is_q").select("vec_id", "v"), route, "query_id long, q array<double>, bound double, parts array<int>")
    queries = saved(queries.select("query_id", "q", "bound", F.explode("parts").alias("part")), "routed")
    asked = np.zeros(model.parts, np.int64)
    for r in queries.groupBy("part").count().collect():
        asked[r["part"]] = r["count"]
    n_row = F.array(*[F.lit(int(-(-c // BLOCK_ROWS)) or 1) for c in count])
    n_query = F.array(*[F.lit(int(-(-c // BLOCK_QUERIES)) or 1) for c in asked])
    own = lambda c, blocks: F.pmod(F.xxhash64(F.lit(1), c), blocks[F.col("part")]).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), blocks[F.col("part")] - 1))
    left = rows.withColumn("rb", own("vec_id", n_row)).withColumn("qb", every(n_query))
    by = ["part", "rb", "qb"]

    def ranked(asking: DataFrame) -> DataFrame:
        right = asking.withColumn("qb", own("query_id", n_query)).withColumn("rb", every(n_row))
        pairs = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
            lambda a, b: best_in_block(a, b, k), "query_id long, vec_id long, score double")
        best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # repeated ids count once
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return best.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k)

    first = saved(ranked(queries), "nearest")
    # a query whose partitions hold fewer than k rows up to its bound asks them again without one
    full = first.filter(F.col("rank") == k).select("query_id")
    short = queries.filter(F.col("bound") > float("-inf")).join(full, "query_id", "left_anti")
    again = ranked(short.withColumn("bound", F.lit(float("-inf"))))
    out = first.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(again)
    return out.select("query_id", "rank", "vec_id", "score")
