"""Binned training data and trees over it, shared by boosting and forests.

Features are cut into at most ``MAX_BINS`` bins at quantiles of a sketch of
all rows, once. The binned rows are written to the shared folder in chunks (a
row of the table is up to ``CHUNK_ROWS`` training rows as packed arrays), so a pass over
the data reads a few large values per task. A pass sums statistics per (node,
feature, bin) inside every task with numpy; with several tasks one shuffle by
(tree, feature) adds the tasks' sums. What reaches the driver is
nodes x features x 256 sums, whatever the number of rows.

Where the features have few bins together, rows with the same bins are alike to every tree: ``cells_of``
finds the distinct bin vectors, and ``drawn_sums`` adds weights, labels and rows per cell for all draws of rows
(rounds, trees) in one pass. Trees are then grown over the cells instead of by a pass per level.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import saved, scratch_path

MAX_BINS = 255  # bin 255 is a missing value
MISSING = 255
CHUNK_ROWS = 32_768
ROWS_PER_TASK = 250_000
#: more distinct bin vectors than this, or more possible ones, are not grown over cells
MOST_CELLS = 65_536
CELL_SPACE = 1 << 22
#: with more rows for each node, rows go down a tree node by node, else one by one
ROWS_PER_NODE = 256
#: rows of a task of a pass over all of them
ROWS_PER_PASS = 4_000_000
#: bytes of the sums per cell that a task holds; more draws take several tasks over the same rows, each of up to so many rows
SUM_BYTES, ROWS_PER_SUM = 32 << 20, 16_000_000
#: a sum of whole weights and a count of rows in one number: weights + PAIR x rows
PAIR = float(1 << 26)
#: bytes of a row group of chunks and of a batch that a Python worker gets
GROUP_BYTES = 16 << 20
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(ids: np.ndarray, *salt: int) -> np.ndarray:
    """A uniform number in [0, 1) for each id, a function of id and salt only."""
    x = ids.astype(np.uint64)
    for s in salt:
        x = mix(x * GOLD + np.uint64(s + 1))
    return (mix(x) >> np.uint64(11)).astype(float) * 2.0**-53


def edges_of(df: DataFrame, features: list[str], bins: int = MAX_BINS) -> list[np.ndarray]:
    """Increasing cut values of every feature: x <= cut goes left. One pass
    (mergeable quantile sketches); a value of more than about 1 / (8 bins) of the
    rows always has a cut of its own."""
    if not 2 <= bins <= MAX_BINS:
        raise ValueError(f"2 to {MAX_BINS} bins, not {bins}")
    cols = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    at = [(i + 1) / bins for i in range(bins)]
    found = df.select(*cols).approxQuantile([f"x{i}" for i in range(len(features))], at, 1 / (8 * bins))
    return [np.unique(np.array(q, float))[:-1] if q else np.zeros(0) for q in found]


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.searchsorted(edges, x, side="left").astype(np.uint8)
    out[np.isnan(x)] = MISSING
    return out


@dataclass
class Data:
    """Chunks: ``uid, bins, y, w, margin`` as packed arrays."""

    chunks: DataFrame
    edges: list[np.ndarray]
    rows: int
    tasks: int
    files: DataFrame | None = None  # the chunks, not kept

    def kept(self) -> Data:
        return Data(self.chunks.persist(StorageLevel.MEMORY_AND_DISK), self.edges, self.rows, self.tasks, self.files)

    def release(self) -> None:
        self.chunks.unpersist()

    def map(self, run: Callable, schema: str) -> DataFrame:
        """``run`` gets the unpacked chunks of a task and yields dicts."""
        from pyspark.sql.types import StructType

        st, d = StructType.fromDDL(schema), len(self.edges)
        names = st.fieldNames()

        def each(batches):
            for batch in batches:
                for uid, bins, y, w, margin in zip(*[batch.column(c) for c in ("uid", "bins", "y", "w", "margin")]):
                    y = np.frombuffer(y.as_buffer())
                    n = len(y)
                    yield (np.frombuffer(uid.as_buffer(), np.int64), np.frombuffer(bins.as_buffer(), np.uint8).reshape(d, n), y,
                           np.frombuffer(w.as_buffer()) if len(w.as_buffer()) else np.ones(n), np.frombuffer(margin.as_buffer()).reshape(n, -1) if len(margin.as_buffer()) else np.zeros((n, 0)))

        def task(batches):
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(st)
            chunks = each(batches)
            first = next(chunks, None)
            if first is None:  # a partition without chunks adds nothing
                return
            for cols in run(itertools.chain([first], chunks)):
                yield pa.RecordBatch.from_arrays([pa.array(cols[c], arrow.field(c).type) for c in names], schema=arrow)

        return self.chunks.mapInArrow(task, schema)

    def whole(self) -> Data:
        """All chunks as one task's, for data of at most ``rows_per_task`` rows or for tasks that take them in bit by bit."""
        return Data((self.chunks if self.tasks == 1 or self.files is None else self.files).coalesce(1), self.edges, self.rows, 1)

    def unkept(self, tasks: int) -> Data:
        """The chunks read from their files, for passes that are too few to keep them in the executors."""
        return Data((self.chunks if self.files is None else self.files).coalesce(tasks), self.edges, self.rows, tasks)

    def sums(self, run: Callable) -> list[dict]:
        """The rows (tree, feature, sums) of ``run``, added up over the tasks."""
        schema = "tree int, feature int, sums binary"
        out: dict = {}
        for r in summed(self.map(run, schema), self.tasks, schema).collect():  # as many as trees x features
            k, a = (r["tree"], r["feature"]), np.frombuffer(r["sums"])
            out[k] = out[k] + a if k in out else a
        return [{"tree": t, "feature": f, "sums": a} for (t, f), a in out.items()]

    def replaced(self, chunks: DataFrame, written: bool) -> Data:
        """With other chunks, kept by the next pass over them; ``written`` first, so that nothing before is needed again."""
        if written:
            chunks = saved(chunks, "chunks").coalesce(self.tasks)
        return Data(chunks.persist(StorageLevel.MEMORY_AND_DISK), self.edges, self.rows, self.tasks)


@dataclass
class LocalData:
    """The chunks of data that fits one task, inside that task."""

    held: list[tuple]
    edges: list[np.ndarray]
    rows: int

    def sums(self, run: Callable) -> list[dict]:
        return [dict(zip(part, row)) for part in run(iter(self.held)) for row in zip(*part.values())]


CHUNK = "uid binary, bins binary, y binary, w binary, margin binary"


def pack(uid, bins, y, w, margin) -> dict:
    """Weights of 1 take no room."""
    return {"uid": [uid.tobytes()], "bins": [bins.tobytes()], "y": [y.tobytes()], "w": [b"" if (w == 1).all() else w.tobytes()], "margin": [margin.tobytes()]}


def prepare(df: DataFrame, features: list[str], label: str, weight: str | None = None, margin: list[float] | None = None,
            bins: int = MAX_BINS, rows_per_task: int = ROWS_PER_TASK, short_passes: bool = False, keep: bool = True) -> Data:
    """Bins, chunks and identities (a hash of the whole row) of the training rows. ``short_passes``: many passes
    with small shuffles will follow. ``keep``: the executors keep the chunks for them."""
    edges = edges_of(df, features, bins)
    start, d = np.array(margin or []), len(features)
    w: Column = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("uid"), F.col(label).cast("double").alias("y"), w.alias("w"),
                     *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    n = df.count()
    # a pass hands on sums of the same size from every task, so there are no more tasks than can work at once, or than their rows need
    tasks = 1 if n <= rows_per_task else max(2, df.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_PER_PASS))

    def run(batches):
        def emit(parts):
            uid, y, w, *xs = [np.concatenate(c) for c in zip(*parts)]
            b = np.stack([binned(x, e) for x, e in zip(xs, edges)]) if d else np.zeros((0, len(y)), np.uint8)
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary()) for k, v in pack(uid, b, y, w, np.tile(start, (len(y), 1))).items()})

        parts, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                piece = batch.slice(at, CHUNK_ROWS)
                parts.append([piece.column(0).to_numpy()] + [piece.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(1, 3 + d)])
                held += piece.num_rows
                if held >= CHUNK_ROWS:
                    yield emit(parts)
                    parts, held = [], 0
        if held:
            yield emit(parts)

    path, session = scratch_path(df.sparkSession, "chunks"), _session(df.sparkSession)
    # the rows are large: row groups and batches are of some MB instead of at least 100 rows
    written = rows.repartition(tasks, "uid").mapInArrow(run, CHUNK).write
    written.options(**{"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}).parquet(path)
    if short_passes and tasks > 1:  # planned as one job instead of one for every stage
        session.conf.set("spark.sql.adaptive.enabled", "false")
        session.conf.set("spark.sql.shuffle.partitions", str(tasks))
    files = session.read.schema(CHUNK).parquet(path)
    data = Data(files.coalesce(tasks), edges, n, tasks, files)
    return data.kept() if keep else data


def _session(spark: SparkSession) -> SparkSession:
    """A session for frames of chunks and sums: batches of some MB, and a union has the partitions of its parts."""
    out = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            out.conf.set(name, value)
    out.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(GROUP_BYTES))
    out.conf.set("spark.sql.unionOutputPartitioning", "false")
    return out


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1; the right child follows the left one."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    depth: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, missing_left: bool) -> int:
        child = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.missing_left[node] = feature, at, child, missing_left
        for _ in range(2):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.missing_left.append(True)
            self.depth.append(self.depth[node] + 1)
            self.value.append(0.0)
        return child

    def packed(self) -> Packed:
        return Packed(np.array(self.feature, np.int32), np.array(self.bin, np.uint8), np.array(self.left, np.int32), np.array(self.missing_left, bool),
                      np.array(self.value, float).reshape(len(self.feature), -1))


@dataclass
class Packed:
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray  # nodes x outputs

    def groups(self, bins: np.ndarray, wanted: list[int], rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(node, those of ``rows`` that it has, in their order) for the wanted leaves."""
        needed = np.zeros(len(self.feature), bool)
        needed[wanted] = True
        for v in range(len(needed) - 1, -1, -1):  # a child's number is larger than its parent's
            if self.feature[v] >= 0:
                needed[v] = needed[self.left[v]] or needed[self.left[v] + 1]
        out, open_ = [], [(0, rows)] if needed[0] else []
        while open_:
            v, rows = open_.pop()
            if self.feature[v] < 0:
                out.append((v, rows))
                continue
            b = bins[self.feature[v]].take(rows)
            goes_left = b <= self.bin[v]
            if self.missing_left[v]:
                goes_left |= b == MISSING
            for child, side in ((self.left[v], goes_left), (self.left[v] + 1, ~goes_left)):
                if needed[child]:
                    open_.append((int(child), rows[side]))
        return out

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every column of ``bins`` (features x rows)."""
        node = np.zeros(bins.shape[1], np.int32)
        if len(node) > ROWS_PER_NODE * len(self.feature):
            for v, rows in self.groups(bins, np.flatnonzero(self.feature < 0).tolist(), np.arange(len(node))):
                node[rows] = v
            return node
        rows = np.arange(bins.shape[1]) if self.feature[0] >= 0 else np.zeros(0, int)
        while len(rows):
            at = node[rows]
            b = bins[self.feature[at], rows]
            goes_left = np.where(b == MISSING, self.missing_left[at], b <= self.bin[at])
            at = self.left[at] + ~goes_left
            node[rows] = at
            rows = rows[self.feature[at] >= 0]
        return node

    def walked(self, bins: np.ndarray, missing: bool) -> np.ndarray:
        """``nodes`` of a few rows: a leaf is its own child, so the rows go down together. ``missing``: some bins may be missing values."""
        n = bins.shape[1]
        inner = self.feature >= 0
        offset = np.where(inner, self.feature, 0).astype(np.intp) * n
        cut, left = np.where(inner, self.bin, MISSING).astype(np.uint8), np.where(inner, self.left, np.arange(len(inner)))
        flat, rows, at, out = np.ascontiguousarray(bins).ravel(), np.arange(n), np.zeros(n, np.intp), np.zeros(n, np.intp)
        for step in itertools.count(1):
            i = offset.take(at)
            i += rows
            b = flat.take(i)
            right = b > cut.take(at)
            if missing:
                right &= (b != MISSING) | ~self.missing_left.take(at)
            at = left.take(at)
            at += right
            if step % 4 == 0 or step < 2:
                open_ = np.flatnonzero(inner.take(at))
                if 2 * len(open_) < len(at):
                    out[rows] = at
                    rows, at = rows[open_], at[open_]
                if not len(open_):
                    out[rows] = at
                    return out

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


TREE = "tree int, node int, feature binary, bin binary, left binary, missing_left binary, value binary"


def tree_columns(t: Packed) -> dict[str, bytes]:
    return {c: getattr(t, c).tobytes() for c in ("feature", "bin", "left", "missing_left", "value")}


def unpack(r) -> Packed:
    feature = np.frombuffer(r["feature"], np.int32)
    return Packed(feature, np.frombuffer(r["bin"], np.uint8), np.frombuffer(r["left"], np.int32), np.frombuffer(r["missing_left"], bool),
                  np.frombuffer(r["value"]).reshape(len(feature), -1))


def summed(partials: DataFrame, tasks: int, schema: str) -> DataFrame:
    """Rows (tree, feature, sums) added up by (tree, feature), where several tasks made them."""
    if tasks == 1:  # the partials are few
        return partials

    def run(batches):
        held: dict = {}
        for batch in batches:
            for t, f, sums in zip(batch.column("tree").to_pylist(), batch.column("feature").to_pylist(), batch.column("sums")):
                a = np.frombuffer(sums.as_buffer())
                if (t, f) in held:
                    held[t, f] += a
                else:
                    held[t, f] = a.copy()
        if held:
            yield pa.RecordBatch.from_pydict({"tree": pa.array([k[0] for k in held], pa.int32()), "feature": pa.array([k[1] for k in held], pa.int32()),
                                              "sums": pa.array([a.tobytes() for a in held.values()], pa.binary())})

    return partials.repartition(min(tasks, 64), "tree", "feature").mapInArrow(run, schema)


@dataclass
class Cells:
    """The distinct bin vectors: ``codes`` are their numbers in a mixed radix system, increasing."""

    codes: np.ndarray
    sizes: list[int]

    def bins(self) -> np.ndarray:
        """features x cells."""
        at = np.array(np.unravel_index(self.codes, self.sizes))
        last = np.array(self.sizes)[:, None] - 1
        return np.where(at == last, MISSING, at).astype(np.uint8)

    def places(self) -> np.ndarray:
        """code -> cell."""
        out = np.zeros(math.prod(self.sizes), np.int32)
        out[self.codes] = np.arange(len(self.codes))
        return out


def codes_of(bins: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The bin vectors as numbers; a missing value is the last of ``sizes`` bins."""
    return np.ravel_multi_index([np.minimum(b, k - 1) for b, k in zip(bins, sizes)], sizes)


def cells_of(data: Data) -> Cells | None:
    """One pass; None where there are too many."""
    sizes = [len(e) + 2 for e in data.edges]
    space = math.prod(sizes)
    if not sizes or space > CELL_SPACE or MOST_CELLS < 1:
        return None

    def run(chunks):
        seen = np.zeros(space, bool)
        for _, bins, *_ in chunks:
            seen[codes_of(bins, sizes)] = True
        yield {"code": np.flatnonzero(seen)}

    found = data.unkept(data.tasks).map(run, "code long").distinct().limit(MOST_CELLS + 1).collect()
    return Cells(np.sort(np.array([r["code"] for r in found], np.int64)), sizes) if len(found) <= MOST_CELLS else None


def drawn_sums(data: Data, cells: Cells, draws: int, times: Callable | None, shared: Callable | None = None) -> DataFrame:
    """(tree, feature, sums): for every draw, the weights, weighted labels and rows of all cells. ``times(uid, draw)``
    says how often a draw takes each row; None takes every row once. ``shared(uid)``, if given, is made once for all draws and handed to ``times``
    instead."""
    schema, many = "tree int, feature int, sums binary", len(cells.codes)
    at_once = max(1, min(draws, SUM_BYTES // (24 * max(1, many))))
    blocks = -(-draws // at_once)

    def part(block: int) -> Callable:
        mine = range(block * at_once, min(draws, (block + 1) * at_once))

        def run(chunks):
            place, out, pairs, rows = cells.places(), np.zeros((len(mine), 3, many)), np.zeros((len(mine), many)), 0

            def settle():
                each = np.floor(pairs / PAIR)
                out[:, 0] += pairs - each * PAIR
                out[:, 2] += each
                pairs[:] = 0

            for uid, bins, y, w, _ in chunks:
                at, wy = place[codes_of(bins, cells.sizes)].astype(np.intp), w * y
                ids = uid if shared is None else shared(uid)
                plain = bool((w == 1).all() and np.isfinite(wy).all())
                if rows + len(y) > PAIR / 4:
                    settle()
                    rows = 0
                rows += len(y)
                for i, t in enumerate(mine):
                    k = np.ones(len(y)) if times is None else times(ids, t).astype(float)
                    if plain:  # a row that a draw leaves out adds nothing
                        out[i, 1] += np.bincount(at, k * wy, many)
                        pairs[i] += np.bincount(at, k + PAIR * (k > 0), many)
                        continue
                    take = np.flatnonzero(k)
                    for c, x in enumerate((w[take] * k[take], wy[take] * k[take], None)):
                        out[i, c] += np.bincount(at[take], x, many)
            settle()
            for i, t in enumerate(mine):
                yield {"tree": [t], "feature": [0], "sums": [out[i].tobytes()]}

        return run

    cores = data.chunks.sparkSession.sparkContext.defaultParallelism
    rows = data.unkept(max(-(-2 * cores // blocks), -(-data.rows // ROWS_PER_SUM)))
    sums = reduce(DataFrame.union, [rows.map(part(b), schema) for b in range(blocks)])
    return summed(sums, max(2, min(draws, 64)), schema)
