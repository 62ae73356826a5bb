"""Random forests over histograms (§2.7 random forest).

Every tree sees each row Poisson(1) times, by a hash of row and tree, and chooses among a
hash-drawn subset of the features at every node (among all where the subset allows no
split). Up to ``WHOLE_ROWS`` rows the trees are dealt to the tasks: a task reads all binned rows once, into memory or
beyond ``HELD_BYTES`` into a temporary file, and grows its trees to the end, nodes of more than ``local_rows`` rows
by passes over its blocks, the others from their rows. With more rows, nodes of more than ``local_rows`` rows are split by passes of all tasks over the binned
chunks, all trees of a portion at once; the rows of smaller nodes are dealt to tasks, one
group per (tree, node), and the subtree is grown there to the end. For regression over
features of few bins together (``histograms.cells_of``), one pass adds the rows that every tree draws per cell, and
a task grows a whole tree over the cells.

Splits maximise the gain of the squared means (variance for regression, Gini for
classification); a leaf holds the mean, or the shares of the classes.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.models.histograms import GOLD, MAX_BINS, PAIR, TREE, Cells, Data, Packed, Tree, cells_of, drawn_sums, mix, prepare, tree_columns, uniforms, unpack

LOCAL_ROWS = 100_000
#: bytes of rows dealt out at once; more trees take several portions
DEALT_BYTES = 2 << 30
#: cells of one block of a local histogram
CELLS = 250_000
LEAST_GAIN = 1e-12
#: with more rows, no task meets all of them
WHOLE_ROWS = 50_000_000
#: bytes of rows that a task keeps in memory, and of rows whose nodes are grown at once
HELD_BYTES = 96 << 20
#: rows of a block of a task
BLOCK_ROWS = 1 << 19
#: nodes of a level of which a task holds the sums
MOST_SUMMED = 512
#: bins of the nodes of a level from which small nodes are summed over the bins that they have
SPARSE_FROM = 1 << 16


@dataclass
class ForestOptions:
    trees: int = 100
    max_depth: int = 10
    classes: int = 0  # 0: regression
    columns: int = 0  # features tried at a node; 0: all
    least_rows: int = 1
    least_rows_split: int = 2
    bins: int = MAX_BINS
    seed: int = 42
    local_rows: int = LOCAL_ROWS


# P(Poisson(1) <= k) for k = 0, 1, ...
POISSON = np.cumsum(np.exp(-1.0) / np.concatenate([[1.0], np.cumprod(np.arange(1.0, 16.0))]))


_DRAWS = np.searchsorted(POISSON, np.arange(1 << 16) / (1 << 16), side="right").astype(np.uint8)
_DRAWS[(POISSON[POISSON < 1] * (1 << 16)).astype(int)] = 255  # these numbers begin on either side of a threshold


def seeded(uid: np.ndarray, seed: int) -> np.ndarray:
    """What all trees' draws of the rows share."""
    return mix(uid.astype(np.uint64) * GOLD + np.uint64(seed + 1))


def drawn(shared: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree sees each row, from ``seeded``."""
    x = mix(mix(shared * GOLD + np.uint64(tree + 1)))
    out = _DRAWS.take((x >> np.uint64(48)).view(np.int64))
    near = np.flatnonzero(out == 255)
    out[near] = np.searchsorted(POISSON, (x[near] >> np.uint64(11)).astype(float) * 2.0**-53, side="right")
    return out


def copies(uid: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree sees each row: Poisson(1) at ``uniforms(uid, seed, tree)``."""
    return drawn(seeded(uid, seed), tree)


def channels(y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    """Weighted sums that a split separates: rows x 1, or rows x classes."""
    if not classes:
        return (y * w)[:, None]
    out = np.zeros((len(y), classes))
    out[np.arange(len(y)), y.astype(int)] = w
    return out


def tried(paths: np.ndarray, tree: int, d: int, opt: ForestOptions) -> np.ndarray:
    """nodes x features: which features a node tries. A node is named by its
    path from the root, so the choice doesn't depend on where it is grown."""
    if not 0 < opt.columns < d:
        return np.ones((len(paths), d), bool)
    draws = np.stack([uniforms(paths, opt.seed, tree, f) for f in range(d)], axis=1)
    return draws.argsort(axis=1).argsort(axis=1) < opt.columns


def gains(left: np.ndarray, total: np.ndarray, opt: ForestOptions) -> np.ndarray:
    """``left``: (channels, weight, rows) x nodes x cuts, sums of the left sides; ``total`` those of the
    nodes -> nodes x cuts, -inf where a side has too few rows."""
    def score(x):
        out = x[0] ** 2
        for c in x[1:-2]:
            out += c ** 2
        out /= x[-2]
        return out

    total = total[..., None]
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = score(total)
        gain = score(left)
        gain += score(total - left)
        gain -= whole
        ok = gain > LEAST_GAIN * np.maximum(np.abs(whole), 1e-300)
    ok &= left[-1] >= opt.least_rows
    ok &= total[-1] - left[-1] >= opt.least_rows
    ok &= total[-1] >= opt.least_rows_split
    gain[~ok] = -np.inf
    return gain


class _Best:
    """The best split so far of every node, tried features first."""

    def __init__(self, n: int, channels_: int):
        self.rank, self.gain = np.zeros(n, int), np.full(n, -np.inf)
        self.feature, self.bin = np.full(n, -1), np.zeros(n, int)
        self.left = np.zeros((n, channels_ + 2))

    def offer(self, at: np.ndarray, f: int, gain: np.ndarray, left: np.ndarray, rank: np.ndarray, bins: np.ndarray | None = None) -> None:
        """``gain`` nodes x cuts of the nodes ``at``, ``rank`` 2 for a tried feature, 1 for another. ``bins``: of the cuts, if not their numbers."""
        if not gain.shape[1]:
            return
        cut = gain.argmax(axis=1)
        top = gain[np.arange(len(at)), cut]
        better = (top > -np.inf) & ((rank > self.rank[at]) | ((rank == self.rank[at]) & (top > self.gain[at])))
        i, found = at[better], np.flatnonzero(better)
        self.rank[i], self.gain[i], self.feature[i] = rank[better], top[better], f
        self.bin[i] = cut[better] if bins is None else bins[found, cut[better]]
        self.left[i] = left[:, found, cut[better]].T


class _Sums:
    """Sums per cell over rows: (channels, weight, rows) x cells. Whole weights of one row each take one
    ``bincount`` for the weight and the count."""

    def __init__(self, y: np.ndarray, w: np.ndarray, classes: int, each: np.ndarray | None = None, pairs: bool | None = None):
        self.classes, self.k = classes, max(classes, 1) + 2
        self.pairs = each is None and not (w % 1).any() and w.sum() < PAIR and len(w) < PAIR if pairs is None else pairs
        self.kind = y.astype(int) if classes and self.pairs else None
        if self.pairs:
            self.columns = [w + PAIR] if classes else [y * w, w + PAIR]
        else:
            self.columns = [*channels(y, w, classes).T, w, None if each is None else each]

    def at(self, rows: np.ndarray) -> _Sums:
        """Of some rows, in their order."""
        out = object.__new__(_Sums)
        out.classes, out.k, out.pairs = self.classes, self.k, self.pairs
        out.kind = None if self.kind is None else self.kind[rows]
        out.columns = [None if c is None else c[rows] for c in self.columns]
        return out

    def raw(self, cell: np.ndarray, cells: int) -> np.ndarray:
        """What can be added up and then decoded."""
        if not self.pairs:
            return np.stack([np.bincount(cell, c, cells) for c in self.columns]).astype(float, copy=False)
        if self.classes:
            return np.bincount(cell * self.classes + self.kind, self.columns[0], cells * self.classes).reshape(cells, -1).T
        return np.stack([np.bincount(cell, c, cells) for c in self.columns])

    def decoded(self, raw: np.ndarray) -> np.ndarray:
        if not self.pairs:
            return raw
        out = np.empty((self.k, *raw.shape[1:]))
        pair = raw if self.classes else raw[1:]
        each = np.floor(pair / PAIR)
        out[:-2] = raw[:-1] if not self.classes else pair - each * PAIR
        out[-2] = out[:-2].sum(axis=0) if self.classes else pair[0] - each[0] * PAIR
        out[-1] = each.sum(axis=0)
        return out

    def __call__(self, cell: np.ndarray, cells: int) -> np.ndarray:
        return self.decoded(self.raw(cell, cells))


def _open(total: np.ndarray, exact: bool, opt: ForestOptions) -> np.ndarray:
    """Which nodes may have a split, by their sums; ``exact`` ones tell which have rows of one class only."""
    can = (total[:, -1] >= opt.least_rows_split) & (total[:, -1] >= 2 * opt.least_rows)
    if opt.classes and exact:
        can &= total[:, :-2].max(axis=1) < total[:, -2]
    return can


def _splits(bins: np.ndarray, rows: np.ndarray, node: np.ndarray, sums: _Sums, total: np.ndarray, first: np.ndarray, widths: list[int], opt: ForestOptions) -> _Best:
    """The best splits of the nodes of a level; ``rows`` and their ``node`` are sorted by node, ``first`` says which features a node tries.
    The others are looked at for nodes without a split by those."""
    count, k = len(total), sums.k
    best, level = _Best(count, k - 2), sums.at(rows)
    can = _open(total, sums.pairs, opt)
    size = np.diff(np.searchsorted(node, np.arange(count + 1)))

    def offer(f, at, rank):
        """Dense sums over all bins, or over as many as a small node has rows."""
        wide = widths[f] + 1
        few = np.zeros(len(at), int)
        if len(at) * wide > SPARSE_FROM:
            for most in (64, 16, 4):
                if 2 * most < wide:
                    few[size[at] <= most] = most
        for most in np.unique(few).tolist():
            nodes = at[few == most]
            step = max(1, CELLS // (most or wide))
            for i in range(0, len(nodes), step):
                part = nodes[i:i + step]
                if len(part) == count:
                    sel, own = slice(None), node
                else:
                    slot = np.full(count, -1)
                    slot[part] = np.arange(len(part))
                    own = slot[node]
                    sel = np.flatnonzero(own >= 0)
                    own = own[sel]
                b = bins[f].take(rows[sel])
                np.minimum(b, wide - 1, out=b)
                some = level.at(sel)
                if not most:
                    hist = some(own * wide + b, len(part) * wide).reshape(k, len(part), wide)
                    lefts, names = hist.cumsum(axis=2)[:, :, :-1], None
                else:
                    key = own * 256 + b
                    order = np.argsort(key)
                    key = key[order]
                    new = np.ones(len(key), bool)
                    new[1:] = key[1:] != key[:-1]
                    place = new.cumsum() - 1  # numbers the (node, bin) pairs
                    begin = np.searchsorted(key[new] >> 8, np.arange(len(part)))
                    place += (key >> 8) * most - begin[key >> 8]
                    cell = np.empty(len(key), np.int64)
                    cell[order] = place
                    names = np.zeros(len(part) * most, int)
                    names[place] = key & 255
                    names = names.reshape(-1, most)
                    lefts = some(cell, len(part) * most).reshape(k, len(part), most).cumsum(axis=2)
                best.offer(part, f, gains(lefts, total[part].T, opt), lefts, np.full(len(part), rank), names)

    for rank in (2, 1):
        for f, wide in enumerate(widths):
            at = np.flatnonzero(can & (first[:, f] if rank == 2 else ~first[:, f] & (best.rank < 2)))
            if wide and len(at):
                offer(f, at, rank)
    return best


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, path: int, depth: int, widths: list[int], opt: ForestOptions,
         each: np.ndarray | None = None) -> Packed:
    """A subtree in memory, level by level, from the rows of its top node. ``each``: how many rows an entry stands for."""
    d, n = bins.shape
    sums_ = _Sums(y, w, opt.classes, each)
    k = sums_.k
    feature, cut, left = [np.full(1, -1)], [np.zeros(1, int)], [np.zeros(1, int)]
    heavy, sums = [np.ones(1, bool)], [np.column_stack([channels(y, w, opt.classes), w, np.ones(n) if each is None else each]).sum(axis=0)[None]]
    first, count = 0, 1  # nodes of this level
    paths = np.array([path], np.uint64)
    rows, node = np.arange(n), np.zeros(n, int)  # rows that are still in open nodes, sorted by node
    for _ in range(depth, opt.max_depth):
        total = sums[-1]
        best = _splits(bins, rows, node, sums_, total, tried(paths, tree, d, opt), widths, opt)
        split = np.flatnonzero(best.feature >= 0)
        if not len(split):
            break
        feature[-1][split], cut[-1][split] = best.feature[split], best.bin[split]
        heavy[-1][split] = 2 * best.left[split, -2] >= total[split, -2]
        left[-1][split] = first + count + 2 * np.arange(len(split))
        below = np.empty((2 * len(split), k))
        below[0::2], below[1::2] = best.left[split], total[split] - best.left[split]
        slot = np.full(count, -1)
        slot[split] = np.arange(len(split))
        inside = slot[node] >= 0
        rows, node = rows[inside], node[inside]
        goes_right = bins[best.feature[node], rows] > best.bin[node]
        node = 2 * slot[node] + goes_right
        inside = _open(below, sums_.pairs, opt)[node]
        rows, node = rows[inside], node[inside]
        order = _by_node(node, 2 * len(split))
        rows, node = rows[order], node[order]
        paths = np.repeat(paths[split] * np.uint64(2), 2)
        paths[1::2] += np.uint64(1)
        first, count = first + count, 2 * len(split)
        for x, v in ((feature, -1), (cut, 0), (left, 0)):
            x.append(np.full(count, v))
        heavy.append(np.ones(count, bool))
        sums.append(below)
    total = np.concatenate(sums)
    value = total[:, :-2] / np.maximum(total[:, -2:-1], 1e-300)
    return Packed(np.concatenate(feature).astype(np.int32), np.concatenate(cut).astype(np.uint8), np.concatenate(left).astype(np.int32),
                  np.concatenate(heavy), value)


def _by_node(node: np.ndarray, count: int) -> np.ndarray:
    """The stable order by node; short integers are sorted by digits."""
    return np.argsort(node.astype(np.int16) if count < 1 << 15 else node, kind="stable")


def _paths(tree: Tree) -> list[int]:
    out = [1] * len(tree.feature)
    for v, f in enumerate(tree.feature):
        if f >= 0:
            out[tree.left[v]], out[tree.left[v] + 1] = 2 * out[v], 2 * out[v] + 1
    return out


def _level(data: Data, trees: list[Tree], first: int, wanted: list[list[int]], opt: ForestOptions) -> list[list[tuple]]:
    """One pass: (feature, cut, left sums, total) or None of every wanted node."""
    packed, d, k = [t.packed() for t in trees], len(data.edges), max(opt.classes, 1) + 2

    def run(chunks):
        sums = [np.zeros((d, len(nodes) * 256, k)) for nodes in wanted]
        for uid, bins, y, w, _ in chunks:
            for t, nodes in enumerate(wanted):
                if not nodes:
                    continue
                times = copies(uid, opt.seed, first + t).astype(float)
                slot = np.full(len(packed[t].feature), -1)
                slot[nodes] = np.arange(len(nodes))
                at = slot[packed[t].nodes(bins)]
                rows = np.flatnonzero((at >= 0) & (times > 0))
                weight = times[rows] * w[rows]
                stats = np.column_stack([channels(y[rows], weight, opt.classes), weight, np.ones(len(rows))])
                for f in range(d):
                    cell = at[rows] * 256 + bins[f, rows]
                    for c in range(k):
                        sums[t][f, :, c] += np.bincount(cell, stats[:, c], len(nodes) * 256)
        keys = [(t, f) for t, nodes in enumerate(wanted) if nodes for f in range(d)]
        yield {"tree": [t for t, _ in keys], "feature": [f for _, f in keys], "sums": [sums[t][f].tobytes() for t, f in keys]}

    found = [_Best(len(nodes), k - 2) for nodes in wanted]
    totals = [np.zeros((len(nodes), k)) for nodes in wanted]
    ranks = [tried(np.array([_paths(tree)[v] for v in nodes], np.uint64), first + t, d, opt) + 1 if nodes else None
             for t, (tree, nodes) in enumerate(zip(trees, wanted))]
    for r in sorted(data.sums(run), key=lambda r: (r["tree"], r["feature"])):
        t, f = r["tree"], r["feature"]
        hist = np.frombuffer(r["sums"]).reshape(-1, 256, k)
        totals[t] = hist.sum(axis=1)
        lefts = np.moveaxis(hist.cumsum(axis=1)[:, :len(data.edges[f])], 2, 0)
        found[t].offer(np.arange(len(hist)), f, gains(lefts, totals[t].T, opt), lefts, ranks[t][:, f])
    return [[(int(b.feature[i]), int(b.bin[i]), b.left[i], totals[t][i]) for i in range(len(nodes))] for t, (b, nodes) in enumerate(zip(found, wanted))]


def _portion(data: Data, first: int, count: int, opt: ForestOptions) -> list[Packed]:
    if data.rows <= WHOLE_ROWS:
        return _whole(data, first, count, opt)
    trees = [Tree() for _ in range(count)]
    sums: list[dict] = [{} for _ in trees]
    rows = [{0: float(data.rows)} for _ in trees]
    closed: list[set] = [set() for _ in trees]  # leaves that are done without their rows
    level = [[0] if data.rows > opt.local_rows else [] for _ in trees]
    depth = 0
    while any(level) and depth < opt.max_depth:
        found = _level(data, trees, first, level, opt)
        nexts: list[list[int]] = [[] for _ in trees]
        for t, nodes in enumerate(level):
            for v, (f, cut, left, total) in zip(nodes, found[t]):
                if f < 0:
                    closed[t].add(v)
                    sums[t][v] = total
                    continue
                child = trees[t].split(v, f, cut, bool(2 * left[-2] >= total[-2]))
                for c, s in ((child, left), (child + 1, total - left)):
                    sums[t][c], rows[t][c] = s, s[-1]
                    if s[-1] > opt.local_rows:
                        nexts[t].append(c)
        level, depth = nexts, depth + 1
    for t, nodes in enumerate(level):  # as deep as allowed
        closed[t].update(nodes)
    open_ = [{v for v, f in enumerate(tree.feature) if f < 0 and v not in closed[t]} for t, tree in enumerate(trees)]
    packed, widths = [t.packed() for t in trees], [len(e) for e in data.edges]
    depths, paths = [t.depth for t in trees], [_paths(t) for t in trees]
    d = len(widths)

    def deal(chunks):
        for uid, bins, y, w, _ in chunks:
            for t in range(count):
                if not open_[t]:
                    continue
                times, at = copies(uid, opt.seed, first + t), packed[t].nodes(bins)
                seen = np.flatnonzero(times > 0)
                seen = seen[np.argsort(at[seen], kind="stable")]
                nodes, starts = np.unique(at[seen], return_index=True)
                for v, i in zip(nodes.tolist(), np.split(seen, starts[1:])):
                    if v in open_[t]:
                        yield {"tree": [t], "node": [v], "bins": [np.ascontiguousarray(bins[:, i]).tobytes()], "y": [y[i].tobytes()],
                               "w": [(times[i] * w[i]).tobytes()], "uid": [uid[i].tobytes()]}

    def local(key, table):
        t, v = key[0].as_py(), key[1].as_py()
        parts = table.select(["bins", "y", "w", "uid"]).to_pylist()
        uid = np.concatenate([np.frombuffer(p["uid"], np.int64) for p in parts])
        order = np.argsort(uid, kind="stable")  # the same sums whatever the order of the parts
        bins = np.concatenate([np.frombuffer(p["bins"], np.uint8).reshape(d, -1) for p in parts], axis=1)[:, order]
        y, w = (np.concatenate([np.frombuffer(p[c]) for p in parts])[order] for c in ("y", "w"))
        p = grow(bins, y, w, first + t, paths[t][v], depths[t][v], widths, opt)
        return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([v], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in tree_columns(p).items()}})

    dealt = data.map(deal, "tree int, node int, bins binary, y binary, w binary, uid binary")
    subtrees: dict[tuple, Packed] = {}
    if any(open_):
        parts = min(count, 64) if data.rows <= opt.local_rows else None
        dealt = dealt.repartition(parts, "tree", "node") if parts else dealt.repartition("tree", "node")
        for r in dealt.groupBy("tree", "node").applyInArrow(local, TREE).collect():  # the model
            subtrees[r["tree"], r["node"]] = unpack(r)
    k = max(opt.classes, 1)
    return [_joined(trees[t], {v: subtrees[t, v] for v in sorted(open_[t]) if (t, v) in subtrees}, sums[t], k) for t in range(count)]


def _joined(tree: Tree, below: dict[int, Packed], sums: dict, k: int) -> Packed:
    """The top of a tree and its subtrees as one."""
    top = tree.packed()
    value = np.zeros((len(top.feature), k))
    for v, s in sums.items():
        value[v] = s[:k] / max(s[k], 1e-300)
    parts = {"feature": [top.feature.copy()], "bin": [top.bin.copy()], "left": [top.left.copy()], "missing_left": [top.missing_left.copy()], "value": [value]}
    at = len(top.feature)
    for v, p in below.items():
        left = np.where(p.feature >= 0, p.left + at - 1, 0).astype(np.int32)
        for name, x in (("feature", p.feature), ("bin", p.bin), ("left", left), ("missing_left", p.missing_left), ("value", p.value)):
            parts[name][0][v] = x[0]
            parts[name].append(x[1:])
        at += len(p.feature) - 1
    return Packed(*[np.concatenate(parts[n]) for n in ("feature", "bin", "left", "missing_left", "value")])


class _Blocks:
    """All binned rows inside a task, in blocks; beyond ``HELD_BYTES`` in a temporary file."""

    def __init__(self, chunks, d: int):
        self.d, self.rows, self.held, self.file, self.sizes, self.weighted = d, 0, [], None, [], []
        parts, n = [], 0
        for uid, bins, y, w, _ in chunks:
            parts.append((uid, bins, y, w))
            n += len(y)
            if n >= BLOCK_ROWS:
                self._add(parts)
                parts, n = [], 0
        if n:
            self._add(parts)

    def _add(self, parts) -> None:
        uid, bins, y, w = (np.concatenate(c, axis=c[0].ndim - 1) for c in zip(*parts))
        n = len(y)
        block = (uid, np.ascontiguousarray(bins), y, None if (w == 1).all() else w)
        self.rows += n
        if self.file is None and self.rows * (self.d + 24) > HELD_BYTES:
            self.file = tempfile.TemporaryFile()
            for b in self.held:
                self._write(b)
            self.held = []
        if self.file is None:
            self.held.append(block)
        else:
            self._write(block)
        self.sizes.append(n)
        self.weighted.append(block[3] is not None)

    def _write(self, block) -> None:
        for x in block:
            if x is not None:
                x.tofile(self.file)

    def read(self, uids: bool) -> Iterator[tuple]:
        """(uid, bins, y, w or None), perhaps without the uid."""
        if self.file is None:
            yield from self.held
            return
        self.file.flush()
        self.file.seek(0)
        for n, weighted in zip(self.sizes, self.weighted):
            if uids:
                uid = np.fromfile(self.file, np.int64, n)
            else:
                uid = self.file.seek(8 * n, 1) and None
            bins = np.fromfile(self.file, np.uint8, self.d * n).reshape(self.d, n)
            yield uid, bins, np.fromfile(self.file, float, n), np.fromfile(self.file, float, n) if weighted else None


def _whole(data: Data, first: int, count: int, opt: ForestOptions) -> list[Packed]:
    """Trees dealt to tasks that read all rows."""
    widths, d = [len(e) for e in data.edges], len(data.edges)
    groups = max(1, min(count, data.chunks.sparkSession.sparkContext.defaultParallelism))

    def part(group: int) -> DataFrame:
        def run(chunks):
            blocks = _Blocks(chunks, d)
            for t in range(first + group, first + count, groups):
                yield {"tree": [t], "node": [0], **{c: [x] for c, x in tree_columns(_tree(blocks, t, widths, opt)).items()}}

        return data.whole().map(run, TREE)

    rows = reduce(DataFrame.union, [part(g) for g in range(groups)]).collect()  # the model
    found = {r["tree"]: unpack(r) for r in rows}
    return [found[t] if t in found else _joined(Tree(), {}, {}, max(opt.classes, 1)) for t in range(first, first + count)]


def _tree(blocks: _Blocks, t: int, widths: list[int], opt: ForestOptions) -> Packed:
    """One tree. Nodes of many rows are split level by level in passes over the blocks, of two siblings the lighter one is summed;
    the rows of the others wait until their subtrees are grown from them."""
    d, k = blocks.d, max(opt.classes, 1) + 2
    tree, sums, closed = Tree(), {}, set()
    times, states, waiting = [], [], []  # of every block: draws, (rows, node) of the level, [(rows, node)] that wait
    for uid, *_ in blocks.read(True):
        times.append(drawn(seeded(uid, opt.seed), t))
        rows = np.flatnonzero(times[-1]).astype(np.int32)
        states.append((rows, np.zeros(len(rows), np.int32)))
        waiting.append([])
    many = blocks.rows > opt.local_rows

    def limit(nodes: int) -> int:
        """While the sums of a level are few, smaller nodes are split in passes, too: only one of two siblings is summed there."""
        return opt.local_rows // 16 if nodes <= MOST_SUMMED else opt.local_rows

    def stats(b, y, w, rows):
        weight = times[b][rows].astype(float)
        if w is not None:
            weight *= w[rows]
        return _Sums(y[rows], weight, opt.classes, None, not any(blocks.weighted))

    level, depth = [0], 0  # nodes that are split in passes
    if not many:
        level, waiting = [], [[(rows, np.zeros(len(rows), np.int32))] for rows, _ in states]
    kept: np.ndarray | None = None  # sums of the level above, by node
    routes: tuple | None = None  # splits of the level above, and the place of the children: in the level, or -2 - node
    while level:
        # which nodes are summed: lighter siblings, nodes without a sibling in the level
        place = {v: i for i, v in enumerate(level)}
        light, heavy = [], []  # (place) and (place, place of the light sibling, place of the parent)
        if depth:
            for parent, (v, up) in enumerate(zip(routes[3], routes[4])):
                pair = [c for c in (v, v + 1) if c in place]
                pair.sort(key=lambda c: sums[c][-1])
                light += [place[pair[0]]] if pair else []
                heavy += [(place[pair[1]], place[pair[0]], up)] if len(pair) == 2 else []
        else:
            light = [0]
        summed_ = np.full(len(level), -1)
        summed_[light] = np.arange(len(light))
        hist, some = None, None
        for b, (_, bins, y, w) in enumerate(blocks.read(False)):
            rows, node = states[b]
            n = bins.shape[1]
            if depth:
                feature, cut, child = routes[:3]
                right = bins.ravel().take(feature.take(node) * n + rows) > cut.take(node)
                node = child.take(2 * node + right)
                out = node < -1
                if out.any():
                    waiting[b].append((rows[out], -2 - node[out]))
                rows, node = rows[node >= 0], node[node >= 0]
                order = _by_node(node, len(level))
                rows, node = rows[order], node[order]
                states[b] = rows, node
            at = summed_.take(node)
            own = at >= 0
            rows, at = (rows, at) if own.all() else (rows[own], at[own])
            rows, base, cell = rows.astype(np.intp), at * 256, np.empty(len(at), np.int64)
            some = stats(b, y, w, rows)
            for f in range(d):
                np.add(base, bins[f].take(rows), out=cell)
                raw = some.raw(cell, len(light) * 256)
                if hist is None:
                    hist = np.zeros((d, *raw.shape))
                hist[f] += raw
        full = np.empty((d, k, len(level), 256))
        for f in range(d):
            full[f][:, light] = some.decoded(hist[f]).reshape(k, len(light), 256)
        hist = None
        for a, b, up in heavy:
            rest = kept[:, :, up] - full[:, :, b]
            rest[:, :, :] *= rest[:, -1:, :] > 0  # no rows: nothing, without the rounding of the difference
            full[:, :, a] = rest
        kept = full
        if not depth:
            sums[0] = full[0].sum(axis=2)[:, 0] if d else np.zeros(k)
        total = np.stack([sums[v] for v in level])
        best = _Best(len(level), k - 2)
        first = tried(np.array([_paths(tree)[v] for v in level], np.uint64), t, d, opt) + 1
        for f in range(d):
            lefts = full[f].cumsum(axis=2)[:, :, :widths[f]]
            best.offer(np.arange(len(level)), f, gains(lefts, total.T, opt), lefts, first[:, f])
        nexts, child = [], np.full(2 * len(level), -1)
        lefts_, ups = [], []
        depth += 1
        most = limit(2 * len(level))
        pair = np.stack([best.left, total - best.left], axis=1).reshape(-1, k)
        may = _open(pair, not any(blocks.weighted), opt) & (depth < opt.max_depth)
        for i, v in enumerate(level):
            if best.feature[i] < 0:
                closed.add(v)
                continue
            left = tree.split(v, int(best.feature[i]), int(best.bin[i]), bool(2 * best.left[i, -2] >= total[i, -2]))
            lefts_.append(left)
            ups.append(i)
            for side, (c, s) in enumerate(((left, best.left[i]), (left + 1, total[i] - best.left[i]))):
                sums[c] = s
                if not may[2 * i + side]:  # its rows are not needed any more
                    closed.add(c)
                elif s[-1] > most:
                    child[2 * i + side] = len(nexts)
                    nexts.append(c)
                else:
                    child[2 * i + side] = -2 - c
        routes = np.maximum(best.feature, 0), best.bin, child, lefts_, ups
        if not nexts:  # the rows of the last level still go to the nodes that wait
            for b, (_, bins, _, _) in enumerate(blocks.read(False)):
                rows, node = states[b]
                if (child < -1).any():
                    node = child.take(2 * node + (bins.ravel().take(routes[0].take(node) * bins.shape[1] + rows) > routes[1].take(node)))
                    waiting[b].append((rows[node < -1], -2 - node[node < -1]))
        level = nexts
    kept = states = None
    return _joined(tree, _subtrees(blocks, t, tree, times, waiting, widths, opt), sums, max(opt.classes, 1))


def _subtrees(blocks: _Blocks, t: int, tree: Tree, times: list, waiting: list, widths: list[int], opt: ForestOptions) -> dict[int, Packed]:
    """The subtrees of the nodes that wait, of as many nodes at once as ``HELD_BYTES`` has room for."""
    count, d, paths, out = len(tree.feature), blocks.d, _paths(tree), {}
    rows = np.zeros(count, np.int64)
    for parts in waiting:
        for _, node in parts:
            rows += np.bincount(node, minlength=count)
    open_ = np.flatnonzero(rows)
    batch = (rows[open_].cumsum() - rows[open_]) * (d + 40) // HELD_BYTES
    for turn in np.unique(batch):
        nodes = open_[batch == turn]
        slot = np.full(count, -1)
        slot[nodes] = np.arange(len(nodes))
        ends = rows[nodes].cumsum()
        free, n = ends - rows[nodes], int(ends[-1])
        uid, bins, y, w = np.empty(n, np.int64), np.empty((d, n), np.uint8), np.empty(n), np.empty(n)
        for b, (u, x, label, weight) in enumerate(blocks.read(True)):
            mine = [(r[keep], at[keep]) for r, at in ((r, slot.take(node)) for r, node in waiting[b]) for keep in [at >= 0]]
            if not mine or not sum(len(r) for r, _ in mine):
                continue
            r, at = (np.concatenate(c) for c in zip(*mine))
            order = _by_node(at, len(nodes))
            r, at = r[order], at[order]
            many = np.bincount(at, minlength=len(nodes))
            to = np.arange(len(r)) + (free - (many.cumsum() - many)).take(at)
            free += many
            uid[to], y[to], w[to] = u.take(r), label.take(r), times[b].take(r) * (1.0 if weight is None else weight.take(r))
            for f in range(d):
                bins[f, to] = x[f].take(r)
        for v, end in zip(nodes.tolist(), ends.tolist()):
            own = np.arange(end - rows[v], end)
            own = own[np.argsort(uid[own], kind="stable")]  # the same sums whatever the order of the rows
            out[v] = grow(bins[:, own], y[own], w[own], t, paths[v], tree.depth[v], widths, opt)
    return out


def fit(df: DataFrame, features: list[str], label: str, opt: ForestOptions, weight: str | None = None,
        rows_per_task: int | None = None) -> tuple[list[np.ndarray], list[Packed]]:
    """(cut values, trees)."""
    more = {} if rows_per_task is None else {"rows_per_task": rows_per_task}
    data = prepare(df, features, label, weight, None, opt.bins, keep=False, **more)
    at_once = opt.trees if data.rows <= WHOLE_ROWS else int(min(opt.trees, max(1, DEALT_BYTES // max(1, data.rows * (len(features) + 24)))))
    try:
        cells = cells_of(data) if not opt.classes and data.tasks > 1 else None
        if cells:
            return data.edges, _by_cells(data, cells, opt)
        out: list[Packed] = []
        if data.rows > WHOLE_ROWS:
            data = data.kept()
        for first in range(0, opt.trees, at_once):
            out += _portion(data, first, min(at_once, opt.trees - first), opt)
        return data.edges, out
    finally:
        data.release()


def _by_cells(data: Data, cells: Cells, opt: ForestOptions) -> list[Packed]:
    widths, seed = [len(e) for e in data.edges], opt.seed

    def run(batches):
        bins = cells.bins()
        for batch in batches:
            for tree, sums in zip(batch.column("tree").to_pylist(), batch.column("sums")):
                w, wy, each = np.frombuffer(sums.as_buffer()).reshape(3, -1)
                seen = np.flatnonzero(each)
                y = np.divide(wy, w, out=np.zeros_like(wy), where=w != 0)
                p = grow(bins[:, seen], y[seen], w[seen], tree, 1, 0, widths, opt, each[seen])
                yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "node": pa.array([0], pa.int32()),
                                                  **{c: pa.array([x], pa.binary()) for c, x in tree_columns(p).items()}})

    sums = drawn_sums(data, cells, opt.trees, drawn, lambda uid: seeded(uid, seed))
    return [unpack(r) for r in sorted(sums.mapInArrow(run, TREE).collect(), key=lambda r: r["tree"])]  # the model
