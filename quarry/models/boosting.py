"""Gradient boosting over histograms (§2.7 xgboost, lightgbm, gradient boosting).

Every round adds one tree per output (one, or one per class). A tree is grown by passes over the
binned chunks: each pass sums gradient, curvature and rows per (node, feature,
bin); of two siblings only the one with fewer rows is summed, the other is the parent's
sums less these. Splits come from the sums on the driver.

``second``    gain by gradient and curvature with L1/L2 penalties and a least gain; leaf -G/(H + lambda)
              (xgboost, lightgbm)
``friedman``  gain by the squared means of the gradients; leaf by one Newton step (gradient boosting)

``depthwise`` growth splits all nodes of a level in one pass. ``leafwise`` growth always splits the leaf with the
largest gain until there are ``num_leaves``: since a node's best split doesn't depend
on the order, a pass finds the splits of all leaves that may be next, and the order is followed
on these; the tree is the one that splitting one by one gives.

Rows are sampled by a hash of row and round; one-side sampling (goss) keeps the rows of the largest
gradients and a hash sample of the rest with more weight. The first pass of a round adds the last trees to the
margins and keeps them for the others; every ``ROUNDS_PER_WRITE`` rounds they are written. Where all rows are one task's
(``rows_per_task``), that task grows all rounds by the same code, without a job per pass. So it is for the squared loss
where the features have few bins together (``histograms.cells_of``): rows of a cell have one margin, so the sums
of the rows that each round draws are made for all rounds in one pass, and the trees are grown over the cells.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.models.histograms import CHUNK, MAX_BINS, TREE, Cells, Data, LocalData, Packed, Tree, cells_of, drawn_sums, pack, prepare, tree_columns, uniforms, unpack
from quarry.session import saved

ROUNDS_PER_WRITE = 16
LEAST_GAIN = 1e-9
TREE_ARROW = pa.schema([("tree", pa.int32()), ("node", pa.int32()), *[(c, pa.binary()) for c in ("feature", "bin", "left", "missing_left", "value")]])
GRADIENT_CELLS = 2048  # cells of the histogram of gradient sizes for one-side sampling


@dataclass
class BoostOptions:
    objective: str = "squared"  # squared, logistic, softmax
    outputs: int = 1
    rounds: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6  # 0 or less: no bound (leafwise only)
    growth: str = "depthwise"
    num_leaves: int = 31
    criterion: str = "second"
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    least_gain: float = 0.0
    least_hessian: float = 1.0
    least_rows: int = 1
    least_rows_split: int = 2
    subsample: float = 1.0
    columns: float = 1.0
    one_side: tuple[float, float] | None = None  # shares of large and of other gradients
    bins: int = MAX_BINS
    seed: int = 42


def gradients(objective: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives, rows x outputs."""
    if objective == "squared":
        return margin - y[:, None], np.ones_like(margin)
    if objective == "logistic":
        p = 1 / (1 + np.exp(-margin))
        return p - y[:, None], np.maximum(p * (1 - p), 1e-16)
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return p - (y[:, None] == np.arange(margin.shape[1])), np.maximum(2 * p * (1 - p), 1e-16)


def with_trees(margin: np.ndarray, trees: list[Packed], bins: np.ndarray) -> np.ndarray:
    out = margin.copy()
    for k, t in enumerate(trees):
        out[:, k] += t.values(bins)[:, 0]
    return out


def sampled(opt: BoostOptions, uid: np.ndarray, size: np.ndarray, turn: int, threshold: float | None) -> np.ndarray | None:
    """What each row's statistics are multiplied by; None for all ones."""
    if opt.one_side:
        large, other = opt.one_side
        pick = uniforms(uid, opt.seed, turn) < other / (1 - large)
        return np.where(size >= threshold, 1.0, pick * ((1 - large) / other))
    if opt.subsample < 1:
        return (uniforms(uid, opt.seed, turn) < opt.subsample).astype(float)
    return None


def soft(g, alpha):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0) if alpha else g


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    left: np.ndarray  # gradient, curvature, rows
    right: np.ndarray


def best_split(hist: np.ndarray, features: list[int], widths: list[int], opt: BoostOptions) -> Split | None:
    """``hist``: features x 256 x (gradient, curvature, rows) of one node."""
    total = hist[0].sum(axis=0)
    if total[2] < opt.least_rows_split:
        return None
    left = np.cumsum(hist[:, :MAX_BINS - 1], axis=1)
    right = total - left
    (gl, hl, nl), (gr, hr, nr) = np.moveaxis(left, 2, 0), np.moveaxis(right, 2, 0)
    ok = (nl >= opt.least_rows) & (nr >= opt.least_rows) & (np.arange(MAX_BINS - 1) < np.array([widths[f] for f in features])[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        if opt.criterion == "friedman":
            gain = gl**2 / nl + gr**2 / nr - total[0]**2 / total[2]
        else:
            ok &= (hl >= opt.least_hessian) & (hr >= opt.least_hessian)
            whole = soft(total[0], opt.reg_alpha)**2 / (total[1] + opt.reg_lambda)
            gain = (soft(gl, opt.reg_alpha)**2 / (hl + opt.reg_lambda) + soft(gr, opt.reg_alpha)**2 / (hr + opt.reg_lambda) - whole) / 2 - opt.least_gain
    gain = np.where(ok & np.isfinite(gain), gain, -np.inf)
    i = int(np.argmax(gain))
    f, b = divmod(i, gain.shape[1])
    if not gain[f, b] > LEAST_GAIN:
        return None
    return Split(float(gain[f, b]), features[f], b, left[f, b].copy(), right[f, b].copy())


def leaf_value(stats: np.ndarray, opt: BoostOptions) -> float:
    g, h, n = stats
    if opt.criterion == "friedman":
        step = -g / (n if opt.objective == "squared" else h) if n and h > 0 else 0.0
        if opt.objective == "softmax":
            step *= 2 * (opt.outputs - 1) / opt.outputs
    else:
        step = -soft(g, opt.reg_alpha) / (h + opt.reg_lambda) if h + opt.reg_lambda > 0 else 0.0
    return float(step) * opt.learning_rate


class _Round:
    """The trees of one round while they grow."""

    def __init__(self, data: Data | LocalData, opt: BoostOptions, turn: int):
        self.data, self.opt, self.turn = data, opt, turn
        self.trees = [Tree() for _ in range(opt.outputs)]
        d = len(data.edges)
        self.widths = [len(e) for e in data.edges]  # cuts per feature
        rng = np.random.default_rng([opt.seed, turn])
        k = max(1, int(round(opt.columns * d))) if opt.columns < 1 else d
        self.features = [sorted(rng.choice(d, k, replace=False).tolist()) if k < d else list(range(d)) for _ in self.trees]
        self.hist: list[dict[int, np.ndarray]] = [{} for _ in self.trees]
        self.stats: list[dict[int, np.ndarray]] = [{} for _ in self.trees]
        self.found: list[dict[int, Split | None]] = [{} for _ in self.trees]
        self.parent: list[dict[int, int]] = [{} for _ in self.trees]
        self.threshold = self._threshold() if opt.one_side else None

    def _threshold(self) -> float:
        """The size of gradients (over all outputs) from which on they belong to
        the share that is always kept, at the resolution of one cell in ``GRADIENT_CELLS``
        of the logarithm's range."""
        opt = self.opt

        def run(chunks):
            cells = np.zeros(GRADIENT_CELLS)
            for _, _, y, w, margin in chunks:
                g, _ = gradients(opt.objective, margin, y)
                size = np.abs(g * w[:, None]).sum(axis=1)
                at = np.clip((np.log2(np.maximum(size, 2.0**-40)) + 40) * (GRADIENT_CELLS / 80), 0, GRADIENT_CELLS - 1).astype(int)
                cells += np.bincount(at, minlength=GRADIENT_CELLS)
            yield {"tree": [0], "feature": [0], "sums": [cells.tobytes()]}

        cells = np.frombuffer(self.data.sums(run)[0]["sums"])
        most = cells[::-1].cumsum()
        at = GRADIENT_CELLS - 1 - int(np.searchsorted(most, opt.one_side[0] * self.data.rows))
        return 2.0 ** (max(at, 0) * 80 / GRADIENT_CELLS - 40)

    def evaluate(self, wanted: list[list[int]]) -> None:
        """Sums and best splits of the wanted nodes: one pass."""
        asked, derived = [], []
        for k, nodes in enumerate(wanted):
            now, rest = [], []
            for v in nodes:
                sibling = v + 1 if v % 2 else v - 1  # the left child has an odd number
                if v and sibling in nodes and self.parent[k][v] in self.hist[k]:
                    few = min((v, sibling), key=lambda u: (self.stats[k][u][2], u))
                    (now if v == few else rest).append(v)
                else:
                    now.append(v)
            asked.append(now)
            derived.append(rest)
        if any(asked):
            self._sum(asked)
        for k, nodes in enumerate(derived):
            for v in nodes:
                p = self.parent[k][v]
                self.hist[k][v] = self.hist[k][p] - self.hist[k][v + 1 if v % 2 else v - 1]
        for k, nodes in enumerate(wanted):
            for v in nodes:
                self.stats[k].setdefault(v, self.hist[k][v][0].sum(axis=0))
                self.found[k][v] = best_split(self.hist[k][v], self.features[k], self.widths, self.opt)
            for v in nodes:  # a parent's sums are needed until both children have theirs
                if v:
                    self.hist[k].pop(self.parent[k][v], None)

    def _sum(self, asked: list[list[int]]) -> None:
        opt, turn, features, threshold = self.opt, self.turn, self.features, self.threshold
        trees = [t.packed() for t in self.trees]

        def run(chunks):
            sums = [np.zeros((len(features[k]), len(nodes) * 256, 3)) for k, nodes in enumerate(asked)]
            for uid, bins, y, w, margin, *each in chunks:  # each: how many rows an entry stands for
                g, h = gradients(opt.objective, margin, y)
                g, h = g * w[:, None], h * w[:, None]
                times = sampled(opt, uid, np.abs(g).sum(axis=1), turn, threshold)
                kept = np.arange(len(y)) if times is None else np.flatnonzero(times > 0)
                for k, nodes in enumerate(asked):
                    if not nodes:
                        continue
                    slot = {v: i for i, v in enumerate(nodes)}
                    found = [(slot[v], r) for v, r in trees[k].groups(bins, nodes, kept)]
                    rows = np.concatenate([r for _, r in found])
                    base = np.repeat([i * 256 for i, _ in found], [len(r) for _, r in found])
                    gk, hk = g[rows, k], h[rows, k]
                    nk = each[0][rows] if each else None
                    if times is not None:
                        gk, hk = gk * times[rows], hk * times[rows]
                    alike = nk is None and bool((hk == 1).all())  # the curvatures count the rows
                    for i, f in enumerate(features[k]):
                        cell = base + bins[f].take(rows)
                        sums[k][i, :, 0] += np.bincount(cell, gk, len(nodes) * 256)
                        count = np.bincount(cell, nk, len(nodes) * 256)
                        sums[k][i, :, 1] += count if alike else np.bincount(cell, hk, len(nodes) * 256)
                        sums[k][i, :, 2] += count
            keys = [(k, i) for k, nodes in enumerate(asked) if nodes for i in range(len(features[k]))]
            yield {"tree": [k for k, _ in keys], "feature": [i for _, i in keys], "sums": [sums[k][i].tobytes() for k, i in keys]}

        for k, nodes in enumerate(asked):
            for v in nodes:
                self.hist[k][v] = np.zeros((len(features[k]), 256, 3))
        for r in self.data.sums(run):
            part = np.frombuffer(r["sums"]).reshape(-1, 256, 3)
            for v, s in zip(asked[r["tree"]], part):
                self.hist[r["tree"]][v][r["feature"]] = s

    def split(self, k: int, v: int) -> tuple[int, int]:
        s = self.found[k][v]
        left = self.trees[k].split(v, s.feature, s.bin, s.left[1] >= s.right[1])
        for child, stats in ((left, s.left), (left + 1, s.right)):
            self.stats[k][child], self.parent[k][child] = stats, v
        return left, left + 1

    def depthwise(self) -> None:
        level = [[0] for _ in self.trees]
        for _ in range(self.opt.max_depth):
            if not any(level):
                break
            self.evaluate(level)
            level = [[c for v in nodes if self.found[k][v] for c in self.split(k, v)] for k, nodes in enumerate(level)]
        if self.opt.max_depth < 1:
            self.evaluate(level)

    def leafwise(self) -> None:
        self.evaluate([[0] for _ in self.trees])
        while True:
            wanted = []
            for k in range(len(self.trees)):
                order, unknown = self._order(k)
                wanted.append(unknown)
            if not any(wanted):
                break
            self.evaluate(wanted)
        for k, tree in enumerate(self.trees):
            self.trees[k], self.stats[k] = self._chosen(k, tree, self._order(k)[0])

    def _order(self, k: int) -> tuple[list[int], list[int]]:
        """Nodes in the order in which they are split, as far as known, and the leaves whose best
        split has to be known first."""
        tree, found = self.trees[k], self.found[k]
        heap = [(-found[0].gain, 0)] if found[0] else []
        order, unknown = [], []  # unknown: (splits before the one that made it, leaf)
        while heap and len(order) + 1 < self.opt.num_leaves:
            _, v = heapq.heappop(heap)
            order.append(v)
            kids = (tree.left[v], tree.left[v] + 1) if tree.feature[v] >= 0 else self.split(k, v)
            for c in kids:
                if 0 < self.opt.max_depth <= tree.depth[c]:
                    continue
                if c not in found:
                    unknown.append((len(order), c))
                elif found[c]:
                    heapq.heappush(heap, (-found[c].gain, c))
        # with all leaves made, those of the last split are never split
        full = len(order) + 1 >= self.opt.num_leaves
        return order, [c for made, c in unknown if not full or made < len(order)]

    def _chosen(self, k: int, tree: Tree, order: list[int]) -> tuple[Tree, dict[int, np.ndarray]]:
        """The tree with only the chosen splits."""
        out, at, stats = Tree(), {0: 0}, {0: self.stats[k][0]}
        for v in order:
            left = out.split(at[v], tree.feature[v], tree.bin[v], tree.missing_left[v])
            for i in range(2):
                at[tree.left[v] + i] = left + i
                stats[left + i] = self.stats[k][tree.left[v] + i]
        return out, stats

    def grown(self) -> list[Packed]:
        (self.leafwise if self.opt.growth == "leafwise" else self.depthwise)()
        for k, tree in enumerate(self.trees):
            tree.value = [leaf_value(self.stats[k][v], self.opt) if f < 0 else 0.0 for v, f in enumerate(tree.feature)]
        return [t.packed() for t in self.trees]


def start_margin(df: DataFrame, label: str, opt: BoostOptions, weight: str | None) -> list[float]:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    if opt.objective == "softmax":
        sums = [F.sum(F.when(y == k, w).otherwise(0.0)).alias(f"s{k}") for k in range(opt.outputs)]
        r = df.agg(F.sum(w).alias("w"), *sums).first()
        return [float(np.log(max((r[f"s{k}"] or 0.0) / r["w"], 1e-12))) for k in range(opt.outputs)]
    r = df.agg((F.sum(w * y) / F.sum(w)).alias("m")).first()
    m = float(r["m"] or 0.0)
    if opt.objective == "logistic":
        m = min(max(m, 1e-12), 1 - 1e-12)
        return [float(np.log(m / (1 - m)))]
    return [m]


def fit(df: DataFrame, features: list[str], label: str, opt: BoostOptions, weight: str | None = None,
        rows_per_task: int | None = None) -> tuple[list[float], list[np.ndarray], list[list[Packed]]]:
    """(start margins, cut values, trees by round and output)."""
    start = start_margin(df, label, opt, weight)
    more = {} if rows_per_task is None else {"rows_per_task": rows_per_task}
    data = prepare(df, features, label, weight, start, opt.bins, short_passes=True, **more)
    try:
        if data.tasks == 1:
            return start, data.edges, _in_one_task(data, opt)
        cells = cells_of(data) if opt.objective == "squared" and not opt.one_side else None
        return start, data.edges, _by_cells(data, cells, opt, start) if cells else _by_passes(data, opt)
    finally:
        data.release()


def _by_passes(data: Data, opt: BoostOptions) -> list[list[Packed]]:
    rounds: list[list[Packed]] = []
    first = data
    try:
        for turn in range(opt.rounds):
            older = data
            if rounds:
                def run(chunks, last=rounds[-1]):
                    for uid, bins, y, w, margin in chunks:
                        yield pack(uid, bins, y, w, with_trees(margin, last, bins))

                data = data.replaced(data.map(run, CHUNK), written=turn % ROUNDS_PER_WRITE == 0)
            rounds.append(_Round(data, opt, turn).grown())
            if older is not data:  # the round's first pass has made the new margins
                older.release()
        return rounds
    finally:
        if data is not first:
            data.release()


def _in_one_task(data: Data, opt: BoostOptions) -> list[list[Packed]]:
    edges, n = data.edges, data.rows

    def run(chunks):
        held = list(chunks)
        for turn in range(opt.rounds):
            trees = _Round(LocalData(held, edges, n), opt, turn).grown()
            held = [(uid, bins, y, w, with_trees(margin, trees, bins)) for uid, bins, y, w, margin in held]
            for k, t in enumerate(trees):
                yield {"tree": [turn * opt.outputs + k], "node": [0], **{c: [v] for c, v in tree_columns(t).items()}}

    found = [unpack(r) for r in sorted(data.whole().map(run, TREE).collect(), key=lambda r: r["tree"])]  # the model
    return [found[i:i + opt.outputs] for i in range(0, len(found), opt.outputs)]


def _by_cells(data: Data, cells: Cells, opt: BoostOptions, start: list[float]) -> list[list[Packed]]:
    edges, n, drawn, seed, share = data.edges, data.rows, opt.subsample < 1, opt.seed, opt.subsample
    times = (lambda uid, turn: uniforms(uid, seed, turn) < share) if drawn else None
    sums = saved(drawn_sums(data, cells, opt.rounds if drawn else 1, times), "cell-sums")

    def run(batches):
        bins = cells.bins()
        margin, whole = np.tile(np.array(start), (bins.shape[1], 1)), replace(opt, subsample=1.0)
        turn = 0
        for batch in batches:
            for r in batch.column("sums"):
                w, wy, each = np.frombuffer(r.as_buffer()).reshape(3, -1)
                y = np.divide(wy, w, out=np.zeros_like(wy), where=w != 0)
                for _ in range(1 if drawn else opt.rounds):
                    trees = _Round(LocalData([(None, bins, y, w, margin, each)], edges, n), whole, turn).grown()
                    margin = with_trees(margin, trees, bins)
                    columns = [{"tree": turn, "node": 0, **tree_columns(t)} for t in trees]
                    yield pa.RecordBatch.from_pylist(columns, TREE_ARROW)
                    turn += 1

    # as large as rounds x cells, in the order of the rounds
    found = sums.repartition(1).sortWithinPartitions("tree").mapInArrow(run, TREE).collect()
    return [[unpack(r)] for r in sorted(found, key=lambda r: r["tree"])]
