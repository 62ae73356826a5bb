"""Quality classifier: random Fourier features, ridge, isotonic calibration.

1. Every whole text becomes a vector of statistics (lengths, repetition,
   letter and symbol shares, line structure). No label, language, source or id
   enters it.
2. Statistics are standardised and mapped to ``n_fourier`` cosines whose inner
   products approximate a Gaussian kernel.
3. Each partition sums its share of the normal equations (a fixed-size
   matrix); the partial sums are added on the executors and eight of them
   reach the driver, which solves the ridge system of that fixed size.
4. Labelled rows that took no part in the fit are counted in narrow bins of
   the ridge score; pool-adjacent-violators on the bins gives an isotonic map
   to probabilities.

``FIT_ROWS`` bounds the labelled rows of the fit (a sample by hash of the id);
every document is scored.

Rows: a null text counts as empty; an empty text has a vector like any other
and is scored; a null doc_id has no label; repeated rows score alike; labels
that are null are no labels; without any label every score is 0.5; an empty
table gives no rows. Other columns are ignored (``keep`` returns them).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import column_lists, fresh, saved, with_schema

FIT_ROWS = 200_000
N_FOURIER = 256
RIDGE = 1e-3
SEED = 5
THRESHOLD = 0.3
BINS = 2048
NAMES = ("log_words log_chars word_length distinct_words top_word adjacent_repeats distinct_pairs upper digits spaces stops "
         "other_symbols top_symbol beyond_ascii entropy repeated_lines log_line_length no_letter_words short_words long_words "
         "odd_endings").split()
ASCII = np.zeros((6, 256))
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\r", ".,;:'\"?-")):
    ASCII[_i, [ord(c) for c in _chars]] = 1
ASCII[5, 33:127] = 1 - ASCII[:5, 33:127].sum(axis=0)
ENDINGS = frozenset(".,;:!?'\")]}")


def statistics(text: str) -> list[float]:
    """The vector of a text, in the order of ``NAMES``."""
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n = max(1, int(raw.sum()))
    upper, lower, digits, spaces, stops, other = ASCII @ raw / n
    p = raw[raw > 0] / n
    words = text.split()
    counts = Counter(words)
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    odd = no_letter = short = long = 0
    for w, k in counts.items():
        if not (w[-1].isalnum() or w[-1] in ENDINGS):
            odd += k
        if w.upper() == w.lower():
            no_letter += k
        if len(w) <= 2:
            short += k
        elif len(w) > 15:
            long += k
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return [np.log1p(len(words)), np.log1p(len(text)), min(sum(map(len, words)) / m, 40.0), len(counts) / m,
            max(counts.values(), default=0) / m, same / m, pairs / max(1, len(words) - 1), upper / max(1e-9, upper + lower),
            digits, spaces, stops, other, float((raw * ASCII[5]).max()) / n, float(raw[128:].sum()) / n,
            float(-(p * np.log(p)).sum()) if len(p) else 0.0, 1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(len(text) / max(1, len(lines))), no_letter / m, short / m, long / m, odd / m]


def statistics_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, x``: the vector of every row."""

    def run(batches):
        for ks, ts in column_lists(batches):
            yield {"doc_id": ks, "x": [[float(v) for v in statistics(t or "")] for t in ts]}

    return with_schema(df.select(F.col(key).cast("long"), text), run, "doc_id long, x array<double>")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.crc32(key.cast("string").cast("binary")) % n


class QualityModel:
    """Standardisation, cosines, ridge weights and the isotonic map."""

    def __init__(self, mean, scale, n_fourier=N_FOURIER, seed=SEED):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = np.asarray(mean, float), np.asarray(scale, float)
        # Gaussian kernel exp(-|x - y|^2 / (2 d)): unit width per standardised statistic
        self.omega = rng.normal(0, 1 / np.sqrt(d), (d, n_fourier))
        self.phase = rng.uniform(0, 2 * np.pi, n_fourier)
        self.weights = np.zeros(n_fourier + 1)
        self.at, self.to = np.array([0.0]), np.array([0.5])

    def fourier(self, x) -> np.ndarray:
        z = np.clip((np.asarray(x, float).reshape(-1, len(self.mean)) - self.mean) / self.scale, -6, 6)
        f = np.cos(z @ self.omega + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([f, np.ones((len(f), 1))])

    def raw(self, x) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x) -> np.ndarray:
        """Calibrated probability of label 1. A thousandth of it follows the
        raw score, so that rows of one calibration step keep their order."""
        r = self.raw(x)
        return np.clip(0.999 * np.interp(r, self.at, self.to) + 0.001 / (1 + np.exp(-np.clip(r, -30, 30))), 0, 1)


def isotonic(at, positive, total) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ordered bins: (places, probabilities)."""
    blocks: list[list[float]] = []
    for a, p, n in zip(at, positive, total):
        blocks.append([a * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], top)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _sums(rows: DataFrame, model: QualityModel) -> np.ndarray:
    """[Z'Z | Z'y] over all rows of (x, y)."""
    width = len(model.weights)

    def part(batches):
        total, seen = np.zeros((width, width + 1)), False
        for xs, ys in column_lists(batches):
            z = model.fourier(xs)
            total += z.T @ np.hstack([z, np.asarray(ys, float)[:, None]])
            seen = True
        if seen:
            yield {"m": [total.tobytes()]}

    def add(batches):
        total = np.zeros((width, width + 1))
        for (ms,) in column_lists(batches):
            for m in ms:
                total += np.frombuffer(m).reshape(total.shape)
        yield {"m": [total.tobytes()]}

    partial = with_schema(rows.select("x", "y"), part, "m binary")
    out = with_schema(partial.repartition(8), add, "m binary").collect()  # 8 matrices of fixed size
    return sum((np.frombuffer(r["m"]).reshape(width, width + 1) for r in out), np.zeros((width, width + 1)))


def fit(vectors: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, n_fourier: int = N_FOURIER, ridge: float = RIDGE) -> QualityModel:
    """Fit on ``vectors`` (doc_id, x) and ``labels`` (doc_id, y in {0, 1},
    calibrate boolean: rows for the calibration only)."""
    y = labels.filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).groupBy("doc_id").agg(
        F.max("y").cast("double").alias("y"), F.max("calibrate").alias("calibrate"))
    n = y.count()
    if n > fit_rows:
        y = y.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
    # at most about fit_rows rows, so the vectors need not move to meet them
    rows = saved(vectors.join(F.broadcast(saved(y, "labels")), "doc_id"), "labelled")
    train = rows.filter(~F.col("calibrate"))
    d = len(NAMES)
    m = train.agg(F.count(F.lit(1)), *[f(F.col("x")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    model = QualityModel([m[1 + 2 * i] or 0.0 for i in range(d)], [max(m[2 + 2 * i] or 0.0, 1e-3) for i in range(d)], n_fourier)
    if not m[0]:
        return model
    s = _sums(train, model)
    penalty = np.full(len(s), ridge * m[0] / n_fourier)
    penalty[-1] = 1e-9
    model.weights = np.linalg.solve(s[:, :-1] + np.diag(penalty), s[:, -1])

    def raw(batches):
        for xs, ys in column_lists(batches):
            yield {"r": model.raw(xs).tolist(), "y": ys}

    held = rows.filter("calibrate")
    if held.isEmpty():
        held = train
    scored = with_schema(held.select("x", "y"), raw, "r double, y double")
    place = F.round(F.least(F.greatest(F.col("r"), F.lit(-1.0)), F.lit(2.0)) * BINS).cast("int")
    bins = scored.groupBy(place.alias("b")).agg(F.avg("r").alias("r"), F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).orderBy("b").collect()
    at, pos, tot = [b["r"] for b in bins], [b["p"] for b in bins], [float(b["n"]) for b in bins]
    model.at, model.to = isotonic(at, pos, tot)
    return model


def labelled(labels: DataFrame, column: str, modulus: int, held: int, calibrate: int) -> DataFrame:
    """(doc_id, y, calibrate) of the rows that may be learnt from."""
    r = remainder(F.col("doc_id"), modulus)
    return labels.filter(r != held).select("doc_id", F.col(column).alias("y"), (r == calibrate).alias("calibrate"))


def score_documents(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; learns from
    ``labels.quality`` where crc32(doc_id) mod 5 is not 0 (4: calibration)."""
    vectors = saved(statistics_of(df), "statistics")
    model = fit(vectors, labelled(labels, "quality", 5, 0, 4))

    def run(batches):
        for ks, xs in column_lists(batches):
            yield {"doc_id": ks, "score": model.score(xs).tolist()}

    scored = with_schema(vectors, run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose score is at least ``threshold``, same columns.
    Texts are read twice (fit, filter) and never shuffled."""
    model = fit(saved(statistics_of(df), "statistics"), labelled(labels, "quality", 5, 0, 4))
    names = df.columns
    text, = fresh(df, "text_read")
    schema = df.withColumn(text, F.col("text")).schema

    def filtered(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                xs = [statistics(t or "") for t in part.column(len(names)).to_pylist()]
                yield part.filter(pa.array((model.score(xs) >= threshold).tolist(), pa.bool_()))

    return df.withColumn(text, F.col("text")).mapInArrow(filtered, schema).drop(text)
