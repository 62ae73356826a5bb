"""Probabilities for classifiers that only have margins (§2.11 score_proba).

Platt's method: per class, a logistic curve over the margin, fitted to margins of rows that the
model had not seen (``FOLDS`` folds by a hash of the row), with Platt's softened targets. All
classes are fitted together; an iteration of Newton's method is one aggregate of five sums per class.
For more than two classes the curves' values are divided by their sum.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import saved

FOLDS = 3
MOST_ITERATIONS = 50


def margins(scored: DataFrame, n_classes: int) -> Column:
    """One margin per class; of two classes that of the second."""
    raw = vector_to_array("rawPrediction")
    return F.slice(raw, 2, 1) if n_classes == 2 else raw


def fit_curves(rows: DataFrame, n_classes: int) -> list[tuple[float, float]]:
    """(slope, offset) per margin from ``rows`` (m array, label)."""
    classes = [1] if n_classes == 2 else list(range(n_classes))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == c).alias(f"p{c}") for c in classes]).first()
    targets = []
    for c in classes:
        pos, neg = counts[f"p{c}"], counts["n"] - counts[f"p{c}"]
        targets.append(((pos + 1) / (pos + 2), 1 / (neg + 2)))
    curves = [(0.0, float(np.log((counts[f"p{c}"] + 1) / (counts["n"] - counts[f"p{c}"] + 1)))) for c in classes]

    def sums(curves):
        out = []
        for i, c in enumerate(classes):
            m, (a, b) = F.col("m")[i], curves[i]
            z = F.lit(a) * m + F.lit(b)
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
            t = F.when(F.col("label") == c, F.lit(targets[i][0])).otherwise(F.lit(targets[i][1]))
            loss = F.greatest(z, F.lit(0.0)) - t * z + F.log1p(F.exp(-F.abs(z)))
            h = p * (1 - p)
            out += [F.sum(x).alias(f"{n}{i}") for n, x in (("l", loss), ("g", (p - t) * m), ("k", p - t), ("hh", h * m * m), ("hm", h * m), ("h", h))]
        r = rows.agg(*out).first()
        return [[float(r[f"{n}{i}"] or 0.0) for n in ("l", "g", "k", "hh", "hm", "h")] for i in range(len(classes))]

    now, step = sums(curves), [1.0] * len(classes)
    for _ in range(MOST_ITERATIONS):
        tried, moved = [], False
        for (a, b), (_, g, k, hh, hm, h), s in zip(curves, now, step):
            da, db = np.linalg.solve([[hh + 1e-9, hm], [hm, h + 1e-9]], [g, k])
            tried.append((a - s * da, b - s * db))
            moved = moved or max(abs(s * da), abs(s * db)) > 1e-8 * (1 + max(abs(a), abs(b)))
        if not moved:
            break
        new = sums(tried)
        for i, (old, fresh) in enumerate(zip(now, new)):  # half the step where the loss rose
            if fresh[0] <= old[0] + 1e-12 * abs(old[0]):
                curves[i], now[i], step[i] = tried[i], fresh, min(1.0, 2 * step[i])
            else:
                step[i] /= 2
    return curves


def calibrated(train: DataFrame, fit: Callable, n_classes: int) -> list[tuple[float, float]]:
    """Curves for the model that ``fit(rows)`` gives (a fitted pipeline with rawPrediction)."""
    fold = F.pmod(F.xxhash64(F.lit(17), *[F.col(f"`{c}`") for c in train.columns]), F.lit(FOLDS))
    rows = None
    for k in range(FOLDS):
        rest = train.filter(fold != k)
        if rest.select("label").distinct().count() < 2:  # nothing to separate
            continue
        scored = fit(rest).transform(train.filter(fold == k))
        part = scored.select(margins(scored, n_classes).alias("m"), "label")
        rows = part if rows is None else rows.unionByName(part)
    return fit_curves(saved(rows, "margins"), n_classes) if rows is not None else [(1.0, 0.0)] * (1 if n_classes == 2 else n_classes)


def probability(m: Column, curves: list[tuple[float, float]]) -> Column:
    """Array of class probabilities from the margins."""
    p = [F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(a)) * m[i] + F.lit(float(b))))) for i, (a, b) in enumerate(curves)]
    if len(curves) == 1:
        return F.array(1 - p[0], p[0])
    total = sum(p[1:], p[0])
    return F.array(*[F.when(total > 0, x / total).otherwise(F.lit(1.0 / len(p))) for x in p])
