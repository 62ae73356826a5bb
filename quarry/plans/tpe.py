"""Trials that learn from earlier ones: a tree-structured Parzen estimator.

Finished trials are split by score into the best ones and the rest. For each
parameter two densities are formed, one from each part: numbers get a mixture of
normals at the seen values, cut at the bounds, each as wide as the gap to its
neighbours, plus a wide one for the whole range (in logarithms for log
parameters); categories get smoothed counts. A new trial takes, for each
parameter, the one of ``CANDIDATES`` draws from the first density at which the ratio of the
two is largest. The first ``STARTUP`` trials are those of ``sample_trials``.

``propose`` works on the trials of one experiment, a few hundred small rows;
``next_trials`` does so for a table of many experiments, one group each.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STARTUP = 10
CANDIDATES = 24
#: at most this share of the trials, and this many, are the best ones
BEST_SHARE, MOST_BEST = 0.1, 25


def _rng(*key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(":".join(map(str, key)).encode()).digest()[:8], "little"))


def _cdf(x):
    return 0.5 * (1 + np.vectorize(math.erf)(np.asarray(x, float) / math.sqrt(2)))


class _Numbers:
    """Parzen estimator on [low, high]; whole numbers are spread by half a step."""

    def __init__(self, spec: dict, values: list[float]):
        self.spec, self.log, self.step = spec, bool(spec.get("log")), float(spec.get("step", 1)) if spec["type"] == "int" else 0.0
        low, high = float(spec["low"]) - self.step / 2, float(spec["high"]) + self.step / 2
        self.low, self.high = (math.log(max(low, 1e-300)), math.log(high)) if self.log else (low, high)
        x = np.sort([math.log(v) if self.log else float(v) for v in values])
        width = self.high - self.low
        centres = np.append(x, (self.low + self.high) / 2)  # the last one is the prior
        order = np.argsort(centres, kind="stable")
        ends = np.concatenate([[self.low], centres[order], [self.high]])
        sigma = np.empty(len(centres))
        sigma[order] = np.maximum(ends[1:-1] - ends[:-2], ends[2:] - ends[1:-1])
        sigma = np.clip(sigma, width / min(100.0, 1.0 + len(centres)), width)
        sigma[-1] = width
        self.centres, self.sigma = centres, sigma
        self.mass = np.maximum(_cdf((self.high - centres) / sigma) - _cdf((self.low - centres) / sigma), 1e-12)

    def draw(self, rng: np.random.Generator, n: int) -> list:
        which = rng.integers(0, len(self.centres), n)
        out = []
        for i in which:
            while True:  # the bounds hold at least a third of every normal
                v = rng.normal(self.centres[i], self.sigma[i])
                if self.low <= v <= self.high:
                    break
            v = math.exp(v) if self.log else v
            if self.step:
                low, high = int(self.spec["low"]), int(self.spec["high"])
                steps = (high - low) // int(self.step)
                v = low + int(self.step) * min(max(round((v - low) / self.step), 0), steps)
            out.append(v)
        return out

    def logpdf(self, values: list) -> np.ndarray:
        x = np.array([math.log(v) if self.log else float(v) for v in values])[:, None]
        z = (x - self.centres) / self.sigma
        return np.log((np.exp(-z * z / 2) / (self.sigma * self.mass)).mean(axis=1) + 1e-300)


class _Choices:
    def __init__(self, spec: dict, values: list):
        self.choices = spec["choices"]
        counts = np.array([1.0 + sum(str(v) == str(c) for v in values) for c in self.choices])
        self.p = counts / counts.sum()

    def draw(self, rng: np.random.Generator, n: int) -> list:
        return [self.choices[i] for i in rng.choice(len(self.choices), n, p=self.p)]

    def logpdf(self, values: list) -> np.ndarray:
        at = {str(c): i for i, c in enumerate(self.choices)}
        return np.log(self.p[[at[str(v)] for v in values]])


def split_history(history: list[tuple[dict, float]]) -> tuple[list[dict], list[dict]]:
    """(best, rest) of (params, score); trials without a finite score take no part
    unless they failed with -inf, which are among the rest."""
    known = [(p, s) for p, s in history if s is not None and not math.isnan(s)]
    ranked = [p for p, _ in sorted(known, key=lambda t: -t[1])]  # stable: earlier trials first
    n = min(math.ceil(BEST_SHARE * len(ranked)), MOST_BEST)
    return ranked[:n], ranked[n:]


def propose(space: dict, history: list[tuple[dict, float]], trial: int, seed: int, experiment: str = "") -> dict:
    """Parameters of the next trial. The same history, trial number and seed give the same values."""
    best, rest = split_history(history)
    out = {}
    for name, spec in space.items():
        kind = _Choices if spec["type"] == "categorical" else _Numbers
        good, bad = (kind(spec, [p[name] for p in part if p.get(name) is not None or spec["type"] == "categorical"]) for part in (best, rest))
        drawn = good.draw(_rng(seed, experiment, trial, name), CANDIDATES)
        out[name] = drawn[int(np.argmax(good.logpdf(drawn) - bad.logpdf(drawn)))]
    return out


def next_trials(trials: DataFrame, space: dict, count: int, seed: int = 42) -> DataFrame:
    """``trials`` (experiment, trial_id, parameters, score) -> ``count`` further
    trials of every experiment. One group is one experiment's trials."""
    names = list(space)
    schema = T.StructType([trials.schema[c] for c in ("experiment", "trial_id", *names)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trial_id")
        history = [({c: r[c] for c in names}, r["score"]) for r in pdf.to_dict("records")]
        first, experiment = int(pdf["trial_id"].max()) + 1, pdf["experiment"].iloc[0]
        rows = [{"experiment": experiment, "trial_id": first + i, **propose(space, history, first + i, seed, experiment)} for i in range(count)]
        return pd.DataFrame(rows, columns=["experiment", "trial_id", *names])

    return trials.select("experiment", "trial_id", *names, F.col("score").cast("double")).groupBy("experiment").applyInPandas(run, schema)
