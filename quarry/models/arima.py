"""Seasonal ARIMA of any order, per series (§2.7 timeseries arima).

The differenced series w is regressed on its own lags and on lags of the innovations e (a
seasonal factor gives the lags s, 2s, ... and those around them, each with a coefficient of
its own). Innovations come from a long autoregression first and from the last
regression afterwards, ``ITERATIONS`` times, which approaches the conditional least squares
fit. Every regression is solved from grouped moment sums, and lags come from the
block-halo window, so no series is gathered; the state that forecasts start from is the last few values of
each series, as many as the orders say. Without differencing a constant is fitted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.models.forecast import SERIES, _series, solve_grouped
from quarry.models.served import read_meta, write_meta
from quarry.operators.sequence import indexed_window
from quarry.session import saved

ITERATIONS = 6


def lag_set(short: int, seasonal: int, s: int) -> list[int]:
    """Lags of a product of a polynomial of degree ``short`` and one of ``seasonal`` seasons."""
    return sorted({j + s * i for j in range(short + 1) for i in range(seasonal + 1)} - {0})


def difference(d: int, seasonal: int, s: int) -> np.ndarray:
    """Coefficients of (1 - B)^d (1 - B^s)^D by lag."""
    out = np.ones(1)
    for step, times in ((1, d), (s, seasonal)):
        for _ in range(times):
            factor = np.zeros(step + 1)
            factor[0], factor[step] = 1, -1
            out = np.convolve(out, factor)
    return out


def checked(order, seasonal_order) -> tuple[int, ...]:
    p, d, q = (int(v) for v in order)
    P, D, Q, s = (int(v) for v in (seasonal_order or (0, 0, 0, 0)))
    if min(p, d, q, P, D, Q) < 0 or (P + D + Q and s < 2):
        raise ValueError(f"order {order!r}, seasonal order {seasonal_order!r}: orders are at least 0, a season has at least 2 steps")
    return p, d, q, P, D, Q, s


class ARIMAModel:
    """Forecasts from each series' last state; a row at or before the last training row has none."""

    def __init__(self, state: DataFrame, spec: dict, index_col: str, series_key: str | None):
        self.state, self.spec, self.index_col, self.series_key = state, spec, index_col, series_key

    def transform(self, df: DataFrame) -> DataFrame:
        diff, ar, ma, constant = self.spec["diff"], self.spec["ar"], self.spec["ma"], self.spec["constant"]
        x = _series(df, self.series_key)
        last = x.groupBy(SERIES).agg(F.max(self.index_col).alias("__f_to")).join(self.state, SERIES)

        def run(batches):
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    name, to, t, ys, ws, es, coef = r
                    ys, ws, es = list(ys), list(ws), list(es)
                    for h in range(1, int(to - t) + 1):
                        w = coef[0] if constant else 0.0
                        at = 1 if constant else 0
                        for k, lag in enumerate(ar):
                            w += coef[at + k] * (ws[-lag] if lag <= len(ws) else 0.0)
                        for k, lag in enumerate(ma):  # later innovations are 0
                            w += coef[at + len(ar) + k] * (es[-lag] if lag <= len(es) else 0.0)
                        y = w - sum(c * (ys[-k] if k <= len(ys) else 0.0) for k, c in enumerate(diff) if k and c)
                        ws.append(w)
                        es.append(0.0)
                        ys.append(y)
                        out.append((name, int(t + h), y))
                yield pd.DataFrame(out, columns=[SERIES, "__f_at", "__f_pred"])

        ahead = last.select(SERIES, F.col("__f_to").cast("long"), "__f_t", "__f_y", "__f_w", "__f_e", "__f_coef")
        ahead = ahead.mapInPandas(run, f"{SERIES} string, __f_at long, __f_pred double")
        ahead = ahead.withColumnRenamed(SERIES, "__f_name")
        out = x.join(ahead, (F.col(SERIES).eqNullSafe(F.col("__f_name"))) & (F.col(self.index_col) == F.col("__f_at")), "left")
        return out.select(*df.columns, F.col("__f_pred").alias("prediction"))

    def save(self, path: str) -> str:
        self.state.write.mode("overwrite").parquet(f"{path}/state")
        write_meta(path, {"spec": self.spec, "index": self.index_col, "series": self.series_key})
        return path

    @classmethod
    def load(cls, spark, path: str) -> ARIMAModel:
        m = read_meta(spark, path)
        return cls(spark.read.parquet(f"{path}/state"), m["spec"], m["index"], m["series"])


def fit_arima(train: DataFrame, label: str, index_col: str, series_key: str | None, order, seasonal_order=None) -> ARIMAModel:
    p, d, q, P, D, Q, s = checked(order, seasonal_order)
    diff, ar, ma = difference(d, D, s), lag_set(p, P, s), lag_set(q, Q, s)
    constant = d + D == 0
    x = _series(train.select(*([F.col(series_key)] if series_key else []), F.col(index_col).cast("long").alias("__f_i"),
                             F.col(label).cast("double").alias("__f_y")), series_key).select(SERIES, "__f_i", "__f_y")
    used = [k for k, c in enumerate(diff) if k and c]
    if used:
        x = indexed_window(x, "__f_i", SERIES, {f"__f_y{k}": ("__f_y", k) for k in used})
    w = F.col("__f_y")
    for k in used:
        w = w + F.lit(float(diff[k])) * F.col(f"__f_y{k}")
    x = saved(x.withColumn("__f_w", w).select(SERIES, "__f_i", "__f_y", "__f_w"), "arima")
    first = list(range(1, max([*ma, p, 1]) + 9))
    if s > 24:  # not every lag of a long season
        first = sorted({*range(1, max(p, q) + 9), *[i * s + j for i in range(1, P + Q + 2) for j in range(-2, 3)]})
    wide = sorted({*ar, *(first if ma else [])})
    x = saved(indexed_window(x, "__f_i", SERIES, {f"__f_w{k}": ("__f_w", k) for k in wide}) if wide else x, "arima-lags")
    one = [F.lit(1.0)] if constant else []

    def regress(rows, columns):
        whole = F.col("__f_w").isNotNull()
        for c in columns:
            whole = whole & F.col(c).isNotNull()
        xs = [*one, *[F.col(c) for c in columns]]
        if not xs:
            return rows.withColumn("__f_e", F.col("__f_w")), None
        coef = saved(solve_grouped(rows.where(whole), xs, F.col("__f_w")).withColumnRenamed("coef", "__f_coef"), "arima-coef")
        fit = F.lit(0.0)
        for k, c in enumerate(xs):
            fit = fit + F.coalesce(F.col("__f_coef")[k], F.lit(0.0)) * F.coalesce(c, F.lit(0.0))
        known = F.when(whole, F.col("__f_w") - fit)
        return rows.join(coef, SERIES, "left").withColumn("__f_e", known).drop("__f_coef"), coef

    own = [f"__f_w{k}" for k in ar]
    if not ma:
        rows, coef = regress(x, own)
    else:
        rows, coef = regress(x, [f"__f_w{k}" for k in first])
        lags = [f"__f_e{k}" for k in ma]
        for _ in range(ITERATIONS):
            rows = saved(rows.select(*x.columns, F.col("__f_e")), "arima-e")
            rows = indexed_window(rows, "__f_i", SERIES, {f"__f_e{k}": ("__f_e", k) for k in ma}).drop("__f_e")
            # before the first innovation of a series there is none
            rows = saved(rows.select(*x.columns, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in lags]), "arima-ma")
            rows, coef = regress(rows, [*own, *lags])
    rows = saved(rows.select(SERIES, "__f_i", "__f_y", "__f_w", F.coalesce("__f_e", F.lit(0.0)).alias("__f_e")), "arima-e")
    end = rows.groupBy(SERIES).agg(F.max("__f_i").alias("__f_t"))
    keep = max([len(diff) - 1, *ar, *ma, 1])
    tail = rows.join(end, SERIES).where(F.col("__f_i") > F.col("__f_t") - keep)  # as many rows a series as the orders say
    tails = tail.groupBy(SERIES).agg(F.max("__f_t").alias("__f_t"), F.array_sort(F.collect_list(
        F.struct("__f_i", "__f_y", F.coalesce("__f_w", F.lit(0.0)).alias("__f_w"), "__f_e"))).alias("r"))
    state = tails.select(SERIES, "__f_t", *[F.col(f"r.{c}").alias(c) for c in ("__f_y", "__f_w", "__f_e")])
    n = len(one) + len(ar) + len(ma)
    if coef is None:
        state = state.withColumn("__f_coef", F.array().cast("array<double>"))
    else:
        state = state.join(coef, SERIES, "left").withColumn("__f_coef", F.coalesce("__f_coef", F.array_repeat(F.lit(0.0), n)))
    spec = {"diff": [float(c) for c in diff], "ar": ar, "ma": ma, "constant": constant}
    return ARIMAModel(saved(state, "arima-state"), spec, index_col, series_key)
