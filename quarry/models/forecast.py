"""Per-series forecasters re-aimed from the reference's single-machine
libraries (§2.7 timeseries ``arima`` and ``prophet``).

forecast_ar  ARIMA(1,1,1) without constant by two-stage least squares
             (Hannan & Rissanen 1982): difference, long AR for residuals,
             regress on the lagged difference and lagged residual; forecast
             h steps from the end of training in closed form.
forecast_trend_seasonal  piecewise-linear trend with hinge changepoints and
             Fourier seasonality on the real time column (Taylor & Letham
             2018), multiplicative via log(y) for series of positive values; per series a Laplace
prior on the hinges, by coordinate descent on its moment matrix, and ridge on the seasons.

Regressions are solved from grouped moment aggregates (one row per series
of fixed size), so no series is ever gathered in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import materialize
from quarry.models.served import read_meta, write_meta
from quarry.operators.sequence import indexed_window

SERIES = "__series"


def _series(df: DataFrame, series_key: str | None) -> DataFrame:
    return df.withColumn(SERIES, F.col(series_key).cast("string") if series_key else F.lit(""))


def sparse_solution(A: np.ndarray, b: np.ndarray, penalised: np.ndarray, weight: float, sweeps: int = 5000) -> np.ndarray:
    """:func:`sparse_solutions` of one system."""
    return sparse_solutions(A[None], b[None], penalised, np.array([weight]), sweeps)[0]


def sparse_solutions(A: np.ndarray, b: np.ndarray, penalised: np.ndarray, weight: np.ndarray, sweeps: int = 5000) -> np.ndarray:
    """For every system (first axis) the minimum of c'Ac/2 - b'c + weight * sum |c_j| over the penalised j, by coordinate
    descent. The other coefficients are eliminated first: they are the best ones for any choice of the penalised. The
    systems take their steps together and each stops when it has settled."""
    free = ~penalised
    out = np.zeros(b.shape)
    U = np.linalg.pinv(A[:, free][:, :, free], hermitian=True)
    cross = A[:, penalised][:, :, free] @ U
    S = A[:, penalised][:, :, penalised] - cross @ A[:, free][:, :, penalised]
    r = b[:, penalised] - np.einsum("ijk,ik->ij", cross, b[:, free])
    scale = np.einsum("ijj->ij", S).copy()
    most = np.einsum("ijj->ij", A)[:, penalised].max(axis=1, initial=0.0)
    usable = scale > 1e-10 * np.maximum(most, 1e-300)[:, None]
    found = np.zeros(r.shape)
    at = np.arange(len(b))  # systems that have not settled
    c, rows, q, d, use, w = found.copy(), S.transpose(1, 0, 2).copy(), r, scale, usable, weight
    for _ in range(sweeps):
        change = np.zeros(len(at))
        for j in range(c.shape[1]):
            z = q[:, j] - np.einsum("ik,ik->i", rows[j], c) + d[:, j] * c[:, j]
            with np.errstate(divide="ignore", invalid="ignore"):
                new = np.where(use[:, j], np.copysign(np.maximum(np.abs(z) - w, 0.0), z) / d[:, j], 0.0)
            change = np.maximum(change, np.where(use[:, j], np.abs(new - c[:, j]) * d[:, j], 0.0))
            c[:, j] = new
        going = ~(change <= 1e-7 * w)
        if not going.all():
            found[at[~going]] = c[~going]
            at, c, rows, q, d, use, w = at[going], c[going], rows[:, going], q[going], d[going], use[going], w[going]
            if not len(at):
                break
    found[at] = c
    out[:, penalised] = found
    out[:, free] = np.einsum("ijk,ik->ij", U, b[:, free] - np.einsum("ijk,ik->ij", A[:, free][:, :, penalised], found))
    return out


def solve_grouped(df: DataFrame, xs: list[Column], y: Column, ridge: float | list[float] = 0.0, group: str = SERIES) -> DataFrame:
    """Least squares per group from X'X and X'y sums: returns (group, coef
    array); ``ridge`` is one penalty or one per column. Each row contributes one vector of moment products; MLlib's
    ``Summarizer`` sums them per group (one JVM aggregate, partial sums on
    the map side), so a group is one fixed-size row however long it is; the
    small systems are solved with numpy inside ``applyInPandas``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    p = len(xs)
    prods = [xs[i] * xs[j] for i in range(p) for j in range(i, p)] + [xi * y for xi in xs]
    vec = array_to_vector(F.array(*[c.cast("double") for c in prods]))
    mom = df.select(group, vec.alias("__m")).groupBy(group).agg(Summarizer.sum(F.col("__m")).alias("__m"))
    mom = mom.select(group, vector_to_array("__m").alias("m"))
    iu = np.triu_indices(p)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g, m in zip(pdf[group], pdf["m"]):
            m = np.asarray(m, dtype=float)
            A = np.zeros((p, p))
            A[iu] = m[: len(iu[0])]
            A = A + np.triu(A, 1).T + np.diag(np.broadcast_to(np.asarray(ridge, dtype=float), p))
            b = m[len(iu[0]):]
            out.append((g, [float(c) for c in np.linalg.lstsq(A, b, rcond=None)[0]]))
        return pd.DataFrame(out, columns=[group, "coef"])

    return mom.groupBy(group).applyInPandas(solve, f"{group} string, coef array<double>")


class ARForecastModel:
    """Closed-form h-step forecast from each series' last training state."""

    def __init__(self, state: DataFrame, index_col: str, series_key: str | None):
        self.state, self.index_col, self.series_key = state, index_col, series_key

    def transform(self, df: DataFrame) -> DataFrame:
        x = _series(df, self.series_key).join(self.state, SERIES, "left")
        j = (F.col(self.index_col) - F.col("__f_t")).cast("double")
        phi, theta = F.col("__f_phi"), F.col("__f_theta")
        d1 = phi * F.col("__f_dy") + theta * F.col("__f_e")
        geo = F.when(F.abs(1 - phi) < 1e-9, j).otherwise((1 - F.pow(phi, j)) / (1 - phi))
        return x.withColumn("prediction", F.col("__f_y") + d1 * geo).select(*df.columns, "prediction")

    def save(self, path: str) -> str:
        self.state.write.mode("overwrite").parquet(f"{path}/state")
        write_meta(path, {"index": self.index_col, "series": self.series_key})
        return path

    @classmethod
    def load(cls, spark, path: str) -> "ARForecastModel":
        m = read_meta(spark, path)
        return cls(spark.read.parquet(f"{path}/state"), m["index"], m["series"])


class MultiHorizonModel:
    """One fitted model per step ahead; ``prediction`` is the array of their
    predictions."""

    def __init__(self, steps: list):
        self.steps = steps
        self.feature_cols = getattr(steps[0], "feature_cols", [])

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.steps):
            out = m.transform(out).withColumnRenamed("prediction", f"__f_step{i}")
            out = out.select(*df.columns, *[f"__f_step{k}" for k in range(i + 1)])
        return out.select(*df.columns, F.array(*[f"__f_step{i}" for i in range(len(self.steps))]).alias("prediction"))

    def save(self, path: str) -> str:
        for i, m in enumerate(self.steps):
            m.save(f"{path}/step{i}")
        write_meta(path, {"steps": len(self.steps), "kind": type(self.steps[0]).__name__})
        return path

    @classmethod
    def load(cls, spark, path: str) -> "MultiHorizonModel":
        from quarry.models import PipelineFitted, arima, tree_models

        m = read_meta(spark, path)
        kind = {c.__name__: c for c in (PipelineFitted, ARForecastModel, TrendSeasonalModel, arima.ARIMAModel, tree_models.TreeEnsembleModel)}[m["kind"]]
        return cls([kind.load(spark, f"{path}/step{i}") for i in range(m["steps"])])


def fit_forecast_ar(train: DataFrame, label: str, index_col: str, series_key: str | None, params: dict,
                    long_order: int = 3) -> ARForecastModel:
    """ARIMA(1,1,1), trend 'n' (no constant, as for d = 1), with forecasts in
    closed form; other orders are in ``models.arima``."""
    train = train.select(*([F.col(series_key)] if series_key else []), F.col(index_col).alias("__f_i"), F.col(label).cast("double").alias("__f_l"))
    state_index, index_col, label = index_col, "__f_i", "__f_l"
    x = _series(train.select(*([series_key] if series_key else []), index_col, label), series_key)
    x = indexed_window(x, index_col, SERIES, {"__f_y1": (label, 1)}).withColumn("__f_dy", F.col(label) - F.col("__f_y1"))
    specs = {f"__f_dy{k}": ("__f_dy", k) for k in range(1, long_order + 1)}
    x = indexed_window(x, index_col, SERIES, specs).transform(materialize)
    full = x.where(F.col(f"__f_dy{long_order}").isNotNull())
    c1 = solve_grouped(full, [F.col(f"__f_dy{k}") for k in range(1, long_order + 1)], F.col("__f_dy"))
    fit1 = sum(F.col("coef")[k - 1] * F.col(f"__f_dy{k}") for k in range(1, long_order + 1))
    r = x.join(c1, SERIES, "left").withColumn("__f_e", F.col("__f_dy") - fit1).drop("coef")
    r = indexed_window(r, index_col, SERIES, {"__f_e1": ("__f_e", 1)}).transform(materialize)
    stage2 = r.where(F.col("__f_e1").isNotNull() & F.col("__f_dy1").isNotNull())
    c2 = solve_grouped(stage2, [F.col("__f_dy1"), F.col("__f_e1")], F.col("__f_dy"))
    last = r.groupBy(SERIES).agg(
        F.max(index_col).alias("__f_t"),
        F.max_by(F.struct(F.col(label).alias("__f_y"), F.col("__f_dy"), F.col("__f_e")), F.col(index_col)).alias("s"),
    ).select(SERIES, "__f_t", "s.*")
    state = last.join(c2, SERIES, "left").select(
        SERIES, "__f_t", F.coalesce(F.col("coef")[0], F.lit(0.0)).alias("__f_phi"),
        F.coalesce(F.col("coef")[1], F.lit(0.0)).alias("__f_theta"), "__f_y",
        F.coalesce(F.col("__f_dy"), F.lit(0.0)).alias("__f_dy"), F.coalesce(F.col("__f_e"), F.lit(0.0)).alias("__f_e"),
    ).transform(materialize)
    return ARForecastModel(state, state_index, series_key)


# ----------------------------------------------------------------- trend + seasonality
DAY = 86400.0


def _design(time_col: str, n_cp: int, seasons: list[tuple[float, int, float]]) -> list[Column]:
    """Columns: 1, t, hinges max(0, t - c_j) over the first 80 % of the range,
    then sin/cos pairs for each (period_days, order, least span in days)."""
    secs = F.unix_micros(F.col(time_col).cast("timestamp")).cast("double") / 1e6
    span = F.col("__tmax") - F.col("__tmin")
    t = (secs - F.col("__tmin")) / F.greatest(span, F.lit(1e-9))
    cols = [F.lit(1.0), t]
    for j in range(1, n_cp + 1):
        cols.append(F.greatest(t - F.lit(0.8 * j / (n_cp + 1)), F.lit(0.0)))
    days = secs / DAY
    for period, order, least in seasons:
        on = span >= least * DAY  # a season takes part in a series that is long enough
        for k in range(1, order + 1):
            arg = F.lit(2 * math.pi * k / period) * days
            cols += [F.when(on, F.sin(arg)).otherwise(0.0), F.when(on, F.cos(arg)).otherwise(0.0)]
    return cols


SEASONS = [(365.25, 10, 730.0), (7.0, 3, 14.0), (1.0, 4, 2.0)]


#: of the Laplace prior on changes of the slope, in units of the series' size over its whole range
CHANGE_SCALE = 0.05
#: noise is taken to be at least this share of the series' size
LEAST_NOISE = 0.005
#: rounds of fit and noise estimate
NOISE_ROUNDS = 5


#: series that are solved together
SERIES_AT_ONCE = 1024


def _series_sums(batches, p: int):
    """(series, sums of the products of all columns, rows, size) of rows in the order of their series."""
    now, sums, n, size = None, None, 0, 0.0
    done: list = []
    for batch in batches:
        names = batch.column(0).to_pylist()
        z = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(p + 1)], axis=1)
        cuts = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(names)]):
            if a == b:
                continue
            if sums is None or names[a] != now:
                if sums is not None:
                    done.append((now, sums, n, size))
                now, sums, n, size = names[a], np.zeros((p + 1, p + 1)), 0, 0.0
            part = z[a:b]
            sums += part.T @ part
            n, size = n + len(part), max(size, float(np.abs(part[:, p]).max()))
        if len(done) >= SERIES_AT_ONCE:
            yield done
            done = []
    if sums is not None:
        done.append((now, sums, n, size))
    if done:
        yield done


def _trends(A: np.ndarray, b: np.ndarray, yy: np.ndarray, n: np.ndarray, size: np.ndarray, ridge: list[float], changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, noise) per series: fit and noise estimate in turn."""
    P = A + np.diag(np.where(changes, 0.0, ridge))
    sigma, out = LEAST_NOISE * size, np.zeros(b.shape)
    at = np.arange(len(b))  # series whose noise has not settled
    for _ in range(NOISE_ROUNDS):
        c = sparse_solutions(P[at], b[at], changes, sigma[at]**2 / (CHANGE_SCALE * size[at]))
        out[at] = c
        rest = np.maximum(yy[at] - 2 * np.einsum("ij,ij->i", c, b[at]) + np.einsum("ij,ijk,ik->i", c, A[at], c), 0.0)
        new = np.maximum(np.sqrt(rest / np.maximum(n[at], 1.0)), LEAST_NOISE * size[at])
        going = ~(np.abs(new - sigma[at]) < 1e-3 * sigma[at])
        at = at[going]
        if not len(at):
            break
        sigma[at] = new[going]
    return out, sigma


def solve_trend(df: DataFrame, xs: list[Column], y: Column, ridge: list[float], n_cp: int) -> DataFrame:
    """(series, coef, sigma, change) per series from moment sums: a Laplace prior on the
    slope changes (most are exactly 0), normal ones by ``ridge``. ``sigma`` is the noise, ``change`` the mean
    absolute slope change. Rows are dealt by ranges of (series, time), so a long series is several tasks'; a task adds up the
    products of its series in numpy, and a few sums per series are added and solved, many series at once."""
    p = len(xs)
    cols = [c.cast("double").alias(f"x{i}") for i, c in enumerate(xs)]
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(SERIES, *cols, y.cast("double").alias("y")).repartitionByRange(parts, SERIES, "x1").sortWithinPartitions(SERIES)
    upper = np.triu_indices(p + 1)
    changes = np.zeros(p, bool)
    changes[2:2 + n_cp] = True

    def sums(batches):
        for done in _series_sums(batches, p):
            yield pa.RecordBatch.from_pydict({SERIES: pa.array([d[0] for d in done], pa.string()), "m": [d[1][upper].tobytes() for d in done],
                                              "n": pa.array([float(d[2]) for d in done]), "size": pa.array([d[3] for d in done])})

    def solve(batches):
        held: dict = {}

        def solved():
            m = np.array([v[0] for v in held.values()])
            G = np.zeros((len(m), p + 1, p + 1))
            G[:, upper[0], upper[1]] = G[:, upper[1], upper[0]] = m
            n, size = np.array([v[1] for v in held.values()]), np.array([v[2] or 1.0 for v in held.values()])
            c, sigma = _trends(G[:, :p, :p], G[:, :p, p], G[:, p, p], n, size, ridge, changes)
            change = np.abs(c[:, changes]).mean(axis=1) if n_cp else np.zeros(len(m))
            return pa.RecordBatch.from_pydict({SERIES: pa.array(list(held), pa.string()), "coef": pa.array(c.tolist(), pa.list_(pa.float64())),
                                               "sigma": pa.array(sigma), "change": pa.array(change)})

        for batch in batches:
            for r in batch.to_pylist():
                name, m = r[SERIES], np.frombuffer(r["m"])
                if name not in held and len(held) >= SERIES_AT_ONCE:  # all sums of a series come one after the other
                    yield solved()
                    held.clear()
                old = held.get(name)
                held[name] = (m, r["n"], r["size"]) if old is None else (old[0] + m, old[1] + r["n"], max(old[2], r["size"]))
        if held:
            yield solved()

    added = rows.mapInArrow(sums, f"{SERIES} string, m binary, n double, size double")
    return added.repartition(parts, SERIES).sortWithinPartitions(SERIES).mapInArrow(solve, f"{SERIES} string, coef array<double>, sigma double, change double")


class TrendSeasonalModel:
    def __init__(self, coefs: DataFrame, time_col: str, series_key: str | None, n_cp: int, seasons: list):
        self.coefs, self.time_col, self.series_key, self.n_cp, self.seasons = coefs, time_col, series_key, n_cp, seasons

    def intervals(self, df: DataFrame, share: float = 0.8) -> DataFrame:
        """The rows with ``prediction, prediction_lower, prediction_upper``: noise, and
        beyond the training range the slope changes that may come (as often and as large as those
        found), as a normal interval."""
        from statistics import NormalDist

        z = NormalDist().inv_cdf(0.5 + share / 2)
        x = self.transform(df)
        x = _series(x, self.series_key).join(self.coefs.drop("__f_coef"), SERIES, "left")
        secs = F.unix_micros(F.col(self.time_col).cast("timestamp")).cast("double") / 1e6
        ahead = F.greatest((secs - F.col("__tmax")) / F.greatest(F.col("__tmax") - F.col("__tmin"), F.lit(1e-9)), F.lit(0.0))
        wide = F.lit(z) * F.sqrt(F.pow("__f_sigma", 2) + F.lit(2.0 * self.n_cp / 3) * F.pow("__f_change", 2) * F.pow(ahead, 3))
        centre = F.when(F.col("__f_log"), F.log("prediction")).otherwise(F.col("prediction"))

        def back(c):
            return F.when(F.col("__f_log"), F.exp(c)).otherwise(c)

        return x.select(*df.columns, "prediction", back(centre - wide).alias("prediction_lower"), back(centre + wide).alias("prediction_upper"))

    def transform(self, df: DataFrame) -> DataFrame:
        x = _series(df, self.series_key).join(self.coefs, SERIES, "left")
        cols = _design(self.time_col, self.n_cp, self.seasons)
        xs = F.array(*[c.cast("double") for c in cols])
        dot = F.aggregate(F.zip_with(F.col("__f_coef"), xs, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        return x.withColumn("prediction", F.when(F.col("__f_log"), F.exp(dot)).otherwise(dot)).select(*df.columns, "prediction")

    def save(self, path: str) -> str:
        self.coefs.write.mode("overwrite").parquet(f"{path}/coefs")
        write_meta(path, {"time": self.time_col, "series": self.series_key, "changepoints": self.n_cp, "seasons": self.seasons})
        return path

    @classmethod
    def load(cls, spark, path: str) -> "TrendSeasonalModel":
        m = read_meta(spark, path)
        return cls(spark.read.parquet(f"{path}/coefs"), m["time"], m["series"], m["changepoints"], [tuple(s) for s in m["seasons"]])


def fit_forecast_trend_seasonal(train: DataFrame, label: str, time_col: str, series_key: str | None, params: dict,
                                n_changepoints: int = 25, ridge: float = 1.0) -> TrendSeasonalModel:
    """A Laplace prior on the slope changes and ridge on seasons: intercept and slope are free, so a
    constant or linear series is met exactly, and a series without breaks has none. Seasons and the multiplicative
    mode (log scale, for a series of positive values) are decided per series."""
    mode = params.get("seasonality_mode", "multiplicative")
    if mode not in ("multiplicative", "additive"):
        raise ValueError(f"unknown seasonality_mode {mode!r}")
    n_cp = int(params.get("n_changepoints", n_changepoints))
    secs = F.unix_micros(F.col(time_col).cast("timestamp")).cast("double") / 1e6
    x = _series(train, series_key).where(F.col(label).isNotNull() & F.col(time_col).isNotNull())
    rng = x.groupBy(SERIES).agg(F.min(secs).alias("__tmin"), F.max(secs).alias("__tmax"),
                                (F.lit(mode == "multiplicative") & (F.min(label) > 0)).alias("__f_log")).transform(materialize)
    span = rng.agg(F.max(F.col("__tmax") - F.col("__tmin"))).first()[0] or 0.0
    seasons = [s for s in SEASONS if span >= s[2] * DAY]
    y = F.when(F.col("__f_log"), F.log(F.col(label))).otherwise(F.col(label).cast("double"))
    design = _design(time_col, n_cp, seasons)
    penalty = [0.0, 0.0] + [ridge] * (len(design) - 2)
    coefs = solve_trend(x.join(rng, SERIES), [c.cast("double") for c in design], y, penalty, n_cp)
    for name in ("coef", "sigma", "change"):
        coefs = coefs.withColumnRenamed(name, f"__f_{name}")
    return TrendSeasonalModel(coefs.join(rng, SERIES).transform(materialize), time_col, series_key, n_cp, seasons)
