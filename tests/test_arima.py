"""Planted ARIMA coefficients and forecasts."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.models import fit_model
from quarry.models.arima import difference, lag_set
from quarry.models.served import ServedModel, load_model


def simulate(n, ar, ma, diff, seed, constant=0.0):
    """``ar`` and ``ma`` by lag; integrated by ``diff``."""
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 400)
    w = np.zeros(n + 400)
    for t in range(60, n + 400):
        w[t] = constant + sum(c * w[t - k] for k, c in ar.items()) + e[t] + sum(c * e[t - k] for k, c in ma.items())
    y = np.zeros(n + 400)
    for t in range(60, n + 400):
        y[t] = w[t] - sum(c * y[t - k] for k, c in enumerate(diff) if k)
    return y[400:], w[400:], e[400:]


def frame(spark, ys):
    rows = [(s, i, float(v)) for s, y in ys.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "s string, position long, label double")


CASES = [
    ((2, 1, 1), None, {1: 0.5, 2: -0.3}, {1: 0.4}, 0.0),
    ((1, 0, 1), None, {1: 0.7}, {1: -0.4}, 2.0),
    ((0, 1, 1), (0, 1, 1, 12), {}, {1: -0.4, 12: -0.5, 13: 0.2}, 0.0),
    ((1, 0, 0), (1, 0, 0, 4), {1: 0.5, 4: 0.4, 5: -0.2}, {}, 1.0),
]


@pytest.mark.parametrize("order,seasonal,ar,ma,constant", CASES, ids=lambda v: str(v))
def test_planted_coefficients_and_forecasts(spark, tmp_path, order, seasonal, ar, ma, constant):
    s = seasonal or (0, 0, 0, 0)
    diff = difference(order[1], s[1], s[3])
    assert lag_set(order[0], s[0], s[3]) == sorted(ar) and lag_set(order[2], s[2], s[3]) == sorted(ma)
    ys = {name: simulate(6000, ar, ma, diff, seed, constant) for name, seed in (("a", 1), ("b", 2))}
    df = frame(spark, {k: v[0] for k, v in ys.items()})
    train = df.where("position < 5990")
    m = fit_model("timeseries", "arima", train, [], {"order": order, "seasonal_order": seasonal}, series_key="s")
    coef = {r["__series"]: r["__f_coef"] for r in m.state.collect()}
    want = ([constant] if order[1] + s[1] == 0 else []) + [ar[k] for k in sorted(ar)] + [ma[k] for k in sorted(ma)]
    for name in ys:
        got = np.array(coef[name])
        assert np.abs(got[-len(ar) - len(ma):] - want[-len(ar) - len(ma):]).max() < 0.08, (got, want)
    out = {(r["s"], r["position"]): r["prediction"] for r in m.transform(df.withColumn("other", F.lit(1))).collect()}
    assert len(out) == 12000 and out["a", 10] is None
    for name, (y, w, e) in ys.items():
        # the forecast that the planted process gives from the true past
        yy, ww, ee = list(y[:5990]), list(w[:5990]), list(e[:5990])
        for t in range(5990, 6000):
            v = constant + sum(c * ww[t - k] for k, c in ar.items()) + sum(c * ee[t - k] for k, c in ma.items())
            yy.append(v - sum(c * yy[t - k] for k, c in enumerate(diff) if k))
            ww.append(v)
            ee.append(0.0)
            assert abs(out[name, t] - yy[t]) < 0.12 * (1 + (t - 5989) * (len(diff) > 1)), (t, out[name, t], yy[t])
    ServedModel(m, []).save(str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m")).transform(df.where("position >= 5990"))
    assert {(r["s"], r["position"]): r["prediction"] for r in again.collect()} == {k: v for k, v in out.items() if k[1] >= 5990}


def test_short_and_constant_series(spark):
    df = frame(spark, {"long": np.full(60, 5.0), "short": [1.0, 2.0], "one": [3.0]})
    m = fit_model("timeseries", "arima", df, [], {"order": (2, 0, 1)}, series_key="s")
    later = spark.createDataFrame([(s, 60 + i, 0.0) for s in ("long", "short", "one", "new") for i in range(3)], "s string, position long, label double")
    got = {(r["s"], r["position"]): r["prediction"] for r in m.transform(later).collect()}
    assert len(got) == 12 and all(abs(got["long", 60 + i] - 5.0) < 1e-6 for i in range(3)) and got["new", 60] is None
    assert all(np.isfinite(got[s, 60]) for s in ("short", "one"))
    m = fit_model("timeseries", "arima", df, [], {"order": (0, 1, 0)}, series_key="s")
    assert m.transform(later).filter("s = 'short'").first()["prediction"] == 2.0
    with pytest.raises(ValueError):
        fit_model("timeseries", "arima", df, [], {"order": (1, 0, 0), "seasonal_order": (1, 0, 0, 1)}, series_key="s")
