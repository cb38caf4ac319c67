"""Windows of any length against plain rules: both ways of every operator, offsets, gaps, long histories."""

import bisect
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from crossbar.operators import series as t
from crossbar.plans.expr import evaluate, field

F1, F2 = field("f1"), field("f2")
ROWS = 260


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    parts = []
    for n in range(3):
        x, m = rng.normal(size=ROWS).round(1), rng.normal(size=ROWS)
        x[rng.random(ROWS) < 0.15], m[rng.random(ROWS) < (0.1 if n else 0)] = np.nan, np.nan
        parts.append(pd.DataFrame({"period": n % 2, "bar": np.arange(ROWS) * 2 + 100, "name_ix": n, "f1": x, "f2": m}))
    wide = pd.concat(parts)
    df = spark.createDataFrame(wide).selectExpr("period", "bar", "name_ix", "nanvl(f1, null) AS f1", "nanvl(f2, null) AS f2").persist()
    yield df, wide
    df.unpersist()


def by_name(df, nodes):
    got = evaluate(df, nodes).toPandas().sort_values(["name_ix", "bar"])
    return {n: {c: g[c].to_numpy(dtype=float) for c in nodes} for n, g in got.groupby("name_ix")}


@pytest.mark.parametrize("frame", [512, 0])
@pytest.mark.parametrize("w", [1, 2, 7, 64, 259, 400])
def test_windows(panel, monkeypatch, frame, w):
    monkeypatch.setattr(t, "FRAME", frame)
    df, wide = panel
    least = max(1, w // 3)
    nodes = {
        "mean": t.rolling_mean(F1, w, least), "sum": t.rolling_sum(F1, w, least), "std": t.rolling_std(F1, w, max(2, least)), "max": t.rolling_max(F1, w, least), "min": t.rolling_min(F1, w, least),
        "skew": t.skew(F1, w, max(2, least)), "slope": t.rolling_beta(F1, F2, w, least), "long": t.long_sum(F1, w),
    }
    got = by_name(df, nodes)
    for n, g in wide.groupby("name_ix"):
        x, m = g.f1.reset_index(drop=True), g.f2.reset_index(drop=True)
        r = x.rolling(w, min_periods=least)
        for c in ("mean", "sum", "max", "min"):
            np.testing.assert_allclose(got[n][c], getattr(r, c)(), atol=1e-11)
        if w > 1:
            np.testing.assert_allclose(got[n]["std"], x.rolling(w, min_periods=max(2, least)).std(), atol=1e-11)
        np.testing.assert_allclose(got[n]["long"], x.fillna(0).rolling(w, min_periods=1).sum(), atol=1e-11)
        e = lambda v: v.rolling(w, min_periods=least).mean()
        spread = e(m * m) - e(m) ** 2
        want, sound = (e(x * m) - e(x) * e(m)) / (spread + 1e-12), ~(spread < 1e-3)  # elsewhere the plain moments have no digits
        np.testing.assert_allclose(got[n]["slope"][sound], want[sound], rtol=1e-8, atol=1e-8)
        for i in range(ROWS):
            v = x[max(0, i - w + 1) : i + 1].dropna().to_numpy()
            if len(v) >= max(2, least):
                d = v - v.mean()
                var = (d**2).mean()
                if var > 1e-9:
                    assert np.isclose(got[n]["skew"][i], (d**3).mean() / (var**1.5 + 1e-12), atol=1e-8)


@pytest.mark.parametrize("frame", [512, 0])
def test_an_offset_costs_no_digits(spark, monkeypatch, frame):
    monkeypatch.setattr(t, "FRAME", frame)
    rng = np.random.default_rng(2)
    x, m = rng.normal(size=150) + 1e8, rng.normal(size=150) * 2 - 1e8
    df = spark.createDataFrame(pd.DataFrame({"period": 0, "bar": np.arange(150), "name_ix": 0, "f1": x, "f2": m}))
    w = 40
    got = by_name(df, {"std": t.rolling_std(F1, w, 40), "skew": t.skew(F1, w, 40), "slope": t.rolling_beta(F1, F2, w, 40)})[0]
    for i in range(w - 1, 150):
        a, b = ([Fraction(float(v)) for v in s[i - w + 1 : i + 1]] for s in (x, m))
        ma, mb = sum(a) / w, sum(b) / w
        var, third = float(sum((v - ma) ** 2 for v in a) / w), float(sum((v - ma) ** 3 for v in a) / w)
        cov, mvar = float(sum((u - ma) * (v - mb) for u, v in zip(a, b)) / w), float(sum((v - mb) ** 2 for v in b) / w)
        # a frame's own means are rounded at 1e8; blocks are shifted first
        near = 1e-9 if frame == 0 else 1e-6
        assert np.isclose(got["std"][i], np.sqrt(var * w / (w - 1)), rtol=near, atol=0)
        assert np.isclose(got["skew"][i], third / var**1.5, rtol=near, atol=near)
        assert np.isclose(got["slope"][i], cov / mvar, rtol=near, atol=near)


def test_drift_costs_no_digits(spark, monkeypatch):
    """A window late in a series that has grown by far is as exact as an early one."""
    monkeypatch.setattr(t, "FRAME", 0)
    x = np.concatenate([np.full(500, 1e12), np.tile([0.5, -0.25, 0.125], 100)])
    df = spark.createDataFrame(pd.DataFrame({"period": 0, "bar": np.arange(800), "name_ix": 0, "f1": x, "f2": x}))
    got = by_name(df, {"mean": t.rolling_mean(F1, 60), "std": t.rolling_std(F1, 60)})[0]
    np.testing.assert_allclose(got["mean"][600:], pd.Series(x[500:]).rolling(60).mean()[100:], rtol=1e-12)
    np.testing.assert_allclose(got["std"][600:], pd.Series(x[500:]).rolling(60).std()[100:], rtol=1e-9)


def plain_rank(v, w, least):
    out = np.full(len(v), np.nan)
    for i in range(len(v)):
        seen = v[0 if w is None else max(0, i - w + 1) : i + 1]
        seen = seen[~np.isnan(seen)]
        if not np.isnan(v[i]) and len(seen) >= least:
            out[i] = ((seen < v[i]).sum() + ((seen == v[i]).sum() + 1) / 2) / len(seen)
    return out


@pytest.mark.parametrize("compared", [128, 0])
def test_ranks(panel, monkeypatch, compared):
    monkeypatch.setattr(t, "COMPARED", compared)
    df, wide = panel
    nodes = {"all": t.rolling_rank(F1, None, 5), "w30": t.rolling_rank(F1, 30, 5), "w200": t.rolling_rank(F1, 200, 9), "w1": t.rolling_rank(F1, 1, 1), "history": t.history_rank(F1, 5)}
    got = by_name(df, nodes)
    for n, g in wide.groupby("name_ix"):
        v = g.f1.to_numpy()
        for c, w, least in (("all", None, 5), ("history", None, 5), ("w30", 30, 5), ("w200", 200, 9), ("w1", 1, 1)):
            np.testing.assert_allclose(got[n][c], plain_rank(v, w, least), atol=1e-12, equal_nan=True)
    assert "collect_list" not in evaluate(df, nodes)._jdf.queryExecution().toString() or compared


def test_too_many_values_for_the_digits_are_an_error(panel):
    with pytest.raises(Exception, match="more values than 1 digits"):
        evaluate(panel[0], {"v": t.rolling_rank(F1, None, 1, digits=1)}).collect()


def test_a_long_history(spark):
    """50,000 rows of one name; a list a row would hold more than 10^9 values in all."""
    n = 50_000
    x = np.random.default_rng(9).integers(0, 30_000, n).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"period": 0, "bar": np.arange(n), "name_ix": 0, "f1": x}))
    nodes = {"all": t.history_rank(F1, 1), "far": t.rolling_rank(F1, 20_000, 1), "high": t.rolling_max(F1, 20_000), "std": t.rolling_std(F1, 20_000)}
    got = by_name(df, nodes)[0]
    seen, recent = [], []
    for i, v in enumerate(x):
        bisect.insort(seen, v)
        bisect.insort(recent, v)
        if i >= 20_000:
            recent.pop(bisect.bisect_left(recent, x[i - 20_000]))
        if i % 37 == 0:
            for c, s in (("all", seen), ("far", recent)):
                a, b = bisect.bisect_left(s, v), bisect.bisect_right(s, v)
                assert np.isclose(got[c][i], (a + (b - a + 1) / 2) / len(s))
    s = pd.Series(x)
    np.testing.assert_array_equal(got["high"], s.rolling(20_000, min_periods=1).max())
    np.testing.assert_allclose(got["std"][1:], s.rolling(20_000, min_periods=2).std()[1:], rtol=1e-9)
