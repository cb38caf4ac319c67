"""Numbers of catalogue predictors against plain rewrites: loops over bars, moments from scratch at each of them."""

import numpy as np
import pandas as pd
import pytest

from crossbar.operators import matrix as m
from crossbar.plans import catalogue as cat
from crossbar.plans import core
from crossbar.plans.expr import evaluate
from crossbar.sources.panel import from_wide

BARS, NAMES = 110, 9
SHORT = cat.SHORT
#: Old rows count here by a share; in SHORT they don't count.
SHARED = cat.replace(SHORT, core_tail=20, core_least=10, core_cap=25)


@pytest.fixture(scope="module")
def given(spark):
    """A panel, its arrays, and scores of catalogue predictors over it."""
    rng = np.random.default_rng(11)
    columns = pd.MultiIndex.from_product([[f"Feature.{k}" for k in range(1, 7)], [f"X.{n}" for n in range(NAMES)]])
    wide = pd.DataFrame(rng.normal(size=(BARS, len(columns))), columns=columns)
    target = wide["Feature.1"].rolling(5).sum().shift(-5).fillna(0.0)
    panel = from_wide(spark, wide, target).persist()
    f = {f"f{k}": wide[f"Feature.{k}"].to_numpy() for k in range(1, 7)} | {"target": target.to_numpy()}

    def scored(name, settings=SHORT):
        got = cat.score(panel, name, settings).toPandas()
        assert got.bar.min() == SHORT.train
        return got.pivot(index="bar", columns="name_ix", values="score").to_numpy()

    yield panel, f, scored
    panel.unpersist()


def close(got, want, atol=1e-6):
    want = want - want.mean(axis=1, keepdims=True)
    np.testing.assert_allclose(got, want[SHORT.train :], atol=atol)


def rank(row):
    """Ordinal places on [-1, 1], ties by column; values equal but for rounding tie."""
    order = sorted(range(len(row)), key=lambda i: (round(row[i], 9), i))
    out = np.zeros(len(row))
    for place, i in enumerate(order):
        out[i] = place
    return (out - (len(row) - 1) / 2) / ((len(row) - 1) / 2)


def average_rank(row):
    return np.array([2 * ((np.sum(row < v) + (np.sum(row == v) + 1) / 2) - (len(row) + 1) / 2) / (len(row) - 1) for v in row])


def rows(make, n):
    return np.array([make(t) for t in range(n)])


def off(v, r, share=1.0):
    return v - share * (v @ r) / (r @ r + 1e-18) * r


def plain_core(f, s, centre_beta=True):
    n = len(f["f1"])
    start, share = core.old_rows(*s.core)
    w = np.where(np.arange(n) < start, share, 1.0)
    f1, f2, f3, f4, f6 = (f[f"f{k}"] for k in (1, 2, 3, 4, 6))
    d = f1 - f1.mean(1, keepdims=True)

    def deviation(v, t, least):
        mass = w[: t + 1].sum()
        if mass <= least:
            return np.full(NAMES, np.inf)
        mean = (w[: t + 1, None] * v[: t + 1]).sum(0) / mass
        return np.sqrt(np.maximum((w[: t + 1, None] * v[: t + 1] ** 2).sum(0) / mass - mean**2, 1e-18))

    def ts_rank(v, span, least):
        out = np.zeros_like(v)
        for t in range(n):
            h = v[max(0, t - span + 1) : t + 1]
            if len(h) >= least:
                out[t] = 2 * ((h < v[t]).sum(0) + ((h == v[t]).sum(0) + 1) / 2) / len(h) - 1
        return out

    def after(v, k):
        return v if share else np.where(np.arange(n)[:, None] < start + k, 0.0, v)

    e = np.array([y - x @ np.linalg.lstsq(x, y, rcond=None)[0] for y, x in ((f3[t], np.column_stack([np.ones(NAMES), f1[t], f2[t]])) for t in range(n))])
    ewm = pd.DataFrame(e).ewm(span=2).mean().to_numpy()
    u = rows(lambda t: np.clip(d[t] / (deviation(d, t, 10) + 1e-12), -3, 3), n)
    surprise = rows(lambda t: np.clip(e[t] / (deviation(e, t, 20) + 1e-9), -5, 5), n)
    p = np.clip(np.nan_to_num(d / (pd.DataFrame(d).rolling(60, min_periods=10).std().to_numpy() + 1e-9)), -5, 5)
    short, long = (rows(lambda t: p[max(0, t - k + 1) : t + 1].sum(0), n) for k in (10, 40))
    near, far = rows(lambda t: short[t] / (deviation(short, t, 20) + 1e-9), n), ts_rank(long, 120, 40)
    level = rows(lambda t: (w[: t + 1, None] * f6[: t + 1]).sum(0) / max(w[: t + 1].sum(), 1e-300), n)
    spread = rows(lambda t: rank(ts_rank(f4 - f1, 60, 20)[t]), n)
    fade = after(rows(lambda t: -rank((f6[t] - level[t]) / (deviation(f6, t, 10) + 1e-12)), n), 30)
    zero = np.zeros((1, NAMES))
    g1, g2 = np.vstack([zero, f1[:-1]]), np.vstack([zero, zero, f1[:-2]])
    lagged = rows(lambda t: -rank(0.9 * g1[t] + 0.35 * g2[t] - 1.4 * ewm[t]), n)
    innovation = after(rows(lambda t: rank(sum((5 - k) * (surprise[t - k] if t >= k else 0) for k in range(5)) / 15 + np.zeros(NAMES)), n), 30)
    lead, tops, fulls, trend = (np.zeros((n, NAMES)) for _ in range(4))
    for t in range(n):
        if t >= (1 if share else start + 41):
            a = sum(w[s] * np.outer(u[s - 1], u[s]) for s in range(1, t + 1)) / w[1 : t + 1].sum()
            np.fill_diagonal(a, 0)
            lead[t] = rank(a.T @ u[t])
        if t >= (1 if share else start + 30):
            x = (w[: t + 1, None] * p[: t + 1]).T @ p[: t + 1]
            c = x / (np.sqrt(np.outer(np.diag(x), np.diag(x))) + 1e-9)
            np.fill_diagonal(c, 0)
            full, top = np.zeros_like(c), np.zeros_like(c)
            for i in range(NAMES):
                plus = np.maximum(c[i], 0)
                full[i] = plus / (plus.sum() + 1e-9) if plus.sum() > 1e-9 else (np.arange(NAMES) != i) / (NAMES - 1)
                for j in sorted(range(NAMES), key=lambda j: (c[i, j], j))[-3:]:
                    top[i, j] = 1 / 3
            tops[t], fulls[t] = -rank(near[t] - top @ near[t]), -rank(far[t] - full @ far[t])
        num = sum(w[s] * u[s] * (u[s - 1] if s else 0) for s in range(t + 1))
        trend[t] = rank(np.tanh(5 * num / (sum(w[s] * u[s] ** 2 for s in range(t + 1)) + 1e-9)) * u[t])
    trend = after(trend, 30)
    market = f1.mean(1)
    out, trends, betas = (np.zeros((n, NAMES)) for _ in range(3))
    for t in range(n):
        h, k = f1[max(0, t - 249) : t + 1], market[max(0, t - 249) : t + 1]
        betas[t] = ((h * k[:, None]).mean(0) - h.mean(0) * k.mean()) / ((k * k).mean() - k.mean() ** 2 + 1e-12) if len(h) >= 20 else 1.0
        state = lead[t] + fade[t] + 0.8 * lagged[t]
        row = 0.3229 * spread[t] + 0.2656 * (state - state.mean()) + 0.1556 * tops[t] + 0.1493 * innovation[t] + 0.1065 * fulls[t]
        row = off(row, betas[t] - betas[t].mean() if centre_beta else betas[t])
        reversal = -rank(f1[t])
        row = off(row, reversal, 0.25)
        out[t] = row - row.mean()
        moved = off(trend[t], reversal)
        trends[t] = rank(moved - moved.mean())
    return out, trends, betas


def arrays(df, names):
    pdf = df.toPandas()
    return {c: pdf.pivot(index="bar", columns="name_ix", values=c).to_numpy() for c in names}


@pytest.mark.parametrize("settings", [SHORT, SHARED])
def test_core_leg(given, settings):
    panel, f, _ = given
    nodes = cat._nodes("core", settings)
    columns = arrays(cat.evaluate(panel, nodes), nodes)
    for centre in (True, False):
        got = cat.core_leg({"f1": f["f1"]} | columns, settings, centre)
        want = plain_core(f, settings, centre)
        for a, b, atol in zip(got, want, (1e-6, 1e-9, 1e-9)):
            np.testing.assert_allclose(a[SHORT.train :], b[SHORT.train :], atol=atol)


def learned(given, parts=("ensemble",)):
    panel, _, _ = given
    out = cat._learn(panel, parts, SHORT)
    return arrays(out, out.columns[3:])


def plain_learned(f, fitted, of="gbt"):
    out = np.zeros_like(f["f1"])
    for t in range(BARS):
        r1 = average_rank(f["f1"][t])
        for i in range(4):
            p = fitted[f"{of}{i}"][t] - fitted[f"{of}{i}"][t].mean()
            p = off(p, r1) if i else p
            out[t] += p / (p.std() + 1e-12) / 4
    return out


def plain_apex(f, fitted, settings=SHORT, mapped=True, centre_beta=True, scales=(0.34507836, 0.86575845, 0.608), of="gbt"):
    main, trend, beta = plain_core(f, settings, centre_beta)
    out = 0.6 / scales[0] * main + 0.2 / scales[1] * plain_learned(f, fitted, of) + 0.2 / scales[2] * trend
    out = np.array([off(a, b) for a, b in zip(out, beta)])
    return m.centre(m.risk_map(out, f["f1"], 0.5, 50, 25) if mapped else out)


def plain_graph(f, train=60):
    first = m.var_graph(f["f1"], (40, 60), 0.10, 25)
    fits = [m.rank_var_fit(f["f1"][max(0, train - w) : train], f["target"][max(0, train - w) : train]) for w in (50, 60)]
    second = m.rank_var_apply(f["f1"], fits)
    return m.centre(sum(a / np.maximum(a.std(1, keepdims=True), 1e-12) for a in (first, second)))


def test_apex_predictors(given):
    _, f, scored = given
    fitted = learned(given)
    close(scored("apex6"), plain_apex(f, fitted, mapped=False, centre_beta=False))
    close(scored("apex7"), plain_apex(f, fitted))
    close(scored("apexP"), plain_apex(f, fitted, centre_beta=False))
    close(scored("apex8"), plain_apex(f, fitted) + 0.068664 * plain_graph(f))
    close(scored("final"), plain_graph(f) / 0.04933074223312276 + plain_apex(f, fitted) / 0.024778769297110750, 1e-4)
    close(scored("triad2"), plain_graph(f) / 0.04933074223312276 + plain_apex(f, fitted, mapped=False, centre_beta=False) / 0.024651576010626338, 1e-4)


def test_remeasured_predictor(given):
    """Scales and gain come from legs fitted before the tail of the training bars, and are fixed where it is short."""
    _, f, scored = given
    fitted = learned(given, ("ensemble", "early_ensemble"))
    early, tail = cat.replace(SHORT, train=40), slice(40, 60)
    main, trend, _ = plain_core(f, early)
    scales = [a[tail].std(1).mean() for a in (main, plain_learned(f, fitted, "early_gbt"), trend)]
    apex = plain_apex(f, fitted, early, scales=scales, of="early_gbt")[tail]
    profit = lambda leg: np.array([0.0, *(leg[:-1] * f["f1"][tail][1:]).sum(1)])[1:].std()
    gain = 0.15 / 0.85 * profit(apex) / profit(plain_graph(f, 40)[tail])
    close(scored("apex8a"), plain_apex(f, fitted, scales=scales) + gain * plain_graph(f), 1e-5)
    few = cat.replace(SHORT, inner_least=41)
    assert cat.inner_measure(f, few) == ((cat.CORE_SCALE, cat.LEARNED_SCALE, cat.TREND_SCALE), cat.SLEEVE_GAIN)


def test_boosted_predictors(given):
    _, f, scored = given
    fitted = learned(given, ("lgb", "cat", "path"))
    close(scored("gbm_lgb"), rows(lambda t: average_rank(fitted["lgb"][t]), BARS))
    close(scored("catgraph"), plain_graph(f) / 0.04933074223312276 + rows(lambda t: average_rank(fitted["cat"][t]), BARS) / 0.02513033691860830, 1e-5)
    close(scored("ind2"), rows(lambda t: off(average_rank(fitted["path"][t]), average_rank(f["f1"][t])), BARS))
    # rounds are those of the parameter sets: one round less gives other numbers
    assert cat._boosters("lgb")[1]["lgb"].rounds == 200 and all(b.rounds == 80 for b in cat._boosters("ensemble")[1].values())
    assert cat._boosters("path")[1]["path"].rounds == 250


def test_graph_and_map_predictors(given):
    _, f, scored = given
    graph = plain_graph(f)
    close(scored("ticket2"), graph)
    close(scored("cr_ewma"), m.recursive_map(f["f1"]))
    close(scored("cr_rob"), m.quadrant_map(f["f1"]))
    close(scored("cr_prec"), m.partial_graph(f["f1"]))
    five = lambda t: np.column_stack([np.ones(NAMES), *(f[f"f{k}"][t] for k in range(2, 7))])
    left = rows(lambda t: f["f1"][t] - five(t) @ np.linalg.lstsq(five(t), f["f1"][t], rcond=None)[0], BARS)
    resid = rows(lambda t: rank(-left[t]), BARS)
    ou = m.centre(m.rank_one(m.ou_score(f["f1"], 30)))
    risk = lambda leg: (leg[20:59] * f["f1"][21:60]).sum(1).std()
    close(scored("ticket7"), resid / risk(resid) + ou / risk(ou), 1e-4)
    close(scored("ticket8"), graph / 0.04933074223312276 + resid / 0.018357239918563376 + ou / 0.01674839194002865, 1e-4)


def test_lead_lag_predictor(given):
    _, f, scored = given
    d = f["f1"] - f["f1"].mean(1, keepdims=True)
    u, lead = np.zeros_like(d), np.zeros_like(d)
    for t in range(BARS):
        if t >= 10:
            u[t] = np.clip(d[t] / (d[: t + 1].std(0) + 1e-12), -3, 3)
        if t >= 41:
            a = sum(np.outer(u[s - 1], u[s]) for s in range(1, t + 1)) / t
            np.fill_diagonal(a, 0)
            lead[t] = rank(a.T @ u[t])
    g = {k: f[f"f{k}"] for k in (1, 2, 3, 6)}
    e = np.array([y - x @ np.linalg.lstsq(x, y, rcond=None)[0] for y, x in ((g[3][t], np.column_stack([np.ones(NAMES), g[1][t], g[2][t]])) for t in range(BARS))])
    ewm = pd.DataFrame(e).ewm(span=2).mean().to_numpy()
    slow = np.zeros_like(d)
    for t in range(60, BARS):
        fade = -rank((g[6][t] - g[6][: t + 1].mean(0)) / (g[6][: t + 1].std(0) + 1e-12))
        back = -rank(0.9 * g[1][t - 1] + 0.35 * g[1][t - 2] - 1.4 * ewm[t])
        slow[t] = rank(g[3][t] - g[1][t]) + 0.75 * fade + 0.6 * back
    close(scored("ticket1"), slow + 2 * lead)


def test_odd_moments_off_the_return(spark, given):
    panel, f, scored = given
    got = evaluate(panel, cat._basis_signals()).toPandas()
    r = f["f1"]
    spread = pd.DataFrame(r).rolling(60, min_periods=10).std().fillna(0.0).to_numpy()
    before = lambda k: rows(lambda t: r[t - k] if t >= k else np.zeros(NAMES), BARS)
    lone = rows(lambda t: r[t] * (r[t] - r[t].mean()) ** 2, BARS)
    raw = [before(k) for k in (1, 2, 3, 4)] + [f[c] for c in ("f3", "f4", "f5", "f6")] + [r * spread, r / (spread + 1e-6), lone, r**2 * before(1)]
    assert list(cat._basis_signals()) == list(cat.BASIS) and len(raw) == len(cat.BASIS)
    basis = []
    for name, v in zip(cat.BASIS, raw):
        want = rows(lambda t: off(average_rank(v[t]), average_rank(r[t])), BARS)
        np.testing.assert_allclose(got.pivot(index="bar", columns="name_ix", values=name).to_numpy(), want, atol=1e-9)
        basis.append(want)
    profits = np.array([[b[t - 1] @ (r[t] - r[t].mean()) for b in basis] for t in range(1, SHORT.train)])[min(60, SHORT.train // 3) :]
    cov = np.cov(profits.T)
    w = np.linalg.solve(cov + np.diag(np.diag(cov)), profits.mean(0))
    close(scored("odd2c"), sum(u * b for u, b in zip(w / np.linalg.norm(w), basis)))
