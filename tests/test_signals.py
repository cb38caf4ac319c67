"""Cross-sectional and time-series operators against pandas, and their causality."""

import numpy as np
import pandas as pd
import pytest

from crossbar.functions import scalar as s
from crossbar.operators import cross as x
from crossbar.operators import series as t
from crossbar.plans.components import COMPONENTS, f1, f2, f5, f6
from crossbar.plans.expr import evaluate, layout
from crossbar.plans.predictors import BEST, PREDICTORS
from crossbar.queries import SIGNALS
from crossbar.sources.panel import from_wide, to_wide

BARS, NAMES = 90, 7


def wide(seed=1, bars=BARS, names=NAMES, gaps=True):
    rng = np.random.default_rng(seed)
    cols = pd.MultiIndex.from_product([[f"Feature.{k}" for k in range(1, 7)], [f"X.{n}" for n in (10, 9, 2, 1, 30, 4, 5)[:names]]])
    df = pd.DataFrame(rng.normal(size=(bars, len(cols))), columns=cols)
    df["Feature.5"] = (df["Feature.5"] * 2).round()  # ties
    if gaps:
        df = df.mask(rng.random(df.shape) < 0.04)
    return df


def by_suffix(df):
    return df[sorted(df.columns, key=lambda c: int(c.split(".")[-1]))]


@pytest.fixture(scope="module")
def block():
    return wide()


@pytest.fixture(scope="module")
def panel(spark, block):
    return from_wide(spark, block).cache()


def run(panel, **nodes):
    df = evaluate(panel, nodes)
    return {n: to_wide(df, n) for n in nodes}


def rank(df):
    n = df.shape[1]
    return (df.rank(axis=1) - (n + 1) / 2) / ((n - 1) / 2)


def beta(a, m, w, least):
    e = lambda v: v.rolling(w, min_periods=least).mean()
    return (e(a.mul(m, axis=0)) - e(a).mul(e(m), axis=0)).div(e(m * m) - e(m) ** 2 + 1e-12, axis=0)


def resid2(y, a, b):
    out = y * np.nan
    for i in range(len(y)):
        ym, am, bm = (v.iloc[i] - v.iloc[i].mean() for v in (y, a, b))
        aa, ab, bb = (am * am).sum(), (am * bm).sum(), (bm * bm).sum()
        ay, by = (am * ym).sum(), (bm * ym).sum()
        det = aa * bb - ab * ab + 1e-18
        out.iloc[i] = ym - am * (bb * ay - ab * by) / det - bm * (aa * by - ab * ay) / det
    return out


def test_against_pandas(panel, block):
    g1, g2, g5, g6 = (by_suffix(block[f"Feature.{k}"]) for k in (1, 2, 5, 6))
    m = g1.mean(axis=1)
    roll = lambda v, w, k: v.rolling(w, min_periods=k)
    z = (g1 - roll(g1, 20, 4).mean()) / (roll(g1, 20, 4).std() + 1e-12)
    price = g1.cumsum()
    want = {
        "demean": (x.demean(f1), g1.sub(m, axis=0)),
        "rank": (x.rank_average(f5), rank(g5)),
        "percent": (x.rank_percent(f5), g5.rank(axis=1, pct=True)),
        "present": (x.rank_present(f5), None),
        "zscore": (x.zscore(f1), g1.sub(m, axis=0).div(g1.std(axis=1, ddof=0) + 1e-9, axis=0)),
        "dispersion": (x.std_samp(f1), pd.DataFrame({c: g1.std(axis=1) for c in g1})),
        "mean": (t.rolling_mean(f1, 10, 3), roll(g1, 10, 3).mean()),
        "sum": (t.rolling_sum(f1, 10, 1), roll(g1, 10, 1).sum()),
        "std": (t.rolling_std(f1, 10, 3), roll(g1, 10, 3).std()),
        "max": (t.rolling_max(f1, 10, 3), roll(g1, 10, 3).max()),
        "ewm": (t.ewm_mean(f1, 10), g1.ewm(span=10, min_periods=1).mean()),
        "ewm3": (t.ewm_mean(f1, 20, least=3), g1.ewm(span=20, min_periods=3).mean()),
        "half": (t.ewm_mean(f1, half_life=7), g1.ewm(halflife=7, min_periods=1).mean()),
        "ts_pct": (t.rolling_rank(f5, 15, 4), roll(g5, 15, 4).rank(pct=True)),
        "exp_pct": (t.rolling_rank(f6, None, 10), g6.expanding(10).rank(pct=True)),
        "beta": (t.rolling_beta(f1, x.mean(f1), 30, 10), beta(g1, m, 30, 10)),
        "clipped": (t.zscore_clipped(f1, 20, 4, 1.5), z.clip(-1.5, 1.5).fillna(0)),
        "drawdown": (t.drawdown(t.cumulate(f1), 20), roll(price.ffill(), 20, 1).max() - price.ffill()),
        "flow": (s.flow(f1, f5), np.sign(g1) * np.log1p(g5.abs())),
        "squash": (t.squashed(f5, 30, 5), np.tanh(g5 / (roll(g5, 30, 5).std() + 1e-9))),
        "lag": (t.lag(f2, 3), g2.shift(3)),
        "sum25": (t.lead_sum(f1, 2, 5), None),
    }
    got = run(panel, **{n: node for n, (node, _) in want.items()})
    for n, (_, w) in want.items():
        if w is not None:
            np.testing.assert_allclose(got[n].to_numpy(), w.to_numpy(dtype=float), rtol=1e-8, atol=1e-9, err_msg=n)
    ahead = sum(g1.shift(-k) for k in range(2, 6))
    np.testing.assert_allclose(got["sum25"].to_numpy(), ahead.to_numpy(), atol=1e-9)
    r, n = g5.rank(axis=1), g5.notna().sum(axis=1)
    present = r.sub((n + 1) / 2, axis=0).div((n - 1) / 2, axis=0).fillna(0)
    np.testing.assert_allclose(got["present"].to_numpy(), present.sub(present.mean(axis=1), axis=0).to_numpy(), atol=1e-9)


def test_ordinal_and_shapes(panel, block):
    g5 = by_suffix(block["Feature.5"])
    order = g5.fillna(np.inf).to_numpy().argsort(axis=1, kind="stable").argsort(axis=1)
    got = run(panel, a=x.rank_ordinal(f5), h=x.rank_half(f5), c=x.rank_centred(f5), d=t.decay_linear(f1, 4), p=t.one_pole(f1, 5.0), l=t.long_sum(f1, 12), e=t.age_of_high(t.cumulate(s.fill(f1)), 10), b=t.before_sum(f1, 3))
    n = NAMES
    np.testing.assert_allclose(got["a"], (order + 1 - (n + 1) / 2) / ((n - 1) / 2), atol=1e-12)
    np.testing.assert_allclose(got["h"], order / (n - 1) - 0.5, atol=1e-12)
    np.testing.assert_allclose(got["c"], got["a"], atol=1e-12)
    g1 = by_suffix(block["Feature.1"]).fillna(0)
    np.testing.assert_allclose(got["d"], sum((4 - k) * g1.shift(k).fillna(0) for k in range(4)) / 10, atol=1e-12)
    np.testing.assert_allclose(got["p"], g1.ewm(halflife=5, adjust=False).mean() - 0.5 ** (np.arange(BARS) / 5)[:, None] * g1.iloc[0].to_numpy() * 0.5 ** (1 / 5), atol=1e-9)
    np.testing.assert_allclose(got["l"], g1.rolling(12, min_periods=1).sum(), atol=1e-9)
    np.testing.assert_allclose(got["b"], g1.shift(1).rolling(3, min_periods=1).sum().fillna(0), atol=1e-9)
    price = g1.cumsum()
    high = price >= price.rolling(10, min_periods=1).max() - 1e-12
    pos = np.arange(BARS)[:, None]
    np.testing.assert_array_equal(got["e"], pos - np.maximum.accumulate(np.where(high, pos, -1), axis=0))


def test_long_windows_are_two_sides_of_a_block(panel, block, monkeypatch):
    monkeypatch.setattr(t, "FRAME", 5)
    g1 = by_suffix(block["Feature.1"])
    got = run(panel, m=t.rolling_mean(f1, 21, 4), s=t.rolling_sum(f1, 21, 1))
    np.testing.assert_allclose(got["m"], g1.rolling(21, min_periods=4).mean(), atol=1e-9)
    np.testing.assert_allclose(got["s"], g1.rolling(21, min_periods=1).sum(), atol=1e-9)


def test_ewm_over_many_blocks(spark):
    bars = 700  # span 1.2 keeps 0.0909: a block is 125 bars
    data = wide(3, bars, 2)
    got = run(from_wide(spark, data), e=t.ewm_mean(f1, 1.2))["e"]
    np.testing.assert_allclose(got, by_suffix(data["Feature.1"]).ewm(span=1.2, min_periods=1).mean(), rtol=1e-9)


def test_best_predictor_against_pandas(spark):
    data = wide(5, 120, 7, gaps=False)
    data["Feature.5"] = data["Feature.5"] + data["Feature.4"] / 7  # sums of tied values differ in the last digit
    g = {k: by_suffix(data[f"Feature.{k}"]) for k in range(1, 7)}
    m = g[1].mean(axis=1)
    dm = lambda a: a.sub(a.mean(axis=1), axis=0)
    b = beta(g[1], m, 250, 20).fillna(1.0)
    res = (g[1] - b.mul(m, axis=0)).fillna(0.0)
    e34 = resid2(g[3], g[1], g[2]) + resid2(g[4], g[1], g[2])
    late = m.shift(1)
    e = lambda v: v.expanding(min_periods=30).mean()
    a = g[1].iloc[1:]
    y = late.iloc[1:]
    num = e(a.mul(y, axis=0)) - e(a).mul(e(y), axis=0)
    den = np.sqrt((e(a * a) - e(a) ** 2).clip(lower=0).mul((e(y * y) - e(y) ** 2).clip(lower=0), axis=0)) + 1e-12
    follow = (num / den).reindex(g[1].index).fillna(0.0)
    disp = g[1].std(axis=1)
    zd = ((disp - disp.rolling(120, min_periods=10).mean()) / (disp.rolling(120, min_periods=10).std() + 1e-12)).fillna(0.0)
    state = g[6].expanding(10).rank(pct=True).fillna(0.5)
    line = (np.sign(g[1]) * np.log1p(g[5].abs())).rolling(60, min_periods=1).sum()
    parts = {
        "idio_rev_ewm10": -rank(res.ewm(span=10, min_periods=1).mean()),
        "x34_sum_ewm3": rank(e34.ewm(span=3, min_periods=1).mean()),
        "leadlag_sign": rank(follow).mul(np.sign(m), axis=0),
        "beta_x_mmom5": rank(b).mul(np.sign(m.rolling(5, min_periods=1).sum()), axis=0),
        "beta_x_mmom20": rank(b).mul(np.sign(m.rolling(20, min_periods=1).sum()), axis=0),
        "vmix2": -rank(state) - rank(line),
        "rev_f3": -rank(g[3]),
        "rev_f4": -rank(g[4]),
        "f6": rank(g[6]),
        "rev_dispz": -rank(g[1]).mul(np.tanh(zd), axis=0),
    }
    want = dm(sum(w * dm(parts[n].fillna(0.0)) for n, w in BEST.items()))
    got = run(from_wide(spark, data), score=PREDICTORS["best"])["score"]
    np.testing.assert_allclose(got, want, atol=1e-7)
    assert got.mean(axis=1).abs().max() < 1e-12


LOOK_AHEAD = {"t03_lead", "t04_lead_sum", "t50_recency_weight", "m02_next_rank", "m02_next_rank_residual"}


def test_no_signal_reads_the_future(spark):
    """Changed rows from a bar on change nothing before it; a prefix gives the prefix of the results."""
    nodes = {n: v for n, v in SIGNALS.items() if n not in LOOK_AHEAD} | COMPONENTS | {f"p_{n}": v for n, v in PREDICTORS.items()}
    data, cut = wide(7), 60
    changed = data.copy()
    changed.iloc[cut:] = wide(8).iloc[cut:].to_numpy()
    frames = []
    for d in (data, changed, data.iloc[:cut]):
        df = evaluate(from_wide(spark, d), nodes).where(f"bar < {cut}").toPandas()
        frames.append(df.sort_values(["bar", "name_ix"])[list(nodes)].to_numpy(dtype=float))
    np.testing.assert_allclose(frames[0], frames[1], atol=1e-9)
    np.testing.assert_allclose(frames[0], frames[2], atol=1e-9)


def test_small_bars(spark):
    one = evaluate(from_wide(spark, wide(1, 3, 1)), {n: v for n, v in SIGNALS.items()}).toPandas()
    assert len(one) == 3 and (one["x04_csrank_avg"].dropna() == 0).all()
    flat = wide(1, 5, 4, gaps=False) * 0 + 2.5
    same = evaluate(from_wide(spark, flat), {"r": x.rank_average(f1), "z": x.zscore(f1), "u": x.unit_demeaned(f1), "e": x.residual2(f1, f2, f5)}).toPandas()
    assert (same[["r", "z", "u", "e"]].abs().max() == 0).all()
    empty = evaluate(from_wide(spark, wide(1, 3, 2)).limit(0), {"r": x.rank_average(f1)})
    assert empty.count() == 0


def test_layout_changes_partitioning_seldom():
    kinds = [{n.kind for _, n, _ in s.new} for s in layout({"score": PREDICTORS["best"]})]
    windows = [k for k in ("".join(sorted(k & {"xs", "ts"})) for k in kinds) if k]
    switches = sum(a != b for a, b in zip(windows, windows[1:]))
    assert switches <= 5  # exchanges for ten components


def test_shuffles_of_the_flagship(spark):
    plan = evaluate(from_wide(spark, wide()), {"score": PREDICTORS["best"]})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 7
