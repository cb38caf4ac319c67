"""All predictors by name: which legs, which constants, how they are blended.

A predictor runs in up to three parts: signal columns (one graph of window stages), learned columns (boosted
trees), and one grouped kernel a period that makes the matrix legs and the blend. ``FULL`` has the constants for
long histories, ``SHORT`` the same shapes for panels of a hundred bars.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from ..operators import matrix as m
from . import core, models
from .components import COMPONENTS, e3, e4
from .components import rank as signal_rank
from .expr import Node, evaluate
from .predictors import PREDICTORS

Arrays = dict[str, np.ndarray]
FIELDS = ("f1", "f2", "f3", "f4", "f5", "f6", "target")


@dataclass(frozen=True)
class Settings:
    """Lengths in bars. ``train`` is the number of bars of a period before the scored ones."""

    train: int = 25_000
    windows: tuple[int, ...] = (750, 1500, 2000, 2500, 3500, 5000, 7500)
    wide_windows: tuple[int, ...] = (250, 500, 1000, 2000, 4000, 8000)
    least_pairs: int = 250
    tails: tuple[int, ...] = (6000, 25_000)
    core_tail: int = 600
    core_least: int = 300
    core_cap: int = 500
    covariance: int = 250
    covariance_least: int = 60
    half_lives: tuple[float, ...] = (1000.0, 8000.0)
    looks: tuple[int, ...] = (22, 44, 66, 88, 110, 132)
    graph: int = 60
    scale_tail: int = 3000
    scale_least: int = 200
    memory: int = 2000
    refresh: int = 100
    memory_least: int = 400
    booster_least: int | None = None
    inner_tail: int = 3000
    inner_least: int = 2000

    @property
    def core(self) -> tuple[int, int, int, int]:
        return self.train, self.core_tail, self.core_least, self.core_cap

    @property
    def inner(self) -> Settings:
        """One step earlier: what is fitted before the last ``inner_tail`` training bars."""
        return replace(self, train=self.train - self.inner_tail)


FULL = Settings()
SHORT = Settings(
    train=60, windows=(40, 60), wide_windows=(30, 50), least_pairs=25, tails=(50, 60), core_tail=30, core_least=20, core_cap=26,
    covariance=50, covariance_least=25, half_lives=(20.0, 60.0), looks=(10, 20), graph=30, scale_tail=40, scale_least=10,
    memory=50, refresh=10, memory_least=25, booster_least=20, inner_tail=20, inner_least=30,
)


# --- the graph leg ------------------------------------------------------------------------------------


def graph_leg(f: Arrays, s: Settings, gain_a: float = 1.0, gain_b: float = 1.0, label: str = "target", windows: tuple[int, ...] | None = None, shrink: float = 0.10) -> np.ndarray:
    """Unit price-space graph plus unit rank-space graph."""
    out = np.zeros_like(f["f1"])
    if gain_a:
        out += gain_a * m.unit(m.var_graph(f["f1"], windows or s.windows, shrink, s.least_pairs))
    if gain_b:
        n = min(s.train, len(f["f1"]))
        y, purge = (f["target"], 5) if label == "target" else (np.vstack([f["f1"][1:n], np.zeros((1, f["f1"].shape[1]))]), 1)
        fits = [m.rank_var_fit(f["f1"][max(0, n - w) : n], y[max(0, n - w) : n], purge=purge) for w in s.tails]
        out += gain_b * m.unit(m.rank_var_apply(f["f1"], fits))
    return m.centre(out)


# --- the core leg -------------------------------------------------------------------------------------

# Blend of the core with the learned and trend legs.
CORE_SHARE, LEARNED_SHARE, TREND_SHARE = 0.60, 0.20, 0.20
CORE_SCALE, LEARNED_SCALE, TREND_SCALE = 0.34507836, 0.86575845, 0.60800000


def core_leg(f: Arrays, s: Settings, centre_beta: bool = True, of: str = "core") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(core, trend, beta) from the columns of ``core.signals``."""
    return core.blend({"f1": f["f1"]} | {c: f[f"{of}_{c}"] for c in core.FIELDS}, *s.core, centre_beta)


def lead_lag(f1: np.ndarray) -> np.ndarray:
    """Rank of what the expanding lead-lag graph of standardised returns passes on."""
    d = m.centre(f1)
    rows = np.arange(1.0, len(d) + 1)[:, None]
    mean = np.cumsum(d, axis=0) / rows
    sd = np.sqrt(np.maximum(np.cumsum(d * d, axis=0) / rows - mean * mean, 1e-18))
    u = np.where(rows > 10, np.clip(d / (sd + 1e-12), -3, 3), 0.0)
    out = m.rank_one(m.expanding_adjacency(u, 40))
    out[:41] = 0.0
    return m.centre(out)


def learned_leg(f: Arrays, of: str = "gbt") -> np.ndarray:
    """Mean of the ensemble's predictions: de-meaned, off ranked f1 where asked, unit in every bar."""
    r1 = m.centre(m.rank_mean(f["f1"]))
    out = np.zeros_like(r1)
    for i, b in enumerate(models.ENSEMBLE):
        p = m.centre(f[f"{of}{i}"])
        p = p - m.project(p, r1, 1e-12) if b.neutral else p
        out += p / (p.std(axis=1, keepdims=True) + m.TINY)
    return m.centre(out / len(models.ENSEMBLE))


def apex_leg(f: Arrays, s: Settings, mapped: bool = True, centre_beta: bool = True, window: int | None = None, scales=(CORE_SCALE, LEARNED_SCALE, TREND_SCALE), of: tuple[str, str] = ("core", "gbt")) -> np.ndarray:
    """Core, learned and trend legs off beta, half of it through the shrunk inverse covariance."""
    main, trend, beta = core_leg(f, s, centre_beta, of[0])
    out = CORE_SHARE / scales[0] * main + LEARNED_SHARE / scales[1] * learned_leg(f, of[1]) + TREND_SHARE / scales[2] * trend
    out = out - m.project(out, beta)
    if mapped:
        out = m.risk_map(out, f["f1"], 0.5, window or s.covariance, s.covariance_least)
    return m.centre(out)


# --- other legs ---------------------------------------------------------------------------------------


def ou_leg(f: Arrays, s: Settings) -> np.ndarray:
    return m.centre(m.rank_one(m.ou_score(f["f1"], s.graph)))


# Reciprocal risk of the six graph primitives.
BASKET = {
    "levy": 52.38434994132883,
    "centrality_rev": 41.39598831657011,
    "secondorder": -48.32167643097667,
    "partial_rev": 54.71724552268681,
    "corr_rev": 47.957177386804155,
    "flow_imb": 60.81299994309143,
}


def basket_leg(f: Arrays, s: Settings) -> np.ndarray:
    made = {
        "levy": m.levy_area(f["f1"], s.looks),
        "centrality_rev": m.centrality_reversal(f["f1"], s.graph),
        "secondorder": m.second_order(f["f1"], s.graph),
        "partial_rev": m.partial_reversal(f["f1"], s.graph),
        "corr_rev": m.correlation_reversal(f["f1"], s.graph),
        "flow_imb": m.flow_imbalance(f["f1"], s.graph),
    }
    return sum(w * m.centre(m.rank_mean(m.centre(made[c]))) for c, w in BASKET.items())


def profit_risk(leg: np.ndarray, f1: np.ndarray) -> float:
    """Deviation of the profit of the row before on this row's returns."""
    return float((leg[:-1] * f1[1:]).sum(axis=1).std())


def measured(legs: list[np.ndarray], f: Arrays, s: Settings, fallback: tuple[float, ...]) -> list[float]:
    """Risk of each leg over the last training rows."""
    n = min(s.train, len(f["f1"]))
    a = max(0, n - s.scale_tail)
    if n - a < s.scale_least:
        return list(fallback)
    risks = [profit_risk(leg[a:n], f["f1"][a:n]) for leg in legs]
    return [r if r > 1e-12 else d for r, d in zip(risks, fallback)]


def dispersion_scales(legs: list[np.ndarray], s: Settings, prior: tuple[float, ...]) -> list[float]:
    """Median row deviation over the last training rows, drawn halfway to a prior."""
    out = []
    for leg, p in zip(legs, prior):
        d = leg[max(0, s.train - s.scale_tail) : s.train].std(axis=1)
        d = d[d > 1e-12]
        out.append(0.5 * float(np.median(d)) + 0.5 * p if len(d) >= s.scale_least else p)
    return out


# The four-leg master blend.
RESIDUAL_GAIN = 3.8918
MASTER_SCALES = (2.547476, 21.719934, 0.575869, 0.606977)
STATE_WEIGHTS = (0.25, 0.15, 0.20, 0.15, 0.25)
STATE_RISK, IDIO_RISK = 0.011784, 0.022791


def _master_signals() -> dict[str, Node]:
    """Ranked signals of the master blend: five of state and flow, five of slow idiosyncratic reversal."""
    from ..functions.scalar import fill
    from ..operators import cross as x
    from ..operators import series as t
    from .components import f1, f6, line, market, share

    def idio(w: int) -> Node:
        return fill(f1 - fill(t.rolling_beta(f1, market, w, 20), 1.0) * market)

    a, b = idio(125), idio(250)
    r = signal_rank
    made = {
        "v0": -r(fill(t.rolling_rank(f6, 250, 10), 0.5)),
        "v1": -r(f6 - t.rolling_mean(f6, 120)),
        "v2": -r(t.rolling_sum(line, 60)),
        "v3": -r(t.ewm_mean(line, 100)),
        "v4": -r(t.rolling_sum(share, 5)),
        "i0": r(t.drawdown(t.cumulate(a), 60)),
        "i1": -r(t.rolling_sum(a, 40)),
        "i2": r(t.drawdown(t.cumulate(b), 40)),
        "i3": r(t.drawdown(t.cumulate(b), 80)),
        "i4": -r(t.rolling_sum(b, 20)),
        "x34": r(t.ewm_mean(e3 + e4, 3)),
        "rev3": COMPONENTS["rev_f3"],
    }
    return {n: x.demean(fill(v)) for n, v in made.items()}


def master_legs(f: Arrays, s: Settings, weights=STATE_WEIGHTS, family=(0.55 / STATE_RISK, 0.45 / IDIO_RISK), measure: bool = False) -> list[np.ndarray]:
    first = m.centre(m.unit(m.var_graph(f["f1"], s.windows, 0.10, s.least_pairs))) + RESIDUAL_GAIN * f["x34"]
    state = sum(w * f[f"v{i}"] for i, w in enumerate(weights))
    idio = sum(0.2 * f[f"i{i}"] for i in range(5))
    if measure:
        family = [0.5 / r for r in measured([state, idio], f, s, (0.01190105, 0.02302940))]
    return [first, m.centre(family[0] * state + family[1] * idio), lead_lag(f["f1"]), f["rev3"]]


def _master(adaptive: str) -> Callable[[Arrays, Settings], np.ndarray]:
    def run(f: Arrays, s: Settings) -> np.ndarray:
        legs = master_legs(f, s, (0.2,) * 5 if adaptive == "risk" else STATE_WEIGHTS, measure=adaptive == "risk")
        scales = list(MASTER_SCALES)
        if adaptive == "dispersion":
            scales = dispersion_scales(legs, s, MASTER_SCALES)
        elif adaptive == "risk":
            scales = measured(legs, f, s, MASTER_SCALES)
        return sum(leg / c for leg, c in zip(legs, scales)) / len(legs)

    return run


def _basis_signals() -> dict[str, Node]:
    """Ranked signals of odd moments of the return (lags, features, scaled, powers), each off the ranked return itself."""
    from ..functions.scalar import fill
    from ..operators import cross as x
    from ..operators import series as t
    from .components import f1, f3, f4, f5, f6

    ret = fill(f1)
    spread, market_move = fill(t.rolling_std(ret, 60, 10)), x.demean(ret)
    made = {f"lag{k}": t.lag(ret, k) for k in range(1, 5)} | dict(f3=f3, f4=f4, f5=f5, f6=f6)
    made |= {"loud": ret * spread, "quiet": ret / (spread + 1e-6), "lone": ret * market_move * market_move, "turn": ret * ret * fill(t.lag(ret))}
    ranked = {n: x.demean(x.rank_average(fill(v))) for n, v in made.items()}
    return {f"basis_{n}": x.project_off(v, x.demean(x.rank_average(ret))) for n, v in ranked.items()}


BASIS = tuple(f"basis_{n}" for n in ("lag1", "lag2", "lag3", "lag4", "f3", "f4", "f5", "f6", "loud", "quiet", "lone", "turn"))


def _mean_variance(f: Arrays, s: Settings) -> np.ndarray:
    basis = [f[b] for b in BASIS]
    n = min(s.train, len(f["f1"]))
    profits = m.leg_profits([b[:n] for b in basis], f["f1"][:n])[min(60, n // 3) :]
    return sum(w * b for w, b in zip(m.mean_variance_weights(profits), basis))


def _ticket1(f: Arrays, s: Settings) -> np.ndarray:
    return f["slow_state"] + 2.0 * lead_lag(f["f1"])


def _carrier(f: Arrays, s: Settings) -> np.ndarray:
    p = m.centre(-m.rank_mean(m.cs_residual(f["f1"], [f[f"f{k}"] for k in range(2, 7)], ridge=1e-12)))
    return m.risk_map(p, f["f1"], 0.5, s.covariance, s.covariance_least)


def _two_measured(f: Arrays, s: Settings) -> np.ndarray:
    legs = [m.residual_leg(f), ou_leg(f, s)]
    return sum(leg / r for leg, r in zip(legs, measured(legs, f, s, (0.018789, 0.017123))))


#: Share of the graph leg's profit risk beside the apex.
SLEEVE_SHARE = 0.15


def inner_measure(f: Arrays, s: Settings) -> tuple[tuple[float, float, float], float]:
    """Scales of core, learned and trend leg and the gain of the graph leg, on the last ``inner_tail`` training
    bars, with every leg fitted on the bars before those; the fixed ones where there are too few of either."""
    fixed = (CORE_SCALE, LEARNED_SCALE, TREND_SCALE), SLEEVE_GAIN
    n = min(s.train, len(f["f1"]))
    if n < s.inner_tail + s.inner_least:
        return fixed
    early, tail = s.inner, slice(s.train - s.inner_tail, n)
    main, trend, _ = core_leg(f, early, of="early")
    scales = tuple(float(leg[tail].std(axis=1).mean()) for leg in (main, learned_leg(f, "early_gbt"), trend))
    if not all(np.isfinite(v) and v > 0 for v in scales):
        return fixed
    apex = apex_leg(f, early, scales=scales, of=("early", "early_gbt"))[tail]
    sleeve = graph_leg({c: f[c] for c in FIELDS}, early)[tail]
    risks = profit_risk(apex, f["f1"][tail]), profit_risk(sleeve, f["f1"][tail])
    gain = SLEEVE_SHARE / (1 - SLEEVE_SHARE) * risks[0] / risks[1] if risks[1] > 0 else 0.0
    return (scales, gain) if np.isfinite(gain) and gain > 0 else fixed


def _remeasured(f: Arrays, s: Settings) -> np.ndarray:
    """Apex plus graph with the scales and the sleeve's gain measured one step earlier."""
    scales, gain = inner_measure(f, s)
    return apex_leg(f, s, scales=scales) + gain * graph_leg(f, s)


# --- the catalogue ------------------------------------------------------------------------------------

# Frozen risk of whole legs.
GRAPH_RISK, RESIDUAL_RISK, OU_RISK, APEX_RISK, FLAT_APEX_RISK = 0.04933074223312276, 0.018357239918563376, 0.01674839194002865, 0.019215743864648176, 0.024651576010626338
FINAL_APEX_RISK, CAT_RISK, CAT_RETURN_RISK, BASKET_RISK = 0.024778769297110750, 0.02513033691860830, 0.03490450588688932, 2.893643802859039
SLEEVE_GAIN = 0.068664
FIVE = {"ind1": 0.56742300083336394, "path": 0.08624447369029180, "horizon": 0.37879777661375136, "plane": 0.41821658963799724, "ind5": 21.62688470362029136}
QUAD = {"ind1": 0.22472727603967144, "ind5": 8.56530468720973381}

Kernel = Callable[[Arrays, Settings], np.ndarray]


@dataclass(frozen=True)
class Predictor:
    """A kernel and what it needs besides the fields."""

    kernel: Kernel
    signals: tuple[str, ...] = ()
    learned: tuple[str, ...] = ()


def _sum(*parts: tuple[Kernel, float]) -> Kernel:
    return lambda f, s: sum(leg(f, s) / risk for leg, risk in parts)


_graph: Kernel = graph_leg
_resid: Kernel = lambda f, s: m.residual_leg(f)
_apex: Kernel = apex_leg
_flat: Kernel = lambda f, s: apex_leg(f, s, mapped=False, centre_beta=False)
_flat_centred: Kernel = lambda f, s: apex_leg(f, s, mapped=False)
_raw_mapped: Kernel = lambda f, s: apex_leg(f, s, centre_beta=False)
_cat: Kernel = lambda f, s: m.centre(m.rank_mean(f["cat"]))
_gbt, _core = ("ensemble",), ("core",)


def _column(name: str) -> Kernel:
    return lambda f, s: f[name]


def _path_leg(f: Arrays, s: Settings) -> np.ndarray:
    q, out = m.rank_mean(f["f1"]), m.rank_mean(f["path"])
    return m.centre(out - m.project(out, q))


def _plane(f: Arrays, s: Settings) -> np.ndarray:
    return m.centre(m.plane_leg(f["f1"], min(s.train, len(f["f1"])), half_lives=s.half_lives))


def _two_graphs(f: Arrays, s: Settings) -> np.ndarray:
    n = min(s.train, len(f["f1"]))
    return m.unit(m.plane_leg(f["f1"], n, half_lives=s.half_lives)) + m.unit(m.granger_leg(f, n, half_lives=s.half_lives))


_apex8 = Predictor(lambda f, s: apex_leg(f, s) + SLEEVE_GAIN * graph_leg(f, s), signals=_core, learned=_gbt)
_apex7 = Predictor(_apex, signals=_core, learned=_gbt)
_apex_p = Predictor(_raw_mapped, signals=_core, learned=_gbt)
_final = Predictor(_sum((_graph, GRAPH_RISK), (_apex, FINAL_APEX_RISK)), signals=_core, learned=_gbt)
_fusion = Predictor(_sum((_graph, GRAPH_RISK), (_resid, RESIDUAL_RISK), (_flat, FLAT_APEX_RISK)), signals=_core, learned=_gbt)
_again = Predictor(_remeasured, signals=("core", "early"), learned=("ensemble", "early_ensemble"))
_t2resid = Predictor(_sum((_graph, GRAPH_RISK), (_resid, RESIDUAL_RISK)))
_graph_only = Predictor(_graph)

CATALOGUE: dict[str, Predictor] = {
    "apex6": Predictor(_flat, signals=_core, learned=_gbt),
    "apex7": _apex7,
    "apex7_c": _apex7,
    "apex8": _apex8,
    "apex8_c": _apex8,
    "apex8a": _again,
    "apex8a_c": _again,
    "apexP": _apex_p,
    "apexP_c": _apex_p,
    "apexfusion": _fusion,
    "apexfusionc": _fusion,
    "ax7g": Predictor(_sum((_graph, GRAPH_RISK), (_apex, APEX_RISK)), signals=_core, learned=_gbt),
    "ax7g_w120": Predictor(_sum((_graph, GRAPH_RISK), (lambda f, s: apex_leg(f, s, window=min(120, s.covariance)), APEX_RISK)), signals=_core, learned=_gbt),
    "catgraph": Predictor(_sum((_graph, GRAPH_RISK), (_cat, CAT_RISK)), learned=("cat",)),
    "catgraph_eqret": Predictor(_sum((_graph, GRAPH_RISK), (_cat, CAT_RETURN_RISK)), learned=("cat",)),
    "catgraphapex": Predictor(_sum((_graph, GRAPH_RISK), (_apex, APEX_RISK), (_cat, CAT_RISK)), signals=_core, learned=("ensemble", "cat")),
    "cat1bar": Predictor(lambda f, s: m.centre(m.rank_mean(f["cat1"])), learned=("cat1",)),
    "cr_ewma": Predictor(lambda f, s: m.recursive_map(f["f1"])),
    "cr_fact": Predictor(lambda f, s: m.factor_var(f["f1"], memory=s.memory, refresh=s.refresh, least=s.memory_least)),
    "cr_prec": Predictor(lambda f, s: m.partial_graph(f["f1"])),
    "cr_rob": Predictor(lambda f, s: m.quadrant_map(f["f1"])),
    "final": _final,
    "meridian": _final,
    "gbm_lgb": Predictor(lambda f, s: m.centre(m.rank_mean(f["lgb"])), learned=("lgb",)),
    "gbm_xgb": Predictor(lambda f, s: m.centre(m.rank_mean(f["xgb"])), learned=("xgb",)),
    "gbm_cat": Predictor(_cat, learned=("cat",)),
    "gbm_ada": Predictor(lambda f, s: m.centre(m.rank_mean(f["ada"])), learned=("ada",)),
    "gbm_ens": Predictor(lambda f, s: m.centre(m.rank_mean(sum(m.rank_mean(f[c]) for c in ("lgb", "xgb", "cat", "ada")) / 4)), learned=("lgb", "xgb", "cat", "ada")),
    "gra7": Predictor(_sum((_graph, GRAPH_RISK), (_resid, RESIDUAL_RISK), (_apex, APEX_RISK)), signals=_core, learned=_gbt),
    "ind2": Predictor(_path_leg, learned=("path",)),
    "ind4": Predictor(_plane),
    "levy": Predictor(lambda f, s: m.centre(m.rank_one(m.levy_area(f["f1"], s.looks)))),
    "odd2c": Predictor(_mean_variance, signals=("basis",)),
    "penta": Predictor(
        _sum((_graph, GRAPH_RISK), (_apex, APEX_RISK), (_column("ind1"), FIVE["ind1"]), (_path_leg, FIVE["path"]), (_column("ind3"), FIVE["horizon"]), (_plane, FIVE["plane"]), (_column("ind5"), FIVE["ind5"])),
        signals=("core", "ind1", "ind3", "ind5"),
        learned=("ensemble", "path"),
    ),
    "quad": Predictor(_sum((_graph, GRAPH_RISK), (_apex, APEX_RISK), (_column("ind1"), QUAD["ind1"]), (_column("ind5"), QUAD["ind5"])), signals=("core", "ind1", "ind5"), learned=_gbt),
    "t29ll": Predictor(_two_graphs),
    "t2basket6": Predictor(_sum((_graph, GRAPH_RISK), (basket_leg, BASKET_RISK))),
    "t2resid": _t2resid,
    "t2resid_fast": _t2resid,
    "t32g0": _graph_only,
    "t32g0b": Predictor(lambda f, s: graph_leg(f, s, gain_a=0.0)),
    "t32g1": Predictor(lambda f, s: graph_leg(f, s, label="next")),
    "t32g1b": Predictor(lambda f, s: graph_leg(f, s, gain_a=0.0, label="next")),
    "t33g": Predictor(lambda f, s: graph_leg(f, s, windows=s.wide_windows, shrink=0.40)),
    "ticket1": Predictor(_ticket1, signals=("slow_state",)),
    "ticket2": _graph_only,
    "ticket3": Predictor(lambda f, s: graph_leg(f, s, gain_b=1.5)),
    "ticket5": Predictor(_master("fixed"), signals=("master",)),
    "ticket5_adaptive": Predictor(_master("dispersion"), signals=("master",)),
    "ticket6": Predictor(_master("risk"), signals=("master",)),
    "ticket7": Predictor(_two_measured),
    "ticket8": Predictor(_sum((_graph, GRAPH_RISK), (_resid, RESIDUAL_RISK), (ou_leg, OU_RISK))),
    "triad": Predictor(_sum((_graph, GRAPH_RISK), (_resid, RESIDUAL_RISK), (_flat, FLAT_APEX_RISK)), signals=_core, learned=_gbt),
    "triad2": Predictor(_sum((_graph, GRAPH_RISK), (_flat, FLAT_APEX_RISK)), signals=_core, learned=_gbt),
    "triad_bd": Predictor(_sum((_graph, GRAPH_RISK), (_resid, RESIDUAL_RISK), (_flat_centred, FLAT_APEX_RISK)), signals=_core, learned=_gbt),
    "triad_seed": Predictor(_sum((_graph, GRAPH_RISK), (_resid, RESIDUAL_RISK), (_flat, FLAT_APEX_RISK)), signals=_core, learned=("ensemble_seeds",)),
    "v13lw": Predictor(_carrier),
}

_SINGLE = {"lgb": models.LGB, "xgb": models.XGB, "cat": models.CAT, "cat1": models.CAT_ONE_BAR, "ada": models.ADA}


def _boosters(what: str) -> tuple[dict[str, Node], dict[str, models.Booster]]:
    """Features and boosters, by output column, of one learned part."""
    if what.endswith("ensemble") or what.endswith("seeds"):
        prefix = "early_gbt" if what.startswith("early") else "gbt"
        shift = 4 if what.endswith("seeds") else 0
        return models.engineered(), {f"{prefix}{i}": replace(b, seed=b.seed + shift * i) for i, b in enumerate(models.ENSEMBLE)}
    if what == "path":
        return models.path_features(), {"path": models.PATH}
    return models.simple(), {what: _SINGLE[what]}


def _learn(panel: DataFrame, parts: tuple[str, ...], s: Settings) -> DataFrame:
    """Predictions of the learned parts: boosters that share features and training rows share one pass."""
    groups: dict[tuple, tuple[dict[str, Node], dict[str, models.Booster], int]] = {}
    for what in parts:
        features, boosters = _boosters(what)
        train = s.inner.train if what.startswith("early") else s.train
        if s.booster_least:
            boosters = {c: replace(b, least=min(b.least, s.booster_least)) for c, b in boosters.items()}
        groups.setdefault((tuple(features), train), (features, {}, train))[1].update(boosters)
    out = None
    for features, boosters, train in groups.values():
        made = models.with_labels(panel, features, sorted({b.label for b in boosters.values()}))
        fitted = models.boosted(made, list(features), boosters, train)
        out = fitted if out is None else out.join(fitted, ["period", "bar", "name_ix"])
    return out


def _nodes(part: str, s: Settings) -> dict[str, Node]:
    if part == "master":
        return _master_signals()
    if part == "basis":
        return _basis_signals()
    if part in ("core", "early"):
        return {f"{part}_{c}": v for c, v in core.signals(*(s.core if part == "core" else s.inner.core)).items()}
    return {part: PREDICTORS[part]}


def score(panel: DataFrame, name: str, settings: Settings = FULL, only_scored: bool = True) -> DataFrame:
    """period, bar, name_ix, score of a predictor; by default of the bars after the training ones."""
    if name in PREDICTORS:
        return evaluate(panel, {"score": PREDICTORS[name]})
    p = CATALOGUE[name]
    nodes: dict[str, Node] = {}
    for part in p.signals:
        nodes |= _nodes(part, settings)
    df = evaluate(panel, nodes, FIELDS) if nodes else panel.select("period", "bar", "name_ix", *FIELDS)
    columns = [*nodes]
    if p.learned:
        fitted = _learn(panel, p.learned, settings)
        columns += fitted.columns[3:]
        df = df.join(fitted, ["period", "bar", "name_ix"])
    keep = settings.train if only_scored else 0

    def kernel(f: Arrays) -> Arrays:
        out = m.centre(np.nan_to_num(p.kernel(f, settings), posinf=0.0, neginf=0.0))
        out[:keep] = np.nan
        return {"score": out}

    scored = m.per_period(df, kernel, (*FIELDS, *columns))
    return scored.where("score is not null and not isnan(score)")


NAMES = sorted([*CATALOGUE, *(n for n in PREDICTORS if n != "slow_state")])
