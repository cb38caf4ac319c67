"""Predictors whose weights are constants: weighted sums of components, de-meaned in every bar."""

from __future__ import annotations

from ..functions.scalar import clip, fill
from ..operators import cross as x
from ..operators import series as t
from .components import COMPONENTS, e3, f1, f2, f3, f4, f5, f6, market
from .expr import Node

# Component weights.
BEST = {
    "idio_rev_ewm10": 0.545872,
    "x34_sum_ewm3": 1.145712,
    "leadlag_sign": 0.660906,
    "beta_x_mmom5": -0.353031,
    "vmix2": 0.274694,
    "rev_f4": 0.370824,
    "beta_x_mmom20": 0.309714,
    "f6": -0.429251,
    "rev_f3": 0.510290,
    "rev_dispz": -0.413130,
}
MAX_SHARPE = {
    "rev_convex": 0.087539,
    "rev_bigmove": -0.054032,
    "vm_nov60": 0.051471,
    "rev1_x_vol": -0.037949,
    "idio_rev_x_f5": -0.035091,
    "mix_vol_rev_mom": -0.035084,
    "idio_rev1": 0.031424,
    "f4_minus_f1": 0.019143,
}
UNIQUE = {
    "leadlag_follow": 1.890644,
    "dist_high20": -1.286372,
    "vm_prize50": 1.213596,
    "x3_ewm3": 1.002326,
    "mix_disp3_dd_mom": 0.904485,
    "dist_high40": 0.768528,
    "f6_x_vol": -0.309328,
    "x4p_ewm5": 0.307333,
    "age_high40": -0.297122,
    "dist_high10": 0.290528,
    "fade_sflow_ewm10": 0.273248,
    "fade_adl_ewm100": -0.244467,
    "lowbeta": -0.236717,
    "beta_instab": 0.202221,
    "lowf5abs": 0.184939,
}
SET4 = {
    "f4_minus_f1": 0.090150,
    "vm_nov60": 0.082374,
    "idio_revsum60": 0.067962,
    "leadlag_follow3": 0.043999,
    "f6_x_vol": 0.034605,
    "mix_mvol_mdd_mom": -0.026232,
    "beta_instab": 0.024466,
    "idio_rev_x_f5": -0.018856,
}
SPARSE_BASE = {
    "rev_F1": 0.4008013843917598,
    "AD_F2_perp": 0.4,
    "F3_resid": 0.20001094126150296,
    "revsum_F1_w120_perp": 0.15000000026968516,
    "vol20": 0.0499999947679182,
}
SPARSE_SLEEVE = {
    "f4_minus_f1": 0.383174,
    "vm_nov60": 0.350122,
    "idio_revsum60": 0.288866,
    "leadlag_follow3": 0.187013,
    "f6_x_vol": 0.147085,
    "mix_mvol_mdd_mom": -0.111496,
    "beta_instab": 0.103990,
    "idio_rev_x_f5": -0.080146,
}
INNOVATION_SCALES = {"f2": 0.668332, "f5": 0.667242, "f6": 0.172467}
DISTRIBUTION = (
    ("semiasym_60", 1.0, 2.28979007e-02),
    ("semiasym_240", 1.0, 2.09426220e-02),
    ("idio_semiasym_120", 1.0, 2.17198979e-02),
    ("volofvol_60", 1.0, 2.19749945e-02),
    ("skew_120", -1.0, 1.99313611e-02),
    ("tailratio_60", 1.0, 1.87222037e-02),
    ("extremefreq_20", -1.0, 1.53846244e-02),
    ("betaasym_120", 1.0, 2.16261050e-02),
)


def weighted(weights: dict[str, float]) -> Node:
    return x.blend([(COMPONENTS[name], w) for name, w in weights.items()])


def _quarter(w: int) -> int:
    return max(2, w // 4)


def _idio(w: int) -> Node:
    return f1 - t.rolling_beta(f1, market, w, _quarter(w)) * market


#: The eight statistics of the distributional blend, before their ranks.
SHAPES: dict[str, Node] = {
    "semiasym_60": t.semi_asymmetry(f1, 60, _quarter(60)),
    "semiasym_240": t.semi_asymmetry(f1, 240, _quarter(240)),
    "idio_semiasym_120": t.semi_asymmetry(_idio(120), 120, _quarter(120)),
    "volofvol_60": t.rolling_std(t.rolling_std(f1, 20, _quarter(20)), 60, _quarter(60)),
    "skew_120": t.skew(f1, 120, _quarter(120)),
    "tailratio_60": t.tail_ratio(f1, 60, _quarter(60)),
    "extremefreq_20": t.extreme_frequency(f1, 20, _quarter(20)),
    "betaasym_120": t.downside_beta_gap(f1, market, 120, _quarter(120)),
}


def distributional() -> Node:
    return x.blend([(x.rank_present(SHAPES[name]), sign / sigma) for name, sign, sigma in DISTRIBUTION])


def innovations() -> Node:
    from .expr import field

    out = None
    for name, scale in INNOVATION_SCALES.items():
        leg = t.innovation(fill(field(name))) * (1 / scale)
        out = leg if out is None else out + leg
    return x.demean(out)


def standardised_return() -> Node:
    """De-meaned f1 in its own expanding deviations, clipped."""
    u = x.demean(fill(f1))
    return clip(u / (t.expanding_std(u) + 1e-12), 3.0)


def lagged_reversal() -> Node:
    g = fill(f1)
    return -x.rank_ordinal(0.9 * fill(t.lag(g, 1)) + 0.35 * fill(t.lag(g, 2)) - 1.4 * t.ewm_zero(e3, 2))


def state_fade() -> Node:
    """Ordinal rank of f6 in deviations from its own past, turned round."""
    g = fill(f6)
    return -x.rank_ordinal((g - t.rolling_mean(g, None)) / (t.expanding_std(g) + 1e-12))


def slow_state_parts() -> list[tuple[Node, float]]:
    """Three of the four blocks of the lead-lag diversifier; the fourth is a pair graph (operators.pairs)."""
    return [(x.rank_ordinal(f3 - f1), 1.0), (state_fade(), 0.75), (lagged_reversal(), 0.60)]


def volume_tail() -> Node:
    return x.rank_average(t.volume_share(f5))


def horizon_reversal(horizons: tuple[int, ...] = (2, 5, 20)) -> Node:
    """Sums of earlier residuals of f1 on the other features over some horizons, ranked and turned round."""
    e = x.residual(f1, [f2, f3, f4, f5, f6])
    legs = [x.unit(x.demean(x.rank_ordinal(-fill(t.lag(t.rolling_sum(e, k)))))) for k in horizons]
    return x.demean(sum(legs[1:], legs[0]))


def residual_reversal() -> Node:
    """Ordinal rank of the f1 residual on the other features, turned round."""
    return x.demean(x.rank_ordinal(-x.residual(f1, [f2, f3, f4, f5, f6])))


PREDICTORS: dict[str, Node] = {
    "best": weighted(BEST),
    "max": weighted(MAX_SHARPE),
    "unique": weighted(UNIQUE),
    "set4": weighted(SET4),
    "sparseplus": weighted(SPARSE_BASE) + weighted(SPARSE_SLEEVE),
    "ind1": innovations(),
    "ind3": horizon_reversal(),
    "ind5": distributional(),
    "slow_state": x.blend(slow_state_parts()),
}

__all__ = ["PREDICTORS", "SHAPES", "f2"]
