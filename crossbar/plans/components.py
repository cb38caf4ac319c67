"""Named signal components: the leaf queries that blends are made of."""

from __future__ import annotations

from ..functions.scalar import convex, fill, flow, log1p, logistic, magnitude, sign, snap, tanh
from ..operators import cross as x
from ..operators import series as t
from .expr import Node, each, field

f1, f2, f3, f4, f5, f6 = (field(f"f{k}") for k in range(1, 7))
target = field("target")
rank = x.rank_average

BETA_BARS = 250

market = x.mean(f1)
dispersion = x.std_samp(f1)
price = t.cumulate(f1)
sd20, sd60 = t.rolling_std(f1, 20, 2), t.rolling_std(f1, 60, 5)
r1 = rank(f1)
beta = fill(t.rolling_beta(f1, market, BETA_BARS, 20), 1.0)
residual = fill(f1 - beta * market)
e3, e4 = x.residual2(f3, f1, f2), x.residual2(f4, f1, f2)
volume = magnitude(f5)
log_volume = log1p(volume)
share = t.squashed(f5)
line = flow(f1, f5)
state_rank = fill(t.history_rank(f6, 10), 0.5)
volume_level = volume / (t.rolling_mean(volume, 250) + 1e-9)
log_level = log_volume / (t.rolling_mean(log_volume, 250, 5) + 1e-9)
dispersion_z = tanh(t.zscore_rolling(dispersion))
market_vol_z = tanh(t.zscore_rolling(t.ewm_mean(magnitude(market), 20, least=3)))
momentum = rank(t.ewm_mean(f1, 240))
state_change = -rank(f6 - t.rolling_mean(f6, 60))
low_shock = -rank(t.rolling_mean(log_level, 5))

# a name's correlation with the market one bar before; the first bar has none before it and is left out
_after_first = each("after_first", lambda d, a, b: f"(CASE WHEN {b} IS NOT NULL THEN {a} END)", f1, t.lag(market))
follow = rank(t.expanding_corr(_after_first, t.lag(market)))


def scaled_market(bars: int) -> Node:
    """Rolling sum of the market over its own rolling deviation."""
    m = t.rolling_sum(market, bars) if bars > 1 else market
    return fill(m / (t.rolling_std(m, 120, 10) + 1e-12))


vm_nov60 = (
    0.48 * -rank(state_rank)
    + 0.22 * -rank(t.rolling_mean(state_rank, 10))
    + 0.18 * low_shock
    + 0.05 * -rank(t.rolling_sum(share, 5))
    + 0.04 * -rank(t.rolling_mean(sign(f5), 20))
    + 0.03 * state_change
)
vm_prize50 = (
    0.07 * -rank(f6)
    + 0.10 * -rank(state_rank)
    + 0.19 * -rank(t.rolling_sum(share, 5))
    + 0.13 * -rank(t.rolling_sum(share, 20))
    + 0.15 * low_shock
    + 0.18 * state_change
    + 0.18 * -rank(t.ewm_mean(line, 60))
)

#: Accumulation line on the running product of 1 + f2 / 100 (this panel's f2 is a level, not a return).
accumulation_f2 = rank(t.accumulation(t.cumulate_product(f2 * 0.01), t.volume_share(f5), 5))

COMPONENTS: dict[str, Node] = {
    "idio_rev_ewm10": -rank(t.ewm_mean(residual, 10)),
    "beta_x_mmom5": x.demean(rank(beta) * sign(t.rolling_sum(market, 5))),
    "beta_x_mmom20": x.demean(rank(beta) * sign(t.rolling_sum(market, 20))),
    "x34_sum_ewm3": rank(t.ewm_mean(e3 + e4, 3)),
    "leadlag_sign": x.demean(follow * sign(market)),
    "vmix2": x.demean(-rank(state_rank) + -rank(t.rolling_sum(line, 60))),
    "rev_f3": -rank(f3),
    "rev_f4": -rank(f4),
    "f6": rank(f6),
    "rev_dispz": x.demean(-r1 * dispersion_z),
    "rev_convex": x.demean(convex(r1)),
    "rev_bigmove": x.demean(x.big_move(f1, sd60, r1)),
    "rev1_x_vol": x.demean(-r1 * rank(fill(sd20))),
    "idio_rev1": -rank(residual),
    "mix_vol_rev_mom": x.demean(x.mixture(logistic(market_vol_z, 2.0), -r1, momentum)),
    "f4_minus_f1": rank(f4 - f1),
    "idio_rev_x_f5": x.demean(-rank(residual) * rank(volume_level)),
    "vm_nov60": x.demean(vm_nov60),
    "lowbeta": -rank(beta),
    "idio_dist_high20": rank(snap(t.drawdown(t.cumulate(residual), 20))),
    "revsum5": -rank(t.rolling_sum(f1, 5)),
    "dist_high10": rank(snap(t.drawdown(price, 10))),
    "dist_high20": rank(snap(t.drawdown(price, 20))),
    "dist_high40": rank(snap(t.drawdown(price, 40))),
    "vol20": rank(fill(sd20)),
    "lowvol60": -rank(fill(sd60)),
    "x3_ewm3": rank(t.ewm_mean(e3, 3)),
    "x4p_ewm5": rank(t.ewm_mean(e4, 5)),
    "x34_agree": x.demean(rank(t.ewm_mean(e3, 3)) + rank(t.ewm_mean(e4, 3)) + 0.75 * rank(t.rolling_mean(sign(f3) * sign(f4), 20))),
    "leadlag_follow": x.demean(follow * tanh(scaled_market(1))),
    "leadlag_follow3": x.demean(follow * tanh(scaled_market(3))),
    "mix_disp3_dd_mom": x.demean(x.mixture(logistic(dispersion_z, 3.5), rank(snap(t.drawdown(price, 20))), momentum)),
    "mix_mvol_mdd_mom": x.demean(x.mixture(logistic(market_vol_z, 2.0), rank(t.drawdown_depth(price, sd60)), momentum)),
    "age_high40": x.demean(x.rank_percent(t.age_of_high(price, 40)) * 2.0 - 1.0),
    "aged_deep_dd": x.demean(rank(rank(t.drawdown_depth(price, sd60)) + rank(t.age_of_high(price, 40)))),
    "beta_instab": -rank(t.beta_instability(f1, market)),
    "vm_prize50": x.demean(vm_prize50),
    "fade_adl_ewm100": -rank(t.ewm_mean(line, 100)),
    "fade_sflow_ewm10": -rank(t.ewm_mean(share, 10)),
    "lowf5abs": -rank(volume_level),
    "f6_x_vol": x.demean(rank(f6) * rank(fill(sd20))),
    "idio_revsum60": -rank(t.rolling_sum(residual, 60)),
    "rev_F1": x.demean(-r1),
    "revsum_F1_w120": x.demean(-rank(t.rolling_sum(f1, 120))),
    "F3_resid": x.demean(rank(fill(x.residual2(f3, f1, f2, ridge=1e-10)))),
    "AD_F2": x.demean(fill(accumulation_f2)),
}
COMPONENTS["revsum_F1_w120_perp"] = x.demean(x.off_unit(COMPONENTS["revsum_F1_w120"], COMPONENTS["rev_F1"]))
COMPONENTS["AD_F2_perp"] = x.demean(x.off_unit(COMPONENTS["AD_F2"], COMPONENTS["rev_F1"]))
