"""Panel queries by operator id, each with the same as DuckDB SQL.

Values are rounded to six places, those of long chains of operators to four: sums of doubles differ in the
last digits between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import matrix_queries, pair_queries, source_queries, wide_queries
from .functions import scalar as s
from .operators import cross as x
from .operators import series as t
from .plans import catalogue
from .plans import components as c
from .plans.components import COMPONENTS, f1, f2, f3, f4, f5, f6, market, price, residual, sd20, sd60, target
from .plans.expr import Node, evaluate, to_sql
from .plans.predictors import PREDICTORS, SHAPES, lagged_reversal, standardised_return, state_fade
from .sources.panel import PANEL_SQL, lineitem_panel

PLACES, LONG_PLACES = 6, 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_gap = x.demean(f1 - f3)
_u = standardised_return()
_sign1 = s.sign(f1)

#: Operator id -> signal over the default panel.
SIGNALS: dict[str, Node] = {
    "s06_zero_fill": s.fill(f2),
    "x01_demean": x.demean(f3),
    "x02_demean_strict": x.demean_strict(t.lag(f1, 2)),
    "x03_zero_fill_demean": x.demean(s.fill(f2)),
    "x04_csrank_avg": x.rank_average(f5),
    "x05_csrank_ordinal": x.rank_ordinal(f5),
    "x06_csrank_half": x.rank_half(f5),
    "x07_csrank_centred": x.rank_centred(f5),
    "x08_csrank_present": x.rank_present(f2),
    "x09_pct_rank": x.rank_percent(f5),
    "x10_zscore": x.zscore(f1),
    "x11_unit": x.unit(f1),
    "x12_unit_demeaned": x.unit_demeaned(f6),
    "x13_standard_clipped": x.standard_clipped(f2),
    "x14_zclip": x.zclip(f1, 2.0),
    "x15_rms_shape": x.rms_shape(f1),
    "x16_shape_rows": x.shape_rows(f1),
    "x17_market": x.mean(f6),
    "x18_dispersion": x.std_samp(f1),
    "x19_cs_resid2": x.residual2(f3, f1, f2),
    "x20_cs_resid_ridge": x.residual2(f4, f1, f2, ridge=1e-10),
    "x20_cs_resid_three": x.residual(f4, [f1, f2, f3]),
    "x21_cs_resid_five": x.residual(f1, [f2, f3, f4, f5, f6]),
    "x22_cs_resid_dependent": x.residual(f1, [f2, f3, f2 - f3, f5]),
    "x23_project_off": x.project_off(x.demean(f4), x.demean(f1)),
    "x24_neutral_raw": x.neutralise(-x.rank_average(f1), c.beta, centre=False),
    "x25_neutral_centred": x.neutralise(-x.rank_average(f1), c.beta),
    "x26_partial_neutral": x.project_off(x.rank_average(f4), -x.rank_average(f1), share=0.25),
    "x27_off_unit": x.off_unit(x.demean(f4), x.demean(f1)),
    "x28_same_norm": x.same_norm(f3, f1),
    "x29_extreme": x.extreme(f1),
    "x30_convex": s.convex(x.rank_average(f1)),
    "x31_big_move": x.big_move(f1, sd60, x.rank_average(f1)),
    "x32_rank_product": x.rank_average(f1) * x.rank_average(f5),
    "x33_mixture": x.mixture(s.logistic(c.dispersion_z, 2.0), x.rank_average(f1), x.rank_average(f4)),
    "x34_market_gate": s.sign(t.rolling_sum(x.mean(f6), 5)) * x.rank_average(f1),
    "x36_final_demean": x.demean(s.fill(f2)),
    "t01_lag_zero": s.fill(t.lag(f1, 2)),
    "t02_lag_market": t.lag(x.mean(f6)),
    "t03_lead": t.lead(f1),
    "t04_lead_sum": t.lead_sum(f1, 2, 5),
    "t05_rolling_mean_gate": t.rolling_mean(f2, 20, 5),
    "t05_rolling_sum_gate": t.rolling_sum(f2, 20, 5),
    "t06_rolling_std_gate": t.rolling_std(f2, 20, 3),
    "t07_rolling_max": t.rolling_max(f1, 10),
    "t07_rolling_min": t.rolling_min(f1, 10),
    "t08_expanding_mean": t.rolling_mean(f1, None, 5),
    "t08_expanding_std": t.rolling_std(f1, None, 5),
    "t09_rolling_rank": t.rolling_rank(f5, 30, 5),
    "t10_expanding_rank": t.rolling_rank(f6, None, 10),
    "t11_zscore_series": t.zscore_rolling(x.std_samp(f1)),
    "t12_zscore_clipped": t.zscore_clipped(f5, 60, 10),
    "t13_innovation": t.innovation(f5, 60, 10),
    "t14_ts_rank": t.ts_rank(f4 - f1, 60),
    "t15_cumulate": price,
    "t16_cumulate_product": t.cumulate_product(f2 * 0.01),
    "t17_ewm_adjust": t.ewm_mean(f2, 10),
    "t18_ewm_zero": t.ewm_zero(f2, 10),
    "t19_one_pole": t.one_pole(f1, 8.0),
    "t20_decay_linear": t.decay_linear(f2, 5),
    "t21_path_sum": t.rolling_sum(f1, 22),
    "t21_long_sum": t.long_sum(f1, 60),
    "t22_before_sum": t.before_sum(f1, 5),
    "t23_rolling_beta": t.rolling_beta(f1, x.mean(f6), 60, 20),
    "t24_idio_residual": residual,
    "t25_expanding_corr": t.expanding_corr(f1, f3),
    "t26_expanding_std_warm": t.expanding_std(f1),
    "t27_expanding_std_prior": t.expanding_std_prior(f1, 50.0, 10.0, 900.0),
    "t27_expanding_std_gate": t.expanding_std_prior(f1),
    "t28_expanding_std_pooled": t.expanding_std_pooled(f1),
    "t29_semi_asymmetry": SHAPES["semiasym_60"],
    "t30_vol_of_vol": t.vol_of_vol(f1),
    "t31_skew": SHAPES["skew_120"],
    "t32_tail_ratio": SHAPES["tailratio_60"],
    "t33_extreme_frequency": SHAPES["extremefreq_20"],
    "t34_downside_beta": t.downside_beta_gap(f1, f3, 60, 15),
    "t35_drawdown": t.drawdown(price, 20),
    "t35_drawdown_depth": t.drawdown_depth(price, sd60),
    "t36_age_of_high": t.age_of_high(price, 40),
    "t37_accumulation": t.accumulation(price, s.magnitude(f5), 5),
    "t38_synthetic_range": t.rolling_max(price, 5) - t.rolling_min(price, 5),
    "t39_volume_share": t.volume_share(f5),
    "t40_signed_log_flow": t.rolling_sum(c.line, 60),
    "t41_squashed_flow": t.rolling_sum(t.squashed(f5), 5),
    "t42_sign_balance": t.rolling_mean(s.sign(f5), 20),
    "t43_beta_instability": t.beta_instability(f1, x.mean(f6)),
    "t44_autocorrelation": s.tanh(5.0 * t.autocorrelation(_u)) * _u,
    "t45_expanding_deviation": (f6 - t.rolling_mean(f6, None)) / (t.expanding_std(f6) + 1e-12),
    "t46_macd": t.macd(f1, 8, 40),
    "t47_lagged_power_scale": t.lagged_power_scale(f1),
    "t48_trailing_sign": s.sign(t.rolling_sum(f5, 3)),
    "t49_next_sign_lagged": s.fill(t.lag(s.sign(f5), 1)),
    "t49_next_sign_response": s.fill(t.lag(s.sign(t.rolling_sum(f1, 5)) * t.lead(_sign1), 1)),
    "t50_recency_weight": t.recency_weight(50.0) * 1.0,
    "fn_soft_threshold": s.soft_threshold(f1, 2.0),
    "fn_nested_reversal": -x.rank_ordinal(t.ewm_mean(x.residual2(f3, f1, f2), 3)),
    "c_state_fade": state_fade(),
    "c_lagged_reversal": lagged_reversal(),
    "m02_next_rank": t.lead(x.rank_average(f1)),
    "m02_next_rank_residual": x.project_off(t.lead(x.rank_average(f1)), x.rank_average(f1), eps=1e-12),
}


def _signal(node: Node, places: int = PLACES) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = evaluate(lineitem_panel(spark, sf_dir), {"value": node})
        return df.selectExpr("period", "bar", "name_ix", f"round(value, {places}) + 0.0e0 AS value")

    return run


def _signal_sql(node: Node, places: int = PLACES) -> str:
    ctes, last = to_sql("panel", {"value": node})
    return f"WITH {PANEL_SQL},\n" + ",\n".join(ctes) + f"\nSELECT period, bar, name_ix, round(CAST(value AS DOUBLE), {places}) + 0.0e0 AS value FROM {last}"


for _name, _node in SIGNALS.items():
    QUERIES[_name], ORACLE_SQL[_name] = _signal(_node), _signal_sql(_node)
for _name, _node in COMPONENTS.items():
    QUERIES[f"c_{_name}"], ORACLE_SQL[f"c_{_name}"] = _signal(_node, LONG_PLACES), _signal_sql(_node, LONG_PLACES)
for _name, _node in PREDICTORS.items():
    QUERIES[f"p_{_name}"], ORACLE_SQL[f"p_{_name}"] = _signal(_node, LONG_PLACES), _signal_sql(_node, LONG_PLACES)
QUERIES["flagship"], ORACLE_SQL["flagship"] = QUERIES["p_best"], ORACLE_SQL["p_best"]


def _catalogued(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return catalogue.score(lineitem_panel(spark, sf_dir), name, catalogue.SHORT)

    return run


for _name in catalogue.CATALOGUE:
    QUERIES[f"p_{_name}"] = _catalogued(_name)

QUERIES |= pair_queries.QUERIES | source_queries.QUERIES | matrix_queries.QUERIES | wide_queries.QUERIES
ORACLE_SQL |= pair_queries.ORACLE_SQL | source_queries.ORACLE_SQL | matrix_queries.ORACLE_SQL | wide_queries.ORACLE_SQL
