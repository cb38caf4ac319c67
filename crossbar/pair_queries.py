"""Queries over pairs of names and over scores, with the same as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import snap
from .operators import cross as x
from .operators import pairs as p
from .operators import series as t
from .plans import evaluate as ev
from .plans.components import COMPONENTS, f1
from .plans.expr import evaluate, field, to_sql
from .plans.predictors import PREDICTORS, standardised_return
from .sources.panel import NAMES, PANEL_SQL, lineitem_panel

BARS, WARM, LEAST = 40, 30, 30
_Z = x.zscore(f1)
_U = standardised_return()


def _base(spark: SparkSession, sf_dir: str, node, name: str = "u") -> DataFrame:
    return evaluate(lineitem_panel(spark, sf_dir), {name: node}, ("f1",))


def _sql(node, name: str = "u") -> str:
    """WITH clause up to ``b`` (period, bar, name_ix, f1, node)."""
    ctes, last = to_sql("panel", {name: node}, ("f1",))
    return f"WITH {PANEL_SQL},\n" + ",\n".join(ctes) + f",\nb AS (SELECT * FROM {last})"


def _round(df: DataFrame, *values: str, places: int = 6) -> DataFrame:
    keys = [c for c in df.columns if c not in values]
    return df.select(*keys, *[(F.round(v, places) + F.lit(0.0)).alias(v) for v in values])


# long pairs of the bar before with this bar, and their sums over the last rows
_LAGGED = """
l AS (SELECT period, bar, name_ix, u, lag(u) OVER (PARTITION BY period, name_ix ORDER BY bar) AS u0 FROM b),
q AS (SELECT a.period, a.bar, a.name_ix AS i, c.name_ix AS j, coalesce(a.u0, NULL) * coalesce(c.u, 0) AS x
      FROM l a JOIN l c USING (period, bar) WHERE a.u0 IS NOT NULL)"""
_SAME = """
q AS (SELECT a.period, a.bar, a.name_ix AS i, c.name_ix AS j, coalesce(a.u, 0) * coalesce(c.u, 0) AS x
      FROM b a JOIN b c USING (period, bar))"""
_CORR = (
    _SAME
    + f""",
m AS (SELECT *, sum(x) OVER w AS m, count(x) OVER w AS n FROM q
      WINDOW w AS (PARTITION BY period, i, j ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT period, bar, i AS k, m AS d FROM m WHERE i = j),
c AS (SELECT m.period, m.bar, m.i, m.j, CASE WHEN m.n > {WARM} THEN m.m / (sqrt(d1.d * d2.d) + 1e-9) END AS c
      FROM m JOIN d d1 ON (m.period, m.bar, m.i) = (d1.period, d1.bar, d1.k)
             JOIN d d2 ON (m.period, m.bar, m.j) = (d2.period, d2.bar, d2.k) WHERE m.i <> m.j)"""
)
_WEIGHTS = f"""
w AS (SELECT period, bar, i, j,
             CASE WHEN sum(greatest(coalesce(c, 0), 0)) OVER r > 1e-9
                  THEN greatest(coalesce(c, 0), 0) / (sum(greatest(coalesce(c, 0), 0)) OVER r + 1e-9)
                  ELSE 1.0 / {NAMES - 1} END AS w
      FROM c WINDOW r AS (PARTITION BY period, bar, i))"""
_TRAILING = f"""
q AS (SELECT a.period, a.bar, a.name_ix AS i, c.name_ix AS j, coalesce(a.u, 0) AS l, coalesce(c.u, 0) AS r
      FROM b a JOIN b c USING (period, bar) WHERE a.name_ix <> c.name_ix),
c AS (SELECT period, bar, i, j,
             CASE WHEN count(l) OVER w = {BARS}
                  THEN coalesce(CASE WHEN isnan(corr(l, r) OVER w) THEN 0 ELSE corr(l, r) OVER w END, 0) END AS c
      FROM q WINDOW w AS (PARTITION BY period, i, j ORDER BY bar ROWS BETWEEN {BARS} PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, row_number() OVER (PARTITION BY period, bar, i ORDER BY abs(a) DESC, j) AS n
      FROM (SELECT period, bar, i, j, abs(c) AS a FROM c WHERE c IS NOT NULL)),
w AS (SELECT period, bar, i, j, a / (sum(abs(a)) OVER (PARTITION BY period, bar, i) + 1e-12) AS w FROM k WHERE n <= 5)"""


def g01_lag_cross_moment(spark, sf_dir):
    m = p.moments(p.pairs(_base(spark, sf_dir, _Z), "u", lagged=True), BARS)
    return _round(m.where(F.col("n") >= LEAST).select("period", "bar", "i", "j", "m"), "m")


_g01 = f"""{_sql(_Z)}, {_LAGGED}
SELECT period, bar, i, j, round(m, 6) + 0.0e0 AS m FROM (
    SELECT period, bar, i, j, sum(x) OVER w AS m, count(x) OVER w AS n FROM q
    WINDOW w AS (PARTITION BY period, i, j ORDER BY bar ROWS BETWEEN {BARS - 1} PRECEDING AND CURRENT ROW)) WHERE n >= {LEAST}"""


def g03_adjacency(spark, sf_dir):
    return _round(p.adjacency_score(_base(spark, sf_dir, _U), "u", WARM), "score")


_g03 = f"""{_sql(_U)}, {_LAGGED},
m AS (SELECT period, bar, i, j, sum(x) OVER w AS m, count(x) OVER w AS n FROM q
      WINDOW w AS (PARTITION BY period, i, j ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT m.period, m.bar, m.j AS name_ix, sum(m.m / m.n * coalesce(b.u, 0)) AS score
      FROM m JOIN b ON (m.period, m.bar, m.i) = (b.period, b.bar, b.name_ix) WHERE m.i <> m.j AND m.n >= {WARM} GROUP BY ALL)
SELECT b.period, b.bar, b.name_ix, round(coalesce(score, 0), 6) + 0.0e0 AS score FROM b LEFT JOIN s USING (period, bar, name_ix)"""


def g04_pair_correlation(spark, sf_dir):
    return _round(p.expanding_correlation(_base(spark, sf_dir, _Z), "u", WARM), "c")


_g04 = f"{_sql(_Z)}, {_CORR}\nSELECT period, bar, i, j, round(c, 6) + 0.0e0 AS c FROM c"


def g04_positive_weights(spark, sf_dir):
    return _round(p.positive_weights(p.expanding_correlation(_base(spark, sf_dir, _Z), "u", WARM), NAMES), "w")


_g04w = f"{_sql(_Z)}, {_CORR}, {_WEIGHTS}\nSELECT period, bar, i, j, round(w, 6) + 0.0e0 AS w FROM w"


def g04_top3_weights(spark, sf_dir):
    return _round(p.top_weights(p.expanding_correlation(_base(spark, sf_dir, _Z), "u", WARM), 3), "w")


_g04t = f"""{_sql(_Z)}, {_CORR}
SELECT period, bar, i, j, round(1.0e0 / 3, 6) AS w FROM (
    SELECT *, row_number() OVER (PARTITION BY period, bar, i ORDER BY c DESC NULLS LAST, j) AS n FROM c WHERE c IS NOT NULL) WHERE n <= 3"""


def g05_relative_fade(spark, sf_dir):
    """Distance from the correlated neighbours' weighted mean, ranked and turned round."""
    base = _base(spark, sf_dir, _Z)
    mean = p.propagate(p.positive_weights(p.expanding_correlation(base, "u", WARM), NAMES), base, "u").withColumnRenamed("score", "near")
    both = base.join(mean, ["period", "bar", "name_ix"]).withColumn("gap", F.col("u") - F.col("near"))
    return _round(evaluate(both, {"score": -x.rank_ordinal(snap(field("gap")))}), "score")


_g05 = f"""{_sql(_Z)}, {_CORR}, {_WEIGHTS},
n AS (SELECT w.period, w.bar, w.i AS name_ix, sum(w.w * coalesce(b.u, 0)) AS near
      FROM w JOIN b ON (w.period, w.bar, w.j) = (b.period, b.bar, b.name_ix) GROUP BY ALL),
g AS (SELECT b.period, b.bar, b.name_ix, row_number() OVER (PARTITION BY b.period, b.bar ORDER BY round(b.u - n.near, 9) NULLS LAST, b.name_ix) AS r,
             count(*) OVER (PARTITION BY b.period, b.bar) AS j FROM b JOIN n USING (period, bar, name_ix))
SELECT period, bar, name_ix, round(-((r - (j + 1) / 2.0e0) / ((j - 1) / 2.0e0)), 6) + 0.0e0 AS score FROM g"""

_GAP = t.rolling_sum(_Z, 10) / (t.expanding_std_prior(t.rolling_sum(_Z, 10), least=20) + 1e-9)


def g06_gap_z(spark, sf_dir):
    return _round(_base(spark, sf_dir, _GAP).drop("f1"), "u")


_g06 = f"{_sql(_GAP)} SELECT period, bar, name_ix, round(u, 6) + 0.0e0 AS u FROM b"


def _trailing_weights(spark, sf_dir):
    base = _base(spark, sf_dir, _Z)
    c = p.trailing_correlation(base, "u", BARS).where("c is not null").withColumn("a", F.abs("c"))
    return base, p.top_magnitude(c, 5)


def g12_correlation_reversal(spark, sf_dir):
    base, w = _trailing_weights(spark, sf_dir)
    before = base.withColumn("u", F.lag("u").over(ev.history_rows()))
    return _round(p.propagate(w, before, -F.col("u")), "score")


_BEFORE = "l AS (SELECT period, bar, name_ix, lag(u) OVER (PARTITION BY period, name_ix ORDER BY bar) AS u0 FROM b)"
_g12 = f"""{_sql(_Z)}, {_BEFORE}, {_TRAILING}
SELECT w.period, w.bar, w.i AS name_ix, round(sum(w.w * coalesce(-l.u0, 0)), 6) + 0.0e0 AS score
FROM w JOIN l ON (w.period, w.bar, w.j) = (l.period, l.bar, l.name_ix) GROUP BY ALL"""


def g15_flow_imbalance(spark, sf_dir):
    m = p.moments(p.pairs(_base(spark, sf_dir, _Z), "u", lagged=True), BARS).where(F.col("n") >= LEAST)
    return _round(p.flow_imbalance(m), "score")


_g15 = f"""{_sql(_Z)}, {_LAGGED},
m AS (SELECT * FROM (SELECT period, bar, i, j, sum(x) OVER w AS m, count(x) OVER w AS n FROM q
      WINDOW w AS (PARTITION BY period, i, j ORDER BY bar ROWS BETWEEN {BARS - 1} PRECEDING AND CURRENT ROW)) WHERE n >= {LEAST}),
e AS (SELECT period, bar, i AS name_ix, abs(m) AS s FROM m UNION ALL SELECT period, bar, j, -abs(m) FROM m)
SELECT period, bar, name_ix, round(sum(s), 6) + 0.0e0 AS score FROM e GROUP BY ALL"""


def g16_second_order(spark, sf_dir):
    base, w = _trailing_weights(spark, sf_dir)
    return _round(p.propagate(p.second_order(w), base, "u"), "score")


_g16 = f"""{_sql(_Z)}, {_TRAILING},
z AS (SELECT a.period, a.bar, a.i, c.j, sum(a.w * c.w) AS w
      FROM w a JOIN w c ON (a.period, a.bar, a.j) = (c.period, c.bar, c.i) WHERE a.i <> c.j GROUP BY ALL)
SELECT z.period, z.bar, z.i AS name_ix, round(sum(z.w * coalesce(b.u, 0)), 6) + 0.0e0 AS score
FROM z JOIN b ON (z.period, z.bar, z.j) = (b.period, b.bar, b.name_ix) GROUP BY ALL"""


def g17_topk_row(spark, sf_dir):
    return _round(_trailing_weights(spark, sf_dir)[1], "w")


_g17 = f"{_sql(_Z)}, {_TRAILING}\nSELECT period, bar, i, j, round(w, 6) + 0.0e0 AS w FROM w"


def g28_sufficient_statistics(spark, sf_dir):
    return _round(p.sufficient_statistics(_base(spark, sf_dir, x.demean(f1)), "u", 50), "n", "s1", "s2", places=5)


_g28 = f"""{_sql(x.demean(f1))}, s AS (SELECT period, name_ix, CAST(count(u) AS DOUBLE) AS n, sum(u) AS s1, sum(u * u) AS s2 FROM b GROUP BY ALL)
SELECT period, name_ix, round(n * least(1.0e0, 50 / n), 5) + 0.0e0 AS n, round(s1 * least(1.0e0, 50 / n), 5) + 0.0e0 AS s1, round(s2 * least(1.0e0, 50 / n), 5) + 0.0e0 AS s2 FROM s"""

# --- scores -------------------------------------------------------------------------------------------

_BEST, _REV = PREDICTORS["best"], COMPONENTS["rev_f3"]
_PROFIT = """
h AS (SELECT period, bar, coalesce(lag(u) OVER (PARTITION BY period, name_ix ORDER BY bar), 0) * coalesce(f1, 0) AS x FROM b),
pf AS (SELECT period, bar, sum(x) AS profit FROM h GROUP BY ALL)"""


def e_profit(spark, sf_dir):
    return _round(ev.profits(_base(spark, sf_dir, _REV), "u"), "profit")


_e_profit = f"{_sql(_REV)}, {_PROFIT} SELECT period, bar, round(profit, 6) + 0.0e0 AS profit FROM pf"


def e_profit_sharpe(spark, sf_dir):
    return _round(ev.sharpe(ev.profits(_base(spark, sf_dir, _BEST), "u")), "mean", "deviation", "sharpe", places=4)


_e_sharpe = f"""{_sql(_BEST)}, {_PROFIT}, s AS (SELECT period, count(*) AS bars, avg(profit) AS mean, stddev_pop(profit) AS deviation FROM pf GROUP BY ALL)
SELECT period, bars, round(mean, 4) + 0.0e0 AS mean, round(deviation, 4) + 0.0e0 AS deviation, round(mean / nullif(deviation, 0), 4) + 0.0e0 AS sharpe FROM s"""


def e_information(spark, sf_dir):
    return _round(ev.information(_base(spark, sf_dir, _REV), "u"), "ic")


_e_ic = f"""{_sql(_REV)},
h AS (SELECT *, lead(f1) OVER (PARTITION BY period, name_ix ORDER BY bar) AS ahead FROM b),
c AS (SELECT period, bar, corr(u, ahead) AS c FROM h WHERE ahead IS NOT NULL GROUP BY ALL)
SELECT period, round(avg(coalesce(CASE WHEN isnan(c) THEN 0 ELSE c END, 0)), 6) + 0.0e0 AS ic FROM c GROUP BY ALL"""


def e_profit_correlation(spark, sf_dir):
    df = evaluate(lineitem_panel(spark, sf_dir), {"u": _REV, "v": COMPONENTS["rev_convex"]}, ("f1",))
    return _round(ev.profit_correlation(ev.profits(df, "u"), ev.profits(df, "v")), "c")


def _correlation_sql() -> str:
    ctes, last = to_sql("panel", {"u": _REV, "v": COMPONENTS["rev_convex"]}, ("f1",))
    return f"""WITH {PANEL_SQL}, {", ".join(ctes)},
h AS (SELECT period, bar, coalesce(lag(u) OVER w, 0) * f1 AS p, coalesce(lag(v) OVER w, 0) * f1 AS q FROM {last} WINDOW w AS (PARTITION BY period, name_ix ORDER BY bar)),
s AS (SELECT period, bar, sum(p) AS p, sum(q) AS q FROM h GROUP BY ALL)
SELECT period, round(corr(p, q), 6) + 0.0e0 AS c FROM s GROUP BY ALL"""


def e_concentration(spark, sf_dir):
    return _round(ev.concentration(ev.profits(_base(spark, sf_dir, _REV), "u")), "share")


_e_conc = f"{_sql(_REV)}, {_PROFIT} SELECT period, round(max(profit * profit) / sum(profit * profit), 6) + 0.0e0 AS share FROM pf GROUP BY ALL"


def x35_mean_dispersion(spark, sf_dir):
    return _round(ev.mean_dispersion(_base(spark, sf_dir, f1).withColumnRenamed("u", "score")), "scale")


_x35 = f"{_sql(f1)}, d AS (SELECT period, bar, stddev_pop(u) AS d FROM b GROUP BY ALL) SELECT period, round(avg(d), 6) + 0.0e0 AS scale FROM d GROUP BY ALL"


def m14_median_dispersion(spark, sf_dir):
    return _round(ev.median_dispersion(_base(spark, sf_dir, f1).withColumnRenamed("u", "score"), 0.6), "scale")


_m14 = f"{_sql(f1)}, d AS (SELECT period, bar, stddev_pop(u) AS d FROM b GROUP BY ALL) SELECT period, round(0.5e0 * median(d) + 0.5e0 * 0.6e0, 6) + 0.0e0 AS scale FROM d WHERE d > 1e-12 GROUP BY ALL"


def b_equal_risk(spark, sf_dir):
    """Three components over the risk of their profits in the first 60 bars of each period."""
    names = ("rev_f3", "rev_convex", "f4_minus_f1")
    panel = lineitem_panel(spark, sf_dir)
    df = evaluate(panel, {n: COMPONENTS[n] for n in names})
    legs = {n: df.select("period", "bar", "name_ix", F.col(n).alias("score")) for n in names}
    return _round(ev.equal_risk(legs, panel, 0, 60), "score", places=4)


def _equal_risk_sql() -> str:
    names = ("rev_f3", "rev_convex", "f4_minus_f1")
    ctes, last = to_sql("panel", {n: COMPONENTS[n] for n in names}, ("f1",))
    held = ", ".join(f"sum(coalesce({n}_0, 0) * f1) AS {n}" for n in names)
    lags = ", ".join(f"lag({n}) OVER w AS {n}_0" for n in names)
    risk = ", ".join(f"stddev_pop({n}) AS {n}" for n in names)
    total = " + ".join(f"coalesce(b.{n} / nullif(r.{n}, 0), 0)" for n in names)
    return f"""WITH {PANEL_SQL}, {", ".join(ctes)}, b AS (SELECT * FROM {last}),
h AS (SELECT period, bar, f1, bar - min(bar) OVER (PARTITION BY period) AS k, {lags} FROM b WINDOW w AS (PARTITION BY period, name_ix ORDER BY bar)),
s AS (SELECT period, k, {held} FROM h GROUP BY ALL),
r AS (SELECT period, {risk} FROM s WHERE k < 60 GROUP BY ALL),
z AS (SELECT b.period, b.bar, b.name_ix, {total} AS v FROM b JOIN r USING (period))
SELECT period, bar, name_ix, round(v - avg(v) OVER (PARTITION BY period, bar), 4) + 0.0e0 AS score FROM z"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        g01_lag_cross_moment, g03_adjacency, g04_pair_correlation, g04_positive_weights, g04_top3_weights, g05_relative_fade, g06_gap_z,
        g12_correlation_reversal, g15_flow_imbalance, g16_second_order, g17_topk_row, g28_sufficient_statistics, e_profit, e_profit_sharpe,
        e_information, e_profit_correlation, e_concentration, x35_mean_dispersion, m14_median_dispersion, b_equal_risk,
    )
}
ORACLE_SQL: dict[str, str] = {
    "g01_lag_cross_moment": _g01,
    "g03_adjacency": _g03,
    "g04_pair_correlation": _g04,
    "g04_positive_weights": _g04w,
    "g04_top3_weights": _g04t,
    "g05_relative_fade": _g05,
    "g06_gap_z": _g06,
    "g12_correlation_reversal": _g12,
    "g15_flow_imbalance": _g15,
    "g16_second_order": _g16,
    "g17_topk_row": _g17,
    "g28_sufficient_statistics": _g28,
    "e_profit": _e_profit,
    "e_profit_sharpe": _e_sharpe,
    "e_information": _e_ic,
    "e_profit_correlation": _correlation_sql(),
    "e_concentration": _e_conc,
    "x35_mean_dispersion": _x35,
    "m14_median_dispersion": _m14,
    "b_equal_risk": _equal_risk_sql(),
}
