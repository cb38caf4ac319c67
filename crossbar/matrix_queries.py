"""Queries of the matrix operators, learned legs and streams, with DuckDB SQL where it can say the same; the others
are held against plain Python in tests."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import matrix as m
from .plans import catalogue as cat
from .plans import evaluate as ev
from .plans.catalogue import SHORT
from .plans.expr import evaluate, to_sql
from .plans.predictors import PREDICTORS, residual_reversal
from .session import shared_folder
from .sources.panel import PANEL_SQL, PERIOD_BARS, events_panel, lineitem_panel
from .streaming import maps

S = SHORT
_F1 = ("f1",)
_ALL = cat.FIELDS

#: Operator id -> (fields, kernel of one period's arrays).
KERNELS: dict[str, tuple[tuple[str, ...], Callable]] = {
    "x22_cs_resid_minimum_norm": (_ALL, m.residual_leg),
    "g01_var_graph": (_F1, lambda f: m.var_graph(f["f1"], S.windows, 0.10, S.least_pairs)),
    "g02_rank_var": (_ALL, lambda f: cat.graph_leg(f, S, gain_a=0.0)),
    "g02_rank_var_one_bar": (_ALL, lambda f: cat.graph_leg(f, S, gain_a=0.0, label="next")),
    "g07_levy_area": (_F1, lambda f: m.levy_area(f["f1"], S.looks)),
    "g08_rotation_planes": (_F1, lambda f: m.plane_leg(f["f1"], S.train, half_lives=S.half_lives)),
    "g11_granger": (_ALL, lambda f: m.granger_leg(f, S.train, half_lives=S.half_lives)),
    "g13_partial_reversal": (_F1, lambda f: m.partial_reversal(f["f1"], S.graph)),
    "g14_centrality_reversal": (_F1, lambda f: m.centrality_reversal(f["f1"], S.graph)),
    "g18_basket": (_F1, lambda f: cat.basket_leg(f, S)),
    "g19_recursive_map": (_F1, lambda f: m.recursive_map(f["f1"])),
    "g20_factor_var": (_F1, lambda f: m.factor_var(f["f1"], memory=S.memory, refresh=S.refresh, least=S.memory_least)),
    "g21_partial_graph": (_F1, lambda f: m.partial_graph(f["f1"])),
    "g22_quadrant_map": (_F1, lambda f: m.quadrant_map(f["f1"])),
    "g23_ou_score": (_F1, lambda f: m.ou_score(f["f1"], S.graph)),
    "g24_shrunk_risk_map": (_ALL, lambda f: m.risk_map(m.residual_leg(f), f["f1"], 0.5, S.covariance, S.covariance_least)),
    "m13_train_scales": (_ALL, lambda f: cat._two_measured(f, S)),
}


def _kernel(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fields, make = KERNELS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = m.per_period(lineitem_panel(spark, sf_dir), lambda f: {"score": make(f)}, fields)
        return scored.withColumn("score", F.round("score", 6) + F.lit(0.0))

    return run


def m01_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw predictions of the four weighted boosters of the ensemble."""
    panel = lineitem_panel(spark, sf_dir)
    return cat._learn(panel, ("ensemble",), S)


def g27_mean_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean-variance weights of the odd moments, learned from the training bars."""
    basis = evaluate(lineitem_panel(spark, sf_dir), cat._basis_signals(), ("f1",))
    scored = m.per_period(basis, lambda f: {"score": cat._mean_variance(f, S)}, ("f1", *cat.BASIS))
    return scored.withColumn("score", F.round("score", 6) + F.lit(0.0))


TRAIN, STEP = 60, 30


def m12_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio of a predictor in each walk-forward fold."""
    folds = ev.walk_forward(lineitem_panel(spark, sf_dir), TRAIN, STEP).drop("is_train")
    scored = cat.score(folds, "ticket7", S).join(folds.select("period", "bar", "name_ix", "f1"), ["period", "bar", "name_ix"])
    return ev.fold_of(ev.sharpe(ev.profits(scored)))


def m12_signal_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio of a predictor of plain signals, computed anew in each fold."""
    folds = ev.walk_forward(lineitem_panel(spark, sf_dir), TRAIN, STEP)
    scored = evaluate(folds, {"score": PREDICTORS["ind3"]}, ("f1", "is_train")).where("not is_train")
    found = ev.fold_of(ev.sharpe(ev.profits(scored)))
    return found.select("period", "fold", "bars", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("mean", "deviation", "sharpe")])


def e_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio of a predictor over resampled periods."""
    panel = lineitem_panel(spark, sf_dir, period_bars=20)
    scored = panel.withColumn("score", -F.col("f1"))
    return ev.bootstrap(ev.profits(scored)).withColumn("sharpe", F.round("sharpe", 6) + F.lit(0.0))


def _stream(make: Callable[[], object]) -> Callable[[SparkSession, str], DataFrame]:
    """Hourly events replayed as a stream through a stateful score."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = events_panel(spark, sf_dir)
        rows = panel.select("period", "bar", "name_ix", F.col("f1").alias("value"), F.timestamp_seconds(F.col("bar") * 3600).alias("ts"))
        return maps.replay(spark, rows, f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}", make)

    return run


STREAMS: dict[str, Callable[[], object]] = {
    "st_recursive_map": maps.RecursiveMap,
    "st_running_mean": lambda: maps.RunningMean(20.0),
    "st_factor_distance": lambda: maps.FactorDistance(24, 2),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _kernel(n) for n in KERNELS} | {
    f.__name__: f for f in (m01_ensemble, g27_mean_variance, m12_walk_forward, m12_signal_folds, e_bootstrap)
}
QUERIES |= {n: _stream(make) for n, make in STREAMS.items()}


# --- the same in SQL ----------------------------------------------------------------------------------

_ROWS = "row_number() OVER (PARTITION BY period, name_ix ORDER BY bar) - 1"


def _residual_sql() -> str:
    ctes, last = to_sql("panel", {"score": residual_reversal()})
    return f"WITH {PANEL_SQL}, {', '.join(ctes)} SELECT period, bar, name_ix, round(score, 6) + 0.0e0 AS score FROM {last}"


def _levy_sql() -> str:
    """Areas from windows of products with the running path: where a path starts cancels out."""
    looks, top, momentum = S.looks, 5, 22
    moment = lambda a, b, w: f"(sum({a} * {b}) OVER w{w} - sum({a}) OVER w{w} * sum({b}) OVER w{w} / {w})"
    area = " + ".join(f"({moment('ci', 'xj', w)} - {moment('cj', 'xi', w)}) / 2" for w in looks)
    windows = ", ".join(f"w{w} AS (PARTITION BY period, i, j ORDER BY bar ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in looks)
    return f"""WITH {PANEL_SQL},
p AS (SELECT period, bar, name_ix, coalesce(f1, 0) AS x, sum(coalesce(f1, 0)) OVER (PARTITION BY period, name_ix ORDER BY bar) AS c, {_ROWS} AS t FROM panel),
q AS (SELECT a.period, a.bar, a.t, a.name_ix AS i, b.name_ix AS j, a.c AS ci, a.x AS xi, b.c AS cj, b.x AS xj FROM p a JOIN p b USING (period, bar)),
w AS (SELECT period, bar, t, i, j, ({area}) / {len(looks)} AS a FROM q WINDOW {windows}),
k AS (SELECT period, bar, t, j AS name_ix, i AS other, a, row_number() OVER (PARTITION BY period, bar, j ORDER BY abs(a) DESC, i) AS n FROM w),
m AS (SELECT period, bar, name_ix AS other, sum(x) OVER (PARTITION BY period, name_ix ORDER BY bar ROWS BETWEEN {momentum} PRECEDING AND 1 PRECEDING) AS m FROM p)
SELECT period, bar, name_ix, round(CASE WHEN t < {max(looks)} THEN 0.0e0 ELSE sum(a * m) / (sum(abs(a)) + 1e-12) END, 6) + 0.0e0 AS score
FROM k JOIN m USING (period, bar, other) WHERE n <= {top} GROUP BY period, bar, t, name_ix"""


def _granger_sql() -> str:
    rank = lambda f: f"(row_number() OVER (PARTITION BY period, bar ORDER BY coalesce({f}, 0), name_ix) - 1) / (count(*) OVER (PARTITION BY period, bar) - 1.0e0) - 0.5e0"
    sources = " UNION ALL ".join(f"SELECT period, bar, name_ix, t, u, '{f}' AS c, v{f} AS v FROM r" for f in ("f2", "f3", "f4"))
    return f"""WITH {PANEL_SQL},
r AS (SELECT period, bar, name_ix, {_ROWS} AS t, {rank("f1")} AS u, {", ".join(f"{rank(f)} AS v{f}" for f in ("f2", "f3", "f4"))} FROM panel),
s AS ({sources}),
l AS (SELECT *, lag(v) OVER (PARTITION BY period, name_ix, c ORDER BY bar) AS v0 FROM s),
h AS (SELECT * FROM (VALUES {", ".join(f"({x:e})" for x in S.half_lives)}) AS v(h)),
g AS (SELECT a.period, a.c, h, a.name_ix AS i, b.name_ix AS j, sum(power(0.5e0, ({S.train - 1} - a.t) / h) * a.u * b.v0) AS g
      FROM l a JOIN l b USING (period, bar, c), h WHERE a.t BETWEEN 1 AND {S.train - 1} AND a.name_ix <> b.name_ix GROUP BY ALL),
o AS (SELECT l.period, l.bar, g.c, g.h, g.i AS name_ix, sum(g.g * l.v) AS s FROM g JOIN l ON (g.period, g.c, g.j) = (l.period, l.c, l.name_ix) GROUP BY ALL),
z AS (SELECT period, bar, name_ix, (s - avg(s) OVER w) / greatest(stddev_pop(s) OVER w, 1e-12) AS z FROM o WINDOW w AS (PARTITION BY period, bar, c, h))
SELECT period, bar, name_ix, round(sum(greatest(least(z, 3), -3)), 6) + 0.0e0 AS score FROM z GROUP BY ALL"""


def _quadrant_sql() -> str:
    return f"""WITH {PANEL_SQL},
c AS (SELECT period, bar, name_ix, {_ROWS} AS t, coalesce(f1, 0) - avg(coalesce(f1, 0)) OVER (PARTITION BY period, bar) AS c FROM panel),
m AS (SELECT period, bar, name_ix, t, CASE WHEN t > 0 THEN sign(c) ELSE 0 END AS o, unnest([1, 5]) AS m,
             unnest([sign(c), sign(sum(c) OVER (PARTITION BY period, name_ix ORDER BY bar ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))]) AS k FROM c),
l AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY period, name_ix, m ORDER BY bar), 0) AS k0 FROM m),
d AS (SELECT power(0.5e0, 1 / h) AS d FROM (VALUES (250.0e0), (2500.0e0)) AS v(h)),
q AS (SELECT a.period, a.bar, a.t, m, a.name_ix AS i, b.name_ix AS j, a.o * b.k0 AS x, b.k FROM l a JOIN l b USING (period, bar, m)),
g AS (SELECT *, sum(x * power(d, -t)) OVER (PARTITION BY period, m, d, i, j ORDER BY bar) * power(d, t) * (1 - d) AS g FROM q, d),
z AS (SELECT *, sqrt(sum(g * g) OVER (PARTITION BY period, bar, m, d)) AS size FROM g),
s AS (SELECT period, bar, i AS name_ix, sum(CASE WHEN size > 0 THEN g / size * k ELSE 0 END) AS s FROM z GROUP BY ALL)
SELECT period, bar, name_ix, round(s - avg(s) OVER (PARTITION BY period, bar), 6) + 0.0e0 AS score FROM s"""


def _bootstrap_sql() -> str:
    panel = PANEL_SQL.replace(f"bar / {PERIOD_BARS}.0", "bar / 20.0")
    return f"""WITH {panel},
h AS (SELECT period, bar, coalesce(lag(-f1) OVER (PARTITION BY period, name_ix ORDER BY bar), 0) * coalesce(f1, 0) AS x FROM panel),
p AS (SELECT period, bar, sum(x) AS profit FROM h GROUP BY ALL),
s AS (SELECT period, avg(profit) / nullif(stddev_pop(profit), 0) AS sharpe FROM p GROUP BY ALL),
u AS (SELECT *, (CAST('0x' || substr(md5(period || ':' || round), 1, 8) AS BIGINT) + 0.5e0) / 4294967296.0 AS u
      FROM s, (SELECT CAST(unnest(range(200)) AS INTEGER) AS round)),
n AS (SELECT round, sharpe, CAST(u > 0.367879 AS INTEGER) + CAST(u > 0.735759 AS INTEGER) + CAST(u > 0.919699 AS INTEGER) + CAST(u > 0.981012 AS INTEGER) AS n FROM u)
SELECT round, round(sum(sharpe * n) / nullif(sum(n), 0), 6) + 0.0e0 AS sharpe FROM n GROUP BY ALL"""


def _folds_sql() -> str:
    ctes, last = to_sql("folds", {"score": PREDICTORS["ind3"]}, ("f1", "training"))
    return f"""WITH {PANEL_SQL.replace("panel AS (", "whole AS (")},
z AS (SELECT *, bar - min(bar) OVER w AS k, max(bar) OVER w - min(bar) OVER w AS most FROM whole WINDOW w AS (PARTITION BY period)),
folds AS (SELECT period * {ev.FOLDS} + fold AS period, bar, name_ix, f1, f2, f3, f4, f5, f6, target, k < {TRAIN} + {STEP} * fold AS training
          FROM z, range(0, 100) t(fold) WHERE k >= {STEP} * fold AND k < {TRAIN} + {STEP} * (fold + 1) AND {TRAIN} + {STEP} * fold <= most),
{", ".join(ctes)},
s AS (SELECT * FROM {last} WHERE NOT training),
h AS (SELECT *, coalesce(lag(score) OVER (PARTITION BY period, name_ix ORDER BY bar), 0) AS held FROM s),
p AS (SELECT period, bar, sum(held * coalesce(f1, 0)) AS profit FROM h GROUP BY ALL),
g AS (SELECT period, count(*) AS bars, avg(profit) AS mean, stddev_pop(profit) AS deviation FROM p GROUP BY period)
SELECT CAST(period // {ev.FOLDS} AS INTEGER) AS period, CAST(period % {ev.FOLDS} AS INTEGER) AS fold, bars, round(mean, 5) + 0.0e0 AS mean, round(deviation, 5) + 0.0e0 AS deviation,
       round(mean / nullif(deviation, 0), 5) + 0.0e0 AS sharpe FROM g"""


ORACLE_SQL: dict[str, str] = {
    "m12_signal_folds": _folds_sql(),
    "x22_cs_resid_minimum_norm": _residual_sql(),
    "g07_levy_area": _levy_sql(),
    "g11_granger": _granger_sql(),
    "g22_quadrant_map": _quadrant_sql(),
    "e_bootstrap": _bootstrap_sql(),
}
