"""Queries of sources, state alignment, joins, aggregates and top-k, with the same as DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import pairs as p
from .session import shared_folder
from .sources.panel import NAMES, PANEL_SQL, field_rows, lineitem_panel, name_index, native_order, read_wide, result_frame, split_features, wide_table, zero_fill

TRAIN, TAIL = 60, 20


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with ``at``, the number of a bar in its period."""
    panel = lineitem_panel(spark, sf_dir)
    return panel.withColumn("at", F.col("bar") - F.min("bar").over(Window.partitionBy("period")))


_PLACED = f"{PANEL_SQL},\nz AS (SELECT *, bar - min(bar) OVER (PARTITION BY period) AS k FROM panel)"


def _r(column, places: int = 6):
    return F.round(column, places) + F.lit(0.0)


def s01_feature_slice(spark, sf_dir):
    panel = lineitem_panel(spark, sf_dir)
    return panel.select("period", "bar", "name", "name_ix", *[_r(zero_fill(F.col(f"f{k}")), 8).alias(f"f{k}") for k in range(1, 7)])


_s01 = f"WITH {PANEL_SQL} SELECT period, bar, name, name_ix, " + ", ".join(f"round(coalesce(f{k}, 0), 8) + 0.0e0 AS f{k}" for k in range(1, 7)) + " FROM panel"


def s03_wide_source(spark, sf_dir):
    """The panel written as a wide table and read back: features of all names stacked."""
    wide = wide_table(lineitem_panel(spark, sf_dir), [f"X.{n}" for n in range(NAMES)])
    path = f"{shared_folder(spark)}/wide-{uuid.uuid4().hex}"
    wide.write.parquet(path)
    panel = read_wide(spark.read.parquet(path), period="period")
    present = lineitem_panel(spark, sf_dir).select("name").distinct()
    return panel.join(F.broadcast(present), "name", "left_semi").select("period", "bar", "name", "name_ix", *[_r(zero_fill(F.col(f"f{k}")), 8).alias(f"f{k}") for k in range(1, 7)])


def s02_names(spark, sf_dir):
    """Names in the order of their integer suffix."""
    names = lineitem_panel(spark, sf_dir).where("f1 is not null").select("name").distinct()
    ranked = names.withColumn("name_ix", name_index(F.col("name")))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("name_ix")))


_s02 = f"""WITH {PANEL_SQL}, n AS (SELECT DISTINCT name FROM panel WHERE f1 IS NOT NULL)
SELECT name, CAST(split_part(name, '.', 2) AS INTEGER) AS name_ix, CAST(row_number() OVER (ORDER BY CAST(split_part(name, '.', 2) AS INTEGER)) AS INTEGER) AS place FROM n"""


def s02d_native_order(spark, sf_dir):
    """Names numbered by the order in which they first come in the table."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return native_order(rows.select(F.concat(F.lit("X."), (F.col("l_suppkey") % NAMES).cast("string")).alias("name"), "l_orderkey"), "name", "l_orderkey")


_s02d = f"""WITH n AS (SELECT 'X.' || (l_suppkey % {NAMES}) AS name, min(l_orderkey) AS first FROM lineitem GROUP BY ALL)
SELECT name, CAST(row_number() OVER (ORDER BY first, name) - 1 AS INTEGER) AS name_ix FROM n"""


def s05_split_features(spark, sf_dir):
    return split_features(lineitem_panel(spark, sf_dir)).withColumn("value", _r("value"))


_s05 = f"WITH {PANEL_SQL} " + " UNION ALL ".join(f"SELECT period, bar, name_ix, {k} AS feature, round(f{k}, 6) + 0.0e0 AS value FROM panel" for k in range(1, 7))


def s06_clean(spark, sf_dir):
    """NaN, infinities and nulls of a feature as zero."""
    odd = F.when(F.col("name_ix") % 4 == 0, F.lit(float("nan"))).when(F.col("name_ix") % 4 == 1, F.lit(float("inf"))).when(F.col("name_ix") % 4 == 2, F.lit(float("-inf")))
    panel = lineitem_panel(spark, sf_dir).withColumn("f2", F.when(F.col("bar") % 2 == 0, odd).otherwise(F.col("f2")))
    return panel.select("period", "bar", "name_ix", _r(zero_fill(F.col("f2"))).alias("value"))


_s06 = f"""WITH {PANEL_SQL}, o AS (SELECT period, bar, name_ix, CASE WHEN bar % 2 <> 0 THEN f2 WHEN name_ix % 4 = 0 THEN CAST('NaN' AS DOUBLE)
    WHEN name_ix % 4 = 1 THEN CAST('Infinity' AS DOUBLE) WHEN name_ix % 4 = 2 THEN CAST('-Infinity' AS DOUBLE) END AS v FROM panel)
SELECT period, bar, name_ix, CASE WHEN isfinite(v) THEN round(v, 6) + 0.0e0 ELSE 0.0e0 END AS value FROM o"""


def s10_field_rows(spark, sf_dir):
    """One field as a row of values a bar, and the place of each value in it."""
    rows = field_rows(lineitem_panel(spark, sf_dir), "f3")
    return rows.select("period", "bar", F.posexplode("row").alias("place", "value")).withColumn("value", _r("value"))


_s10 = f"""WITH {PANEL_SQL} SELECT period, bar, CAST(row_number() OVER (PARTITION BY period, bar ORDER BY name_ix) - 1 AS INTEGER) AS place,
round(coalesce(f3, 0), 6) + 0.0e0 AS value FROM panel"""


def s12_result_frame(spark, sf_dir):
    """De-meaned scores as one column a name."""
    panel = lineitem_panel(spark, sf_dir)
    score = F.col("f4") - F.avg("f4").over(Window.partitionBy("period", "bar"))
    return result_frame(panel.withColumn("score", _r(score)), list(range(NAMES)))


_s12 = f"""WITH {PANEL_SQL}, s AS (SELECT period, bar, name_ix, round(f4 - avg(f4) OVER (PARTITION BY period, bar), 6) + 0.0e0 AS score FROM panel)
SELECT period, bar, {", ".join(f"coalesce(max(score) FILTER (name_ix = {n}), 0.0e0) AS n{n}" for n in range(NAMES))} FROM s GROUP BY ALL"""


def s07_warm_up_union(spark, sf_dir):
    """Scored bars with the last training bars before them, so that their windows are full; only the former
    are returned."""
    placed = _placed(spark, sf_dir)
    warm = placed.where((F.col("at") >= TRAIN - TAIL) & (F.col("at") < TRAIN)).withColumn("scored", F.lit(False))
    both = warm.unionByName(placed.where(F.col("at") >= TRAIN).withColumn("scored", F.lit(True)))
    mean = F.avg("f1").over(Window.partitionBy("period", "name_ix").orderBy("bar").rowsBetween(-9, 0))
    return both.withColumn("value", _r(mean)).where("scored").select("period", "bar", "name_ix", "value")


_s07 = f"""WITH {_PLACED}, w AS (SELECT *, avg(f1) OVER (PARTITION BY period, name_ix ORDER BY bar ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS v FROM z WHERE k >= {TRAIN - TAIL})
SELECT period, bar, name_ix, round(v, 6) + 0.0e0 AS value FROM w WHERE k >= {TRAIN}"""


def s08_tail(spark, sf_dir):
    """The last bars of the training part of each period."""
    train = _placed(spark, sf_dir).where(F.col("at") < TRAIN)
    bars = train.select("period", "bar").distinct()
    last = bars.withColumn("back", F.row_number().over(Window.partitionBy("period").orderBy(F.desc("bar")))).where(F.col("back") <= TAIL)
    return train.join(last, ["period", "bar"]).select("period", "bar", "name_ix", _r("f1").alias("f1"))


_s08 = f"""WITH {_PLACED}, d AS (SELECT DISTINCT period, bar FROM z WHERE k < {TRAIN}),
t AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY bar DESC) AS n FROM d)
SELECT z.period, z.bar, z.name_ix, round(f1, 6) + 0.0e0 AS f1 FROM z JOIN t USING (period, bar) WHERE n <= {TAIL}"""


def s09_align_state(spark, sf_dir):
    """State of training rows (mean of f1 by name) put beside later rows by name; none if any name lacks."""
    placed = _placed(spark, sf_dir)
    state = placed.where(F.col("at") < TRAIN).groupBy("period", "name").agg(F.avg("f1").alias("level"))
    block = placed.where(F.col("at") >= TRAIN)
    names = block.select("period", "name").distinct()
    lost = names.join(state, ["period", "name"], "left_anti").select("period").distinct().withColumn("lost", F.lit(True))
    joined = block.join(state, ["period", "name"], "left").join(lost, "period", "left")
    level = F.when(F.col("lost").isNull(), F.col("level")).otherwise(F.lit(0.0))
    return joined.select("period", "bar", "name_ix", _r(F.col("f1") - level).alias("value"))


_s09 = f"""WITH {_PLACED}, s AS (SELECT period, name, avg(f1) AS level FROM z WHERE k < {TRAIN} GROUP BY ALL),
l AS (SELECT DISTINCT period FROM z WHERE k >= {TRAIN} AND (period, name) NOT IN (SELECT (period, name) FROM s))
SELECT z.period, bar, name_ix, round(f1 - CASE WHEN l.period IS NULL THEN level ELSE 0 END, 6) + 0.0e0 AS value
FROM z LEFT JOIN s USING (period, name) LEFT JOIN l ON z.period = l.period WHERE k >= {TRAIN}"""


def s11_same_names(spark, sf_dir):
    """Per period: do the training and the scored rows have the same names."""
    placed = _placed(spark, sf_dir)
    sets = placed.groupBy("period").agg(
        F.sort_array(F.collect_set(F.when(F.col("at") < TRAIN, F.col("name")))).alias("a"),
        F.sort_array(F.collect_set(F.when(F.col("at") >= TRAIN, F.col("name")))).alias("b"),
    )
    return sets.select("period", (F.col("a") == F.col("b")).alias("same"))


_s11 = f"""WITH {_PLACED} SELECT period, list_sort(list(DISTINCT name) FILTER (k < {TRAIN})) = list_sort(list(DISTINCT name) FILTER (k >= {TRAIN})) AS same FROM z GROUP BY ALL"""


def a_bar_aggregates(spark, sf_dir):
    panel = lineitem_panel(spark, sf_dir)
    return panel.groupBy("period", "bar").agg(
        F.count("f2").alias("n"),
        _r(F.sum("f1"), 8).alias("total"),
        _r(F.avg("f1"), 8).alias("mean"),
        _r(F.min("f1"), 8).alias("low"),
        _r(F.max("f1"), 8).alias("high"),
        _r(F.stddev_pop("f1"), 8).alias("pop"),
        _r(F.stddev_samp("f1"), 8).alias("samp"),
        _r(F.median("f1"), 8).alias("middle"),
        F.bool_or(F.col("f2").isNull()).alias("any_null"),
        F.bool_and(F.col("f5") > 0).alias("all_up"),
    )


_a_bar = f"""WITH {PANEL_SQL} SELECT period, bar, count(f2) AS n, round(sum(f1), 8) + 0.0e0 AS total, round(avg(f1), 8) + 0.0e0 AS mean, round(min(f1), 8) + 0.0e0 AS low,
round(max(f1), 8) + 0.0e0 AS high, round(stddev_pop(f1), 8) + 0.0e0 AS pop, round(stddev_samp(f1), 8) + 0.0e0 AS samp, round(median(f1), 8) + 0.0e0 AS middle,
bool_or(f2 IS NULL) AS any_null, bool_and(f5 > 0) AS all_up FROM panel GROUP BY ALL"""


def a_covariance(spark, sf_dir):
    panel = lineitem_panel(spark, sf_dir)
    return panel.groupBy("period").agg(_r(F.covar_samp("f1", "f3")).alias("covariance"), _r(F.corr("f1", "f3")).alias("correlation"))


_a_cov = f"WITH {PANEL_SQL} SELECT period, round(covar_samp(f1, f3), 6) + 0.0e0 AS covariance, round(corr(f1, f3), 6) + 0.0e0 AS correlation FROM panel GROUP BY ALL"


def a_gram(spark, sf_dir):
    """Mean cross products of names over the training rows: the normal equations' left side."""
    train = _placed(spark, sf_dir).where(F.col("at") < TRAIN)
    return p.pairs(train, "f1").groupBy("period", "i", "j").agg(_r(F.avg("x")).alias("g"))


_a_gram = f"""WITH {_PLACED} SELECT a.period, a.name_ix AS i, c.name_ix AS j, round(avg(a.f1 * c.f1), 6) + 0.0e0 AS g
FROM z a JOIN z c USING (period, bar) WHERE a.k < {TRAIN} GROUP BY ALL"""


def a_weighted_cross(spark, sf_dir):
    """Recency-weighted products of a bar with the bar before, over the training rows."""
    train = _placed(spark, sf_dir).where(F.col("at") < TRAIN)
    ages = train.groupBy("period", "bar").agg(F.first("at").alias("at"))
    pairs = p.pairs(train, "f1", lagged=True).join(ages, ["period", "bar"])
    weight = F.pow(F.lit(0.5), (F.lit(TRAIN - 1) - F.col("at")) / F.lit(20.0))
    return pairs.groupBy("period", "i", "j").agg(_r(F.sum(F.col("x") * weight)).alias("g"))


_a_weighted = f"""WITH {_PLACED}, l AS (SELECT *, lag(f1) OVER (PARTITION BY period, name_ix ORDER BY bar) AS u0 FROM z WHERE k < {TRAIN})
SELECT a.period, a.name_ix AS i, c.name_ix AS j, round(sum(a.u0 * c.f1 * power(5e-1, ({TRAIN - 1} - a.k) / 20.0e0)), 6) + 0.0e0 AS g
FROM l a JOIN l c USING (period, bar) WHERE a.u0 IS NOT NULL GROUP BY ALL"""


def j_static_coefficients(spark, sf_dir):
    """Later rows times a graph learned from the training rows, joined on the source name."""
    w = a_gram(spark, sf_dir).where("i <> j")
    block = _placed(spark, sf_dir).where(F.col("at") >= TRAIN).select("period", "bar", F.col("name_ix").alias("i"), "f1")
    moved = block.join(w, ["period", "i"]).groupBy("period", "bar", F.col("j").alias("name_ix"))
    return moved.agg(_r(F.sum(F.col("g") * F.col("f1"))).alias("score"))


_j_static = f"""WITH {_PLACED}, g AS (SELECT a.period, a.name_ix AS i, c.name_ix AS j, round(avg(a.f1 * c.f1), 6) AS g
FROM z a JOIN z c USING (period, bar) WHERE a.k < {TRAIN} AND a.name_ix <> c.name_ix GROUP BY ALL)
SELECT z.period, z.bar, g.j AS name_ix, round(sum(g.g * z.f1), 6) + 0.0e0 AS score FROM z JOIN g ON z.period = g.period AND z.name_ix = g.i WHERE z.k >= {TRAIN} GROUP BY ALL"""


def j_refresh_block(spark, sf_dir):
    """The latest refresh before each row (blocks of ten bars), as an equality join on the block."""
    placed = _placed(spark, sf_dir).withColumn("block", F.floor(F.col("at") / 10).cast("bigint"))
    level = placed.groupBy("period", "name_ix", (F.col("block") + 1).alias("block")).agg(F.avg("f1").alias("level"))
    return placed.join(level, ["period", "name_ix", "block"]).select("period", "bar", "name_ix", _r(F.col("f1") - F.col("level")).alias("value"))


_j_block = f"""WITH {_PLACED}, b AS (SELECT *, CAST(floor(k / 10.0) AS BIGINT) AS block FROM z), l AS (SELECT period, name_ix, block + 1 AS block, avg(f1) AS level FROM b GROUP BY ALL)
SELECT period, bar, name_ix, round(f1 - level, 6) + 0.0e0 AS value FROM b JOIN l USING (period, name_ix, block)"""


def k_top_names(spark, sf_dir):
    """The three largest f1 of each bar, ties by name."""
    place = F.row_number().over(Window.partitionBy("period", "bar").orderBy(F.col("f1").desc_nulls_last(), "name_ix"))
    return lineitem_panel(spark, sf_dir).withColumn("place", place).where("place <= 3").select("period", "bar", "name_ix", "place", _r("f1").alias("f1"))


_k_top = f"""WITH {PANEL_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY period, bar ORDER BY f1 DESC NULLS LAST, name_ix) AS INTEGER) AS place FROM panel)
SELECT period, bar, name_ix, place, round(f1, 6) + 0.0e0 AS f1 FROM r WHERE place <= 3"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        s01_feature_slice, s03_wide_source, s02_names, s02d_native_order, s05_split_features, s06_clean, s10_field_rows, s12_result_frame, s07_warm_up_union, s08_tail, s09_align_state, s11_same_names, a_bar_aggregates, a_covariance, a_gram,
        a_weighted_cross, j_static_coefficients, j_refresh_block, k_top_names,
    )
}
ORACLE_SQL: dict[str, str] = {
    "s01_feature_slice": _s01,
    "s03_wide_source": _s01,
    "s02_names": _s02,
    "s02d_native_order": _s02d,
    "s05_split_features": _s05,
    "s06_clean": _s06,
    "s10_field_rows": _s10,
    "s12_result_frame": _s12,
    "s07_warm_up_union": _s07,
    "s08_tail": _s08,
    "s09_align_state": _s09,
    "s11_same_names": _s11,
    "a_bar_aggregates": _a_bar,
    "a_covariance": _a_cov,
    "a_gram": _a_gram,
    "a_weighted_cross": _a_weighted,
    "j_static_coefficients": _j_static,
    "j_refresh_block": _j_block,
    "k_top_names": _k_top,
}
