"""Evaluation of scores: profit, Sharpe ratio, information coefficient, profit correlation, scales, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.wide import exact_quantile


def history_rows():
    return Window.partitionBy("period", "name_ix").orderBy("bar")


def bar_rows():
    return Window.partitionBy("period", "bar")


def profits(scored: DataFrame, score: str = "score", ret: str = "f1") -> DataFrame:
    """(period, bar, profit): the scores of the bar before on this bar's returns; 0 on the first."""
    held = scored.withColumn("held", F.coalesce(F.lag(score).over(history_rows()), F.lit(0.0)))
    return held.groupBy("period", "bar").agg(F.sum(F.col("held") * F.coalesce(ret, F.lit(0.0))).alias("profit"))


def sharpe(p: DataFrame) -> DataFrame:
    """(period, bars, mean, deviation, sharpe) per bar, not annualised."""
    out = p.groupBy("period").agg(F.count(F.lit(1)).alias("bars"), F.avg("profit").alias("mean"), F.stddev_pop("profit").alias("deviation"))
    return out.withColumn("sharpe", F.col("mean") / F.nullif("deviation", F.lit(0.0)))


def information(scored: DataFrame, score: str = "score", ret: str = "f1") -> DataFrame:
    """(period, ic): mean over bars of the correlation of scores with the next bar's returns."""
    ahead = scored.withColumn("ahead", F.lead(ret).over(history_rows())).where(F.col("ahead").isNotNull())
    per_bar = ahead.groupBy("period", "bar").agg(F.corr(score, "ahead").alias("c"))
    return per_bar.groupBy("period").agg(F.avg(F.coalesce(F.nanvl("c", F.lit(0.0)), F.lit(0.0))).alias("ic"))


def profit_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """(period, c): correlation of two profit streams."""
    both = a.withColumnRenamed("profit", "p").join(b.withColumnRenamed("profit", "q"), ["period", "bar"])
    return both.groupBy("period").agg(F.corr("p", "q").alias("c"))


def concentration(p: DataFrame) -> DataFrame:
    """(period, share): greatest share of one bar in the sum of squared profits."""
    return p.groupBy("period").agg((F.max(F.col("profit") * F.col("profit")) / F.nullif(F.sum(F.col("profit") * F.col("profit")), F.lit(0.0))).alias("share"))


def mean_dispersion(scored: DataFrame, score: str = "score") -> DataFrame:
    """(period, scale): mean over bars of the population deviation of the scores."""
    per_bar = scored.groupBy("period", "bar").agg(F.stddev_pop(score).alias("d"))
    return per_bar.groupBy("period").agg(F.avg("d").alias("scale"))


def median_dispersion(scored: DataFrame, prior: float, score: str = "score") -> DataFrame:
    """(period, scale): median over bars of the deviation, drawn halfway to a prior."""
    per_bar = scored.groupBy("period", "bar").agg(F.stddev_pop(score).alias("d")).where("d > 1e-12")
    return exact_quantile(per_bar, ["period"], "d").select("period", (0.5 * F.col("quantile") + 0.5 * prior).alias("scale"))


def equal_risk(legs: dict[str, DataFrame], panel: DataFrame, first: int, last: int) -> DataFrame:
    """Sum of legs over the deviation of their profits in bars first..last - 1 of each period, de-meaned."""
    out = None
    start = F.min("bar").over(Window.partitionBy("period"))
    for name, leg in legs.items():
        rows = leg.join(panel.select("period", "bar", "name_ix", "f1"), ["period", "bar", "name_ix"])
        p = profits(rows).withColumn("at", F.col("bar") - start)
        risk = p.where((F.col("at") >= first) & (F.col("at") < last)).groupBy("period").agg(F.stddev_pop("profit").alias("risk"))
        one = leg.join(risk, "period").select("period", "bar", "name_ix", (F.col("score") / F.nullif("risk", F.lit(0.0))).alias(name))
        out = one if out is None else out.join(one, ["period", "bar", "name_ix"])
    total = sum((F.coalesce(n, F.lit(0.0)) for n in legs), F.lit(0.0))
    return out.select("period", "bar", "name_ix", (total - F.avg(total).over(bar_rows())).alias("score"))


#: Folds of a period at most.
FOLDS = 1 << 12


def walk_forward(panel: DataFrame, train: int, step: int) -> DataFrame:
    """All walk-forward folds as one panel: ``step`` scored bars with the ``train`` bars before them, marked by
    ``is_train``. The fold is part of the period (see ``fold_of``), so any operator works fold by fold, and the panel
    behind is scanned once. A row stands in as many folds as hold its bar; a fold without scored bars isn't made."""
    whole = Window.partitionBy("period")
    placed = panel.withColumn("at", F.col("bar") - F.min("bar").over(whole))
    placed = placed.withColumn("most", F.max("at").over(whole))
    first = F.greatest(F.floor((F.col("at") - train) / step), F.lit(0))
    last = F.least(F.floor(F.col("at") / step), F.floor((F.col("most") - train) / step), F.lit(FOLDS - 1))
    folds = placed.where(last >= first).withColumn("fold", F.explode(F.sequence(first, last)))
    marked = folds.withColumns({"is_train": F.col("at") < train + step * F.col("fold"), "period": (F.col("period") * FOLDS + F.col("fold")).cast("int")})
    return marked.select(*[c for c in panel.columns if c != "is_train"], "is_train")


def fold_of(results: DataFrame) -> DataFrame:
    """Results by period of a walk-forward panel, with ``period`` and ``fold`` apart."""
    return results.withColumns({"fold": F.pmod("period", F.lit(FOLDS)).cast("int"), "period": F.floor(F.col("period") / FOLDS).cast("int")})


def bootstrap(p: DataFrame, rounds: int = 200) -> DataFrame:
    """(round, sharpe): mean Sharpe ratio over periods drawn with replacement, draws by hash."""
    per = sharpe(p).select("period", "sharpe")
    drawn = per.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    # Poisson resampling with mean one: the number of draws of a period in a round, from a uniform hash
    digest = F.md5(F.concat_ws(":", "period", "round"))
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32
    times = sum(((u > c).cast("int") for c in (0.367879, 0.735759, 0.919699, 0.981012)), F.lit(0))
    return drawn.withColumn("times", times).groupBy("round").agg((F.sum(F.col("sharpe") * F.col("times")) / F.nullif(F.sum("times"), F.lit(0))).alias("sharpe"))
