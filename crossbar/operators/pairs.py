"""Operators over pairs of names as joins and windows on long pair rows.

A bar's pairs come from one row per bar that holds its names' values as an array, so making them is a projection
with two generators and never a join; the pairs of a bar with the bar before use a lag of that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_rows():
    return Window.partitionBy("period", "i", "j").orderBy("bar")


def row_rows():
    return Window.partitionBy("period", "bar", "i")


def cross_sections(df: DataFrame, value: str) -> DataFrame:
    """One row per bar: names and values as arrays in name order, and the values of the bar before."""
    rows = df.groupBy("period", "bar").agg(F.sort_array(F.collect_list(F.struct("name_ix", F.coalesce(F.col(value), F.lit(0.0)).alias("v")))).alias("xs"))
    rows = rows.select("period", "bar", F.col("xs.name_ix").alias("names"), F.col("xs.v").alias("x"))
    before = Window.partitionBy("period").orderBy("bar")
    return rows.withColumn("x_before", F.lag("x").over(before))


def pairs(df: DataFrame, value: str, lagged: bool = False) -> DataFrame:
    """(period, bar, i, j, x): x = value_i(t) value_j(t), or value_i(t - 1) value_j(t)."""
    rows = cross_sections(df, value)
    first = F.posexplode("x_before" if lagged else "x").alias("a", "left")
    one = rows.select("period", "bar", "names", "x", first)
    two = one.select("period", "bar", "names", "a", "left", F.posexplode("x").alias("b", "right"))
    name = lambda k: F.element_at("names", F.col(k) + 1)
    return two.select("period", "bar", name("a").alias("i"), name("b").alias("j"), (F.col("left") * F.col("right")).alias("x"))


def moments(p: DataFrame, bars: int | None = None) -> DataFrame:
    """Sum and count of pair products over the last ``bars`` rows (all so far without); by prefix differences."""
    total = F.sum("x").over(pair_rows().rowsBetween(Window.unboundedPreceding, 0))
    n = F.count("x").over(pair_rows().rowsBetween(Window.unboundedPreceding, 0))
    out = p.withColumns({"m": total, "n": n})
    if bars is None:
        return out
    return out.withColumns(
        {"m": F.col("m") - F.coalesce(F.lag("m", bars).over(pair_rows()), F.lit(0.0)), "n": F.least("n", F.lit(bars))}
    )


def adjacency_score(df: DataFrame, value: str, warm: int = 40) -> DataFrame:
    """Expanding lead-lag adjacency off the diagonal times the current values: (period, bar, name_ix, score)."""
    m = moments(pairs(df, value, lagged=True)).where("i <> j")
    edges = m.where(F.col("n") >= warm).select("period", "bar", "i", "j", (F.col("m") / F.col("n")).alias("a"))
    now = df.select("period", "bar", F.col("name_ix").alias("i"), F.coalesce(value, F.lit(0.0)).alias("u"))
    summed = edges.join(now, ["period", "bar", "i"]).groupBy("period", "bar", F.col("j").alias("name_ix")).agg(F.sum(F.col("a") * F.col("u")).alias("score"))
    return df.select("period", "bar", "name_ix").join(summed, ["period", "bar", "name_ix"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def expanding_correlation(df: DataFrame, value: str, warm: int = 30) -> DataFrame:
    """(period, bar, i, j, c): uncentred expanding correlation of pairs i <> j, null before ``warm`` rows.

    Each name's sum of squares comes along in the bar's array, and each pair is made once and mirrored at the end.
    """
    u = F.coalesce(F.col(value), F.lit(0.0))
    history = Window.partitionBy("period", "name_ix").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    cells = df.select("period", "bar", F.struct("name_ix", u.alias("v"), F.sum(u * u).over(history).alias("d")).alias("cell"))
    rows = cells.groupBy("period", "bar").agg(F.sort_array(F.collect_list("cell")).alias("xs"))
    one = rows.select("period", "bar", "xs", F.posexplode("xs").alias("a", "left"))
    two = one.select("period", "bar", "left", F.explode(F.slice("xs", F.col("a") + 2, F.size("xs"))).alias("right"))
    p = two.select("period", "bar", F.col("left.name_ix").alias("i"), F.col("right.name_ix").alias("j"), (F.col("left.v") * F.col("right.v")).alias("x"), (F.col("left.d") * F.col("right.d")).alias("dd"))
    m = moments(p)
    half = m.select("period", "bar", "i", "j", F.when(F.col("n") > warm, F.col("m") / (F.sqrt("dd") + 1e-9)).alias("c"))
    return half.unionByName(half.select("period", "bar", F.col("j").alias("i"), F.col("i").alias("j"), "c"))


def positive_weights(c: DataFrame, names: int) -> DataFrame:
    """Positive correlations scaled to sum 1 in each row; even weights where there is none."""
    plus = F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(0.0))
    mass = F.sum(plus).over(row_rows())
    return c.withColumn("w", F.when(mass > 1e-9, plus / (mass + 1e-9)).otherwise(F.lit(1.0 / (names - 1)))).select("period", "bar", "i", "j", "w")


def top_weights(c: DataFrame, k: int = 3) -> DataFrame:
    """Equal weights on the k most correlated names of each row, ties by name."""
    place = F.row_number().over(row_rows().orderBy(F.col("c").desc_nulls_last(), "j"))
    return c.where("c is not null").withColumn("place", place).where(F.col("place") <= k).select("period", "bar", "i", "j", F.lit(1.0 / k).alias("w"))


def top_magnitude(a: DataFrame, k: int = 5) -> DataFrame:
    """The k largest entries of each row by magnitude, scaled to magnitude 1 in sum; ties by name."""
    place = F.row_number().over(row_rows().orderBy(F.abs("a").desc(), "j"))
    kept = a.withColumn("place", place).where(F.col("place") <= k)
    return kept.withColumn("w", F.col("a") / (F.sum(F.abs("a")).over(row_rows()) + 1e-12)).select("period", "bar", "i", "j", "w")


def propagate(weights: DataFrame, df: DataFrame, value: str | Column) -> DataFrame:
    """Weighted sum of the neighbours' values: (period, bar, name_ix, score)."""
    value = F.col(value) if isinstance(value, str) else value
    source = df.select("period", "bar", F.col("name_ix").alias("j"), F.coalesce(value, F.lit(0.0)).alias("v"))
    return weights.join(source, ["period", "bar", "j"]).groupBy("period", "bar", F.col("i").alias("name_ix")).agg(F.sum(F.col("w") * F.col("v")).alias("score"))


def second_order(weights: DataFrame) -> DataFrame:
    """Weights of two steps, off the diagonal."""
    a = weights.select("period", "bar", "i", F.col("j").alias("k"), F.col("w").alias("w1"))
    b = weights.select("period", "bar", F.col("i").alias("k"), "j", F.col("w").alias("w2"))
    return a.join(b, ["period", "bar", "k"]).where("i <> j").groupBy("period", "bar", "i", "j").agg(F.sum(F.col("w1") * F.col("w2")).alias("w"))


def flow_imbalance(m: DataFrame) -> DataFrame:
    """Outgoing less incoming magnitude of each name: (period, bar, name_ix, score)."""
    ends = m.select("period", "bar", F.inline(F.array(F.struct(F.col("i").alias("name_ix"), F.abs("m").alias("s")), F.struct(F.col("j").alias("name_ix"), (-F.abs("m")).alias("s")))))
    return ends.groupBy("period", "bar", "name_ix").agg(F.sum("s").alias("score"))


def trailing_correlation(df: DataFrame, value: str, bars: int = 60) -> DataFrame:
    """(period, bar, i, j, c) of pairs i <> j over the ``bars`` rows before each bar; null with fewer."""
    rows = cross_sections(df, value)
    one = rows.select("period", "bar", "names", "x", F.posexplode("x").alias("a", "left"))
    two = one.select("period", "bar", "names", "a", "left", F.posexplode("x").alias("b", "right")).where("a < b")
    w = Window.partitionBy("period", "a", "b").orderBy("bar").rowsBetween(-bars, -1)
    n = F.count("left").over(w)
    got = two.select("period", "bar", "names", "a", "b", F.when(n == bars, F.corr("left", "right").over(w)).alias("c"))
    name = lambda k: F.element_at("names", F.col(k) + 1)
    half = got.select("period", "bar", name("a").alias("i"), name("b").alias("j"), F.nanvl("c", F.lit(0.0)).alias("c"))
    return half.unionByName(half.select("period", "bar", F.col("j").alias("i"), F.col("i").alias("j"), "c"))


def sufficient_statistics(df: DataFrame, value: str, cap: int = 500) -> DataFrame:
    """Count and sums of each name's values, counted as ``cap`` rows at most."""
    sums = df.groupBy("period", "name_ix").agg(F.count(value).cast("double").alias("n"), F.sum(value).alias("s1"), F.sum(F.col(value) * F.col(value)).alias("s2"))
    part = F.least(F.lit(1.0), cap / F.col("n"))
    return sums.select("period", "name_ix", *[(F.col(c) * part).alias(c) for c in ("n", "s1", "s2")])
