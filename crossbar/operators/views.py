"""Statistics kept by block and extended by new blocks only.

A view is a folder with one partition a block: for each key the count, the means and the centred second moments of some
values. Blocks are merged by the differences of their means, so no digits are lost to an offset and the whole is what
one pass over all rows gives. A new block costs a scan of its own rows; older rows are never read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _pairs(values: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for k, a in enumerate(values) for b in values[k:]]


def summarise(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """by, n, a mean of each value and the sum of products of deviations of each pair (m_a_b), over rows where all
    values are there; a key without any isn't kept."""
    whole = rows.where(" AND ".join(f"`{v}` IS NOT NULL" for v in values))
    means = [F.avg(v).alias(f"mean_{v}") for v in values]
    products = [(F.covar_pop(a, b) * F.count(F.lit(1))).alias(f"m_{a}_{b}") for a, b in _pairs(values)]
    return whole.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *means, *products)


def merge(parts: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """One row a key from the rows of its blocks."""
    own = Window.partitionBy(*by)
    total = F.sum("n").over(own)
    placed = parts.withColumns({f"all_{v}": F.sum(F.col("n") * F.col(f"mean_{v}")).over(own) / total for v in values})
    gap = lambda v: F.col(f"mean_{v}") - F.col(f"all_{v}")
    products = [F.sum(F.col(f"m_{a}_{b}") + F.col("n") * gap(a) * gap(b)).alias(f"m_{a}_{b}") for a, b in _pairs(values)]
    return placed.groupBy(*by).agg(F.sum("n").alias("n"), *[F.first(f"all_{v}").alias(f"mean_{v}") for v in values], *products)


def extend(rows: DataFrame, path: str, block: int, by: list[str], values: list[str]) -> None:
    """Add a block to the view, or put it in place of the one that stands there: written anew, it counts once."""
    summarise(rows, by, values).write.mode("overwrite").parquet(f"{path}/block={block}")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """All blocks of a view, with their number as ``block``."""
    return spark.read.parquet(path)


def covariance(a: str, b: str) -> Column:
    """Sample covariance of a pair from merged statistics; null for a single row."""
    return F.col(f"m_{a}_{b}") / F.nullif(F.col("n") - 1, F.lit(0))


def slope(y: str, x: str) -> Column:
    """Slope of y on x; x stands before y in the view's values."""
    return F.col(f"m_{x}_{y}") / F.nullif(F.col(f"m_{x}_{x}"), F.lit(0.0))
