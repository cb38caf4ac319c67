"""Queries of the operators over large groups, with the same as DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import views
from .operators.wide import as_of, exact_quantile, running, wide_ranks
from .session import prepare, shared_folder
from .streaming import histories

#: Microseconds of a range of time: an hour.
HOUR = 3_600_000_000
#: How old a purchase may be.
REACH = 48 * HOUR


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))


def x04_wide_bar_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar is a priority, its names are orders: average rank with many ties, ordinal rank by order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("bar"), F.col("o_orderkey").alias("name"), F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("value"))
    found = wide_ranks(orders, ["bar"], "value", "name")
    return found.select("bar", "name", (F.round("average", 9) + F.lit(0.0)).alias("average"), F.col("place").cast("bigint").alias("place"))


_x04 = """WITH o AS (SELECT o_orderpriority AS bar, o_orderkey AS name, floor(o_totalprice / 1000) AS v FROM orders),
r AS (SELECT bar, name, rank() OVER (PARTITION BY bar ORDER BY v) + (count(*) OVER (PARTITION BY bar, v) - 1) / 2.0e0 AS a, count(*) OVER (PARTITION BY bar) AS n,
             row_number() OVER (PARTITION BY bar ORDER BY v, name) AS place FROM o)
SELECT bar, name, round((a - (n + 1) / 2.0e0) / ((n - 1) / 2.0e0), 9) + 0.0e0 AS average, place FROM r"""


def t15_long_running_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sum and mean of the values of each event type, in blocks of a day."""
    found = running(_events(spark, sf_dir), ["event_type"], "at", "cents", 24 * HOUR, "event_id")
    return found.select("event_type", "event_id", "total", (F.round(F.col("total") / F.nullif("count", F.lit(0)), 6) + F.lit(0.0)).alias("mean"))


_t15 = """SELECT event_type, event_id, CAST(sum(c) OVER w AS BIGINT) AS total, round(CAST(sum(c) OVER w AS DOUBLE) / count(c) OVER w, 6) + 0.0e0 AS mean
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""


def j_as_of_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its user's last purchase at or before it, of the last two days."""
    events = _events(spark, sf_dir)
    bought = events.where("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("purchase_id"), F.col("cents").alias("paid"))
    found = as_of(events, bought, ["user_id"], "at", ["purchase_id", "paid"], 6 * HOUR, tie="purchase_id", tolerance=REACH)
    return found.select("event_id", "user_id", "purchase_id", "paid", (F.col("at") - F.col("as_of")).alias("age"))


_j_as_of = f"""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS c FROM events),
b AS (SELECT user_id, us, event_id AS purchase_id, c AS paid FROM e WHERE event_type = 'purchase'
      QUALIFY row_number() OVER (PARTITION BY user_id, us ORDER BY event_id DESC) = 1),
j AS (SELECT e.event_id, e.user_id, b.purchase_id, b.paid, e.us - b.us AS age FROM e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.us >= b.us)
SELECT event_id, user_id, CASE WHEN age <= {REACH} THEN purchase_id END AS purchase_id, CASE WHEN age <= {REACH} THEN paid END AS paid, CASE WHEN age <= {REACH} THEN age END AS age FROM j"""


def g28_extended_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of price and quantity by status, kept by year and extended a year at a time."""
    rows = prepare(spark).read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.year("l_shipdate").alias("year"), F.concat("l_returnflag", "l_linestatus").alias("status"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / 1000 + 1e5).alias("price")
    )
    by, values, path = ["status"], ["quantity", "price"], f"{shared_folder(spark)}/moments-{uuid.uuid4().hex}"
    for year in sorted(r[0] for r in rows.select("year").distinct().collect()):  # a block a year
        views.extend(rows.where(F.col("year") == year), path, year, by, values)
    merged = views.merge(views.blocks(spark, path), by, values)
    found = {"mean": F.col("mean_price"), "variance": views.covariance("price", "price"), "covariance": views.covariance("quantity", "price"), "slope": views.slope("price", "quantity")}
    return merged.select("status", "n", *[(F.round(v, 6) + F.lit(0.0)).alias(c) for c, v in found.items()])


_g28 = """SELECT l_returnflag || l_linestatus AS status, count(*) AS n, round(avg(l_extendedprice / 1000 + 1e5), 6) + 0.0e0 AS mean,
round(var_samp(l_extendedprice / 1000), 6) + 0.0e0 AS variance, round(covar_samp(l_quantity, l_extendedprice / 1000), 6) + 0.0e0 AS covariance,
round(regr_slope(l_extendedprice / 1000, l_quantity), 6) + 0.0e0 AS slope FROM lineitem GROUP BY 1"""


def a_exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and ninth decile of the prices of each flag and status, exact."""
    lines = prepare(spark).read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("double").alias("price"))
    by = ["l_returnflag", "l_linestatus"]
    half, most = (exact_quantile(lines, by, "price", p, large=1 << 10) for p in (0.5, 0.9))
    return half.withColumnRenamed("quantile", "median").join(most, by).select(*by, (F.round("median", 6) + F.lit(0.0)).alias("median"), (F.round("quantile", 6) + F.lit(0.0)).alias("decile"))


_quantiles = """SELECT l_returnflag, l_linestatus, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 6) + 0.0e0 AS median,
round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.9), 6) + 0.0e0 AS decile FROM lineitem GROUP BY ALL"""


def st_history_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed in two runs, the second from the first's checkpoint: decaying mean and standing of each user."""
    events = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("user_id").cast("bigint").alias("name"), F.col("event_id").cast("bigint").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    found = histories.replay(spark, rows, f"{shared_folder(spark)}/histories-{uuid.uuid4().hex}", 12 * HOUR, 10, 36 * HOUR)
    return found.select("name", "id", "n", (F.round("mean", 6) + F.lit(0.0)).alias("mean"), "below")


_st_history = f"""WITH e AS (SELECT CAST(user_id AS BIGINT) AS name, CAST(event_id AS BIGINT) AS id, epoch_us(ts) AS us, value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL),
g AS (SELECT *, CAST(us - lag(us) OVER (PARTITION BY name ORDER BY us, id) > {36 * HOUR} AS INT) AS gap FROM e),
s AS (SELECT *, sum(coalesce(gap, 0)) OVER (PARTITION BY name ORDER BY us, id) AS part FROM g),
p AS (SELECT *, pow(2.0e0, (us - min(us) OVER (PARTITION BY name, part)) / {float(12 * HOUR)!r}) AS k FROM s)
SELECT name, id, row_number() OVER w AS n, round(sum(k * value) OVER w / sum(CASE WHEN value IS NOT NULL THEN k END) OVER w, 6) + 0.0e0 AS mean,
CASE WHEN value IS NOT NULL THEN CAST(len(list_filter(list(value) OVER (w ROWS 9 PRECEDING), lambda x: x < value)) AS INT) END AS below
FROM p WINDOW w AS (PARTITION BY name, part ORDER BY us, id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (x04_wide_bar_ranks, t15_long_running_sums, j_as_of_purchase, g28_extended_statistics, a_exact_quantiles, st_history_scores)}
ORACLE_SQL: dict[str, str] = {"x04_wide_bar_ranks": _x04, "t15_long_running_sums": _t15, "j_as_of_purchase": _j_as_of, "g28_extended_statistics": _g28, "a_exact_quantiles": _quantiles, "st_history_scores": _st_history}
