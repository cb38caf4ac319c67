"""The panel: one row per (period, bar, name) with features f1..f6 and a forward label.

``read_wide`` and ``wide_table`` convert wide tables of any size (rows bars, columns (feature, name)) on the executors,
``from_wide`` and ``to_wide`` pandas frames; ``lineitem_panel``
and ``events_panel`` build dense panels from tables, ``PANEL_SQL`` says the first one in SQL for checks.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEATURES = tuple(f"f{k}" for k in range(1, 7))
NAMES = 20
PERIOD_BARS = 120
FORWARD = 5
#: Divisors of levels and cash: not round, so that values of whole numbers don't lie halfway between two places.
UNIT, CASH_UNIT = 9.99983, 700001.0


def ts_rows():
    return Window.partitionBy("period", "name_ix").orderBy("bar")


def clean(x: Column) -> Column:
    """NaN and infinities as null: the missing value of every operator."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def zero_fill(x: Column) -> Column:
    """NaN, infinities and nulls as zero."""
    return F.coalesce(clean(x), F.lit(0.0))


def name_index(name: Column) -> Column:
    """The integer suffix of a name such as ``X.12``: names sort by it, not by their letters."""
    return F.element_at(F.split(name, r"\."), -1).cast("int")


def native_order(names: DataFrame, name: str, place: str) -> DataFrame:
    """(name, name_ix): names numbered by where they first come, not by their suffix."""
    first = names.groupBy(name).agg(F.min(place).alias("first"))
    return first.select(name, (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("first", name)) - 1).alias("name_ix"))


def split_features(panel: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row a value: period, bar, name_ix, feature (its number), value."""
    cells = [F.struct(F.lit(int(f[1:])).alias("feature"), F.col(f).alias("value")) for f in features]
    return panel.select("period", "bar", "name_ix", F.inline(F.array(*cells)))


def field_rows(panel: DataFrame, field: str) -> DataFrame:
    """period, bar and the values of one field in the order of the names, missing ones as 0."""
    cells = F.sort_array(F.collect_list(F.struct("name_ix", zero_fill(F.col(field)).alias("value"))))
    return panel.groupBy("period", "bar").agg(F.transform(cells, lambda c: c["value"]).alias("row"))


def result_frame(scores: DataFrame, names: list[int], value: str = "score") -> DataFrame:
    """One row a bar and one column a name (``n0``, ``n1``, ..), missing scores as 0: what ``write_frame`` stores."""
    wide = scores.groupBy("period", "bar").pivot("name_ix", names).agg(F.first(value))
    return wide.select("period", "bar", *[zero_fill(F.col(f"`{n}`").cast("double")).alias(f"n{n}") for n in names])


def write_frame(scores: DataFrame, path: str, names: list[int], value: str = "score") -> None:
    """The result frame as Parquet, a folder a period."""
    result_frame(scores, names, value).write.partitionBy("period").parquet(path)


def from_wide(spark: SparkSession, features: pd.DataFrame, target: pd.DataFrame | None = None, period: int = 0, order: str = "suffix") -> DataFrame:
    """Long panel from a frame with columns (``Feature.k``, name); NaN becomes null. Names are numbered by their
    suffix, or with ``order="native"`` by the order of their columns."""
    parts = []
    names = features.columns.get_level_values(1).unique()
    for k in range(1, 7):
        one = features[f"Feature.{k}"].reindex(columns=names).reset_index(drop=True)
        parts.append(one.stack(future_stack=True).rename(f"f{k}"))
    long = pd.concat(parts, axis=1)
    if target is not None:
        long["target"] = target.reindex(columns=names).reset_index(drop=True).stack(future_stack=True)
    else:
        long["target"] = None
    long.index.names = ["bar", "name"]
    long = long.reset_index().astype({"target": "float64"})
    df = spark.createDataFrame(long).withColumns({c: clean(F.col(c)) for c in (*FEATURES, "target")})
    number = name_index(F.col("name")) if order == "suffix" else F.array_position(F.lit([str(n) for n in names]), F.col("name")).cast("int") - 1
    return df.select(
        F.lit(period).alias("period"),
        F.col("bar").cast("bigint").alias("bar"),
        "name",
        number.alias("name_ix"),
        F.lit(target is not None).alias("is_train"),
        *FEATURES,
        "target",
    )


#: Columns of a wide table: ``Feature.k|name`` or ``Target|name``, or the pairs as pandas writes them to Parquet.
_WIDE = re.compile(r"\(?'?(?:Feature\.(\d+)|Target)'?\s*[|,]\s*'?([^']+?)'?\)?")


def read_wide(table: DataFrame, bar: str = "bar", period: str | None = None, features: tuple[str, ...] = FEATURES, order: str = "suffix") -> DataFrame:
    """Long panel from a wide table of any size, such as one of Parquet or CSV files: a row a bar, a column a feature and
    name. Rows are turned on the executors, each by itself, and only columns of ``features`` are read. NaN becomes null;
    a feature that the table hasn't got is null. ``order`` is as in ``from_wide``."""
    found: dict[str, dict[str, str]] = {}
    for column in table.columns:
        m = _WIDE.fullmatch(column)
        if m:
            found.setdefault(m[2], {})[f"f{m[1]}" if m[1] else "target"] = column
    if not found:
        raise ValueError("no column is named like Feature.1|X.3")
    lacks = F.lit(None).cast("double")
    value = lambda columns, f: clean(F.col(f"`{columns[f]}`").cast("double")) if f in columns else lacks
    cells = [
        F.struct(F.lit(n).alias("name"), (name_index(F.lit(n)) if order == "suffix" else F.lit(k)).alias("name_ix"), *[value(c, f).alias(f) for f in (*features, "target")])
        for k, (n, c) in enumerate(found.items())
    ]
    when = (F.col(period).cast("int") if period else F.lit(0)).alias("period")
    long = table.select(when, F.col(bar).cast("bigint").alias("bar"), F.inline(F.array(*cells)))
    return long.select("period", "bar", "name", "name_ix", F.lit(any("target" in c for c in found.values())).alias("is_train"), *features, "target")


def wide_table(panel: DataFrame, names: list[str], features: tuple[str, ...] = FEATURES) -> DataFrame:
    """The wide table of a panel: period, bar, and a column ``Feature.k|name`` for each of the given names."""
    one = lambda f, n: F.max(F.when(F.col("name") == n, F.col(f))).alias(f"Feature.{f[1:]}|{n}")
    return panel.groupBy("period", "bar").agg(*[one(f, n) for f in features for n in names])


def to_wide(scores: DataFrame, value: str = "score") -> pd.DataFrame:
    """One column a name in suffix order, one row a bar (collects: for results of one block)."""
    got = scores.select("bar", "name_ix", value).toPandas()
    return got.pivot(index="bar", columns="name_ix", values=value).sort_index(axis=0).sort_index(axis=1)


def densify(cells: DataFrame) -> DataFrame:
    """Every (bar, name) cell, so that "one row before" is "one bar before". The names are few: the spine is
    an array of them on each bar. Cells are kept once made, so the table behind is scanned once."""
    cells = cells.persist()
    names = cells.agg(F.sort_array(F.collect_set("name_ix")).alias("names")).scalar()
    spine = cells.select("bar").distinct().select("bar", F.explode(names).alias("name_ix"))
    return spine.join(cells, ["bar", "name_ix"], "left")


def _finish(cells: DataFrame, period_bars: int) -> DataFrame:
    """Features and label from dense cells (n, q, nr, qr, na, qa, p: exact integers)."""
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    base = cells.select(
        F.floor(F.col("bar") / period_bars).cast("int").alias("period"),
        "bar",
        F.concat(F.lit("X."), F.col("name_ix").cast("string")).alias("name"),
        "name_ix",
        ratio("q", "n").alias("r1"),
        ratio("qr", "nr").alias("r3"),
        ratio("qa", "na").alias("r4"),
        (F.coalesce("qa", F.lit(0)) - F.coalesce("qr", F.lit(0))).cast("double").alias("f5"),
        (F.coalesce("p", F.lit(0)) / CASH_UNIT).alias("cash"),
    )
    level = base.withColumns({f"f{k}": (F.col(f"r{k}") - 25.5e0) / UNIT for k in (1, 3, 4)})
    moved = level.withColumns(
        {
            "f2": F.lag("f1").over(ts_rows()),
            "f6": F.avg("cash").over(ts_rows().rowsBetween(-7, 0)),
            "target": F.when(F.count("f1").over(ts_rows().rowsBetween(1, FORWARD)) == FORWARD, F.sum("f1").over(ts_rows().rowsBetween(1, FORWARD))),
        }
    )
    return moved.select("period", "bar", "name", "name_ix", F.col("target").isNotNull().alias("is_train"), *FEATURES, "target")


def lineitem_panel(spark: SparkSession, sf_dir: str, names: int = NAMES, period_bars: int = PERIOD_BARS) -> DataFrame:
    """Weeks by supplier classes. Only the columns and sums that the features need leave the scan."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.datediff(F.date_trunc("week", "l_shipdate").cast("date"), F.lit("1995-01-02").cast("date")).alias("day"),
        (F.col("l_suppkey") % names).cast("int").alias("name_ix"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.col("l_returnflag").alias("flag"),
    )
    cells = rows.groupBy((F.col("day") / 7).cast("bigint").alias("bar"), "name_ix").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("qty").alias("q"),
        F.count(F.when(F.col("flag") == "R", 1)).alias("nr"),
        F.sum(F.when(F.col("flag") == "R", F.col("qty"))).alias("qr"),
        F.count(F.when(F.col("flag") == "A", 1)).alias("na"),
        F.sum(F.when(F.col("flag") == "A", F.col("qty"))).alias("qa"),
        F.sum("cents").alias("p"),
    )
    return _finish(densify(cells), period_bars)


def events_panel(spark: SparkSession, sf_dir: str, period_bars: int = 240) -> DataFrame:
    """Hours by event type: a small sparse panel of counts and values."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("bigint").alias("bar"),
        F.pmod(F.crc32(F.col("event_type").cast("binary")), F.lit(1000)).cast("int").alias("name_ix"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        (F.col("user_id") % 3).alias("part"),
    )
    cells = rows.groupBy("bar", "name_ix").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("cents").alias("q"),
        F.count(F.when(F.col("part") == 0, 1)).alias("nr"),
        F.sum(F.when(F.col("part") == 0, F.col("cents"))).alias("qr"),
        F.count(F.when(F.col("part") == 1, 1)).alias("na"),
        F.sum(F.when(F.col("part") == 1, F.col("cents"))).alias("qa"),
        F.sum("cents").alias("p"),
    )
    return _finish(densify(cells), period_bars)


#: The default panel in DuckDB SQL, as CTEs that end in ``panel``.
PANEL_SQL = f"""
cells AS (
    SELECT CAST(floor(date_diff('day', DATE '1995-01-02', CAST(date_trunc('week', l_shipdate) AS DATE)) / 7) AS BIGINT) AS bar,
           CAST(l_suppkey % {NAMES} AS INTEGER) AS name_ix,
           count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q,
           count(*) FILTER (l_returnflag = 'R') AS nr, sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'R') AS qr,
           count(*) FILTER (l_returnflag = 'A') AS na, sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'A') AS qa,
           sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS p
    FROM lineitem GROUP BY 1, 2),
spine AS (SELECT bar, name_ix FROM (SELECT DISTINCT bar FROM cells), (SELECT DISTINCT name_ix FROM cells)),
base AS (
    SELECT CAST(floor(bar / {PERIOD_BARS}.0) AS INTEGER) AS period, bar, name_ix,
           coalesce(q / nullif(n, 0), 0.0) AS r1, coalesce(qr / nullif(nr, 0), 0.0) AS r3,
           coalesce(qa / nullif(na, 0), 0.0) AS r4,
           CAST(coalesce(qa, 0) - coalesce(qr, 0) AS DOUBLE) AS f5, coalesce(p, 0) / {CASH_UNIT:e} AS cash
    FROM spine LEFT JOIN cells USING (bar, name_ix)),
level AS (
    SELECT *, (r1 - 25.5e0) / {UNIT:e} AS f1, (r3 - 25.5e0) / {UNIT:e} AS f3, (r4 - 25.5e0) / {UNIT:e} AS f4 FROM base),
panel AS (
    SELECT period, bar, 'X.' || name_ix AS name, name_ix, f1, lag(f1) OVER ts AS f2, f3, f4, f5,
           avg(cash) OVER (PARTITION BY period, name_ix ORDER BY bar ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS f6,
           CASE WHEN count(f1) OVER ahead = {FORWARD} THEN sum(f1) OVER ahead END AS target
    FROM level
    WINDOW ts AS (PARTITION BY period, name_ix ORDER BY bar),
           ahead AS (PARTITION BY period, name_ix ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND {FORWARD} FOLLOWING))"""
