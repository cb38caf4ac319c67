"""Stateful scores of a stream of (period, bar, name_ix, value) rows.

Each period is a key with its own state: the recursion and the rows of bars that aren't closed. A bar is closed
once a row ``lateness`` or more bars later has come, or its event-time timeout passes; rows of closed bars are
late and dropped. A row without a name only tells that a bar has come. Bars go through the same step as in batch,
so a replayed stream gives the batch scores of all bars, whatever the cut into micro-batches.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.matrix import RidgeMap, centre, ou_score, rms_shape
from ..session import prepare

SCORES = "period int, bar bigint, name_ix int, score double"


class RecursiveMap:
    """Mean of exponentially weighted ridge maps over some half-lives."""

    def __init__(self, half_lives: tuple[float, ...] = (120.0, 600.0, 3000.0), limit: float = 4.0):
        self.half_lives, self.limit = half_lives, limit
        self.maps: list[RidgeMap] | None = None

    def step(self, row: np.ndarray) -> np.ndarray:
        x = centre(rms_shape(row[None, :], self.limit))[0]
        if self.maps is None:
            self.maps = [RidgeMap(len(x), h) for h in self.half_lives]
        out = sum(m.step(x) for m in self.maps) / len(self.maps)
        return out - out.mean()


class RunningMean:
    """Bias-corrected exponentially weighted mean of each name."""

    def __init__(self, span: float):
        self.keep, self.total, self.mass = 1 - 2 / (span + 1), 0.0, 0.0

    def step(self, row: np.ndarray) -> np.ndarray:
        self.total = self.keep * self.total + row
        self.mass = self.keep * self.mass + 1
        return self.total / self.mass


class FactorDistance:
    """Distance of factor residuals from their mean over the rows before; keeps the last ``w`` rows."""

    def __init__(self, w: int = 60, factors: int = 3):
        self.w, self.factors, self.rows = w, factors, []

    def step(self, row: np.ndarray) -> np.ndarray:
        out = np.zeros(len(row))
        if len(self.rows) == self.w:
            out = ou_score(np.vstack([*self.rows, row]), self.w, self.factors)[-1]
        self.rows = [*self.rows, row][-self.w :]
        return out


def _folder(make: Callable[[], object], lateness: int, patience_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold, closed, waiting, names = pickle.loads(state.get[0]) if state.exists else (make(), None, {}, None)
        newest = None
        for pdf in batches:
            for bar, name, value, ts in zip(pdf["bar"], pdf["name_ix"], pdf["value"], pdf["ts"]):
                if closed is None or bar > closed:
                    cells = waiting.setdefault(int(bar), {})
                    if not pd.isna(name):
                        cells[int(name)] = 0.0 if pd.isna(value) else float(value)
                newest = ts if newest is None else max(newest, ts)
        due = sorted(waiting)
        if not state.hasTimedOut and due:
            due = [b for b in due if b <= due[-1] - lateness]
        rows = []
        for bar in due:
            got = waiting.pop(bar)
            if not got:
                continue
            # names are fixed by the first bar; later ones are unknown to the state, missing ones count as 0
            names = sorted(got) if names is None else names
            score = fold.step(np.array([got.get(n, 0.0) for n in names]))
            rows += [(key[0], bar, n, float(s)) for n, s in zip(names, score)]
            closed = bar
        state.update((pickle.dumps((fold, closed, waiting, names)),))
        if waiting and newest is not None:
            until = int(pd.Timestamp(newest).timestamp() * 1000) + patience_ms
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["period", "bar", "name_ix", "score"])

    return run


def stateful_scores(stream: DataFrame, make: Callable[[], object], lateness: int = 1, watermark: str = "1 hour", patience_ms: int = 3_600_000) -> DataFrame:
    """Scores of a stream with columns (period, bar, name_ix, value, ts)."""
    prepare(stream.sparkSession)
    rows = stream.select("period", "bar", "name_ix", "value", "ts").withWatermark("ts", watermark)
    return rows.groupBy("period").applyInPandasWithState(
        _folder(make, lateness, patience_ms), SCORES, "blob binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def bar_events(stream: DataFrame, period_bars: int = 240) -> DataFrame:
    """Hourly rows of an ``events`` stream: value summed by hour and event type, kept to the watermark."""
    hour = F.window(F.col("ts").cast("timestamp"), "1 hour")
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours")
    sums = rows.groupBy(hour.alias("w"), F.pmod(F.crc32(F.col("event_type").cast("binary")), F.lit(1000)).cast("int").alias("name_ix"))
    out = sums.agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"), F.count(F.lit(1)).alias("n"))
    bar = F.floor(F.unix_timestamp("w.start") / 3600).cast("bigint")
    return out.select(F.floor(bar / period_bars).cast("int").alias("period"), bar.alias("bar"), "name_ix", (F.col("cents") / 100).alias("value"), "n", F.col("w.start").alias("ts"))


def replay(spark: SparkSession, rows: DataFrame, folder: str, make: Callable[[], object], files: int = 4, lateness: int = 1) -> DataFrame:
    """Write bars as ``files`` files in order, stream them one a micro-batch, return all scores. The last file
    has a row without a name after the last bar of each period, which closes it.

    For tests and demonstrations: the table is put in order in one task.
    """
    cut = F.ntile(files).over(Window.orderBy("bar"))
    parts = rows.withColumn("part", cut).persist()
    for i in range(1, files + 1):
        parts.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    ends = rows.groupBy("period").agg((F.max("bar") + lateness).alias("bar"), (F.max("ts") + F.expr("interval 1 hour")).alias("ts"))
    kinds = dict(rows.dtypes)
    ends = ends.select(*[(F.col(c) if c in ends.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in rows.columns])
    ends.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = (
        stateful_scores(source, make, lateness)
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    parts.unpersist()
    return spark.read.schema(SCORES).parquet(f"{folder}/out")
