"""Scores of single histories in a stream: typed state a name, settled by the watermark.

Names are dealt by hash into groups, the keys of the state, so tasks and stores divide by group and a checkpoint holds a
few numbers a name: sums that decay and the last ``w`` values (arrays of a number a name), and the rows that aren't settled
(a list, a block of a batch each). Calls and frames are made for a group, since those of a single name take longer than
its rows. A row is settled once
the watermark has passed its time; rows settle in the order of (time, id), so the scores are those of one window over
the whole history, whatever the micro-batches, restarts, and disorder within the watermark. Rows behind it are dropped.

A gap longer than ``idle`` begins a history anew. It also lets the state of a name that has ended go: the store grows
with the names of the last ``idle`` only, and whether a timer or a later row ends a history makes no difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import BATCH_ROWS, prepare

SCORES = "name bigint, id bigint, at bigint, n bigint, mean double, below int"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: An hour of watermark, and two milliseconds since a watermark has no parts of one.
_END = 3_600_002_000
#: State of a name without settled rows.
_NEW = (0, 0.0, 0.0, None, [])
#: Groups of names of a stream, and of a table that is replayed: these at least, and one for so many rows.
GROUPS, FEWEST, ROWS = 1 << 12, 1 << 8, 1 << 12


def _timer(at: int) -> int:
    """First millisecond that isn't before a time in microseconds."""
    return -(-at // 1000)


class Histories(StatefulProcessor):
    """Decaying mean and standing among the last values, of each name of a group; times in microseconds."""

    def __init__(self, half_life: int, w: int, idle: int):
        self.half_life, self.w, self.idle = half_life, w, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = "array<bigint>, n array<bigint>, total array<double>, mass array<double>, last array<bigint>, recent array<array<double>>"
        self.names = handle.getValueState("names", f"name {kinds}")
        self.pending = handle.getListState("pending", "name array<bigint>, at array<bigint>, id array<bigint>, value array<double>")
        self.timer = handle.getValueState("timer", "due bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for pdf in rows:
            new = pdf[pdf["known"]]
            if len(new):
                value = [None if v != v else v for v in new["value"].astype(float).tolist()]
                self.pending.appendValue((*(new[c].tolist() for c in ("name", "at", "id")), value))
                first.append(int(new["at"].min()))
        if first:
            self._wake(_timer(min(first)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        rows = {row[:3]: row for chunk in self.pending.get() for row in zip(*chunk)}
        due, rest = {}, []
        for row in map(rows.get, sorted(rows)):
            (due.setdefault(row[0], []) if row[1] <= passed else rest).append(row)
        held = {name: state for name, *state in zip(*(self.names.get() or ()))}
        out = []
        for name, own in due.items():
            held[name] = self._settle(held.get(name, _NEW), own, out)
        held = {name: state for name, state in held.items() if state[3] + self.idle + 1 > passed}
        if held:
            self.names.update(tuple(map(list, zip(*((name, *state) for name, state in held.items())))))
        else:
            self.names.clear()
        if rest:
            self.pending.put([tuple(map(list, zip(*rest[a : a + BATCH_ROWS]))) for a in range(0, len(rest), BATCH_ROWS)])
        elif rows:
            self.pending.clear()
        if held or rest:
            self._wake(_timer(min([r[1] for r in rest] + [state[3] + self.idle + 1 for state in held.values()])))
        if out:
            name, id_, at, n, mean, below = zip(*out)
            found = {"name": name, "id": id_, "at": at, "n": n, "mean": np.array(mean, float), "below": pd.array(below, "Int32")}
            yield pd.DataFrame(found)

    def _wake(self, due: int) -> None:
        """One timer a group, the earliest."""
        before = self.timer.get()
        if before is not None:
            if before[0] <= due:
                return
            self.handle.deleteTimer(before[0])
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def _settle(self, state: tuple, due: list[tuple[int, int, int, float | None]], out: list[tuple]) -> tuple:
        """State of a name after its rows, whose scores go to ``out``."""
        n, total, mass, last, recent = state
        for name, at, id_, value in due:
            if last is not None and at - last > self.idle:
                n, total, mass, recent = 0, 0.0, 0.0, []
            keep = 1.0 if last is None else 0.5 ** ((at - last) / self.half_life)
            n, total, mass, last = n + 1, total * keep, mass * keep, at
            if value is not None:
                total, mass = total + value, mass + 1.0
            recent = [*recent, value][-self.w :]
            below = None if value is None else sum(v is not None and v < value for v in recent)
            out.append((name, id_, at, n, total / mass if mass else None, below))
        return n, total, mass, last, recent

    def close(self) -> None:
        pass


def history_scores(stream: DataFrame, half_life: int, w: int, idle: int, watermark: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """name, id, at, n, mean, below for a stream of (name, id, ts, value).

    ``n`` counts the history's rows so far, ``mean`` weighs its values by half for every ``half_life`` microseconds of
    age, ``below`` counts the smaller ones of the last ``w`` rows. Null values count as rows only, and have no ``below``;
    a mean of none is null. Rows without an id only tell the time; rows without a name or time are left out; of rows
    with equal name, time and id one counts. Times up to 1970 are behind the first watermark. The state store has to be
    RocksDB. The number of ``groups`` belongs to a checkpoint and must stay; a group's work should fit a task with ease.
    """
    spark = prepare(stream.sparkSession)
    if not spark.conf.get(_PROVIDER).endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"{_PROVIDER} must be {ROCKS}")
    rows = stream.where("name is not null and ts is not null").withWatermark("ts", watermark)
    known = [F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("known")]  # without nulls ids stay whole numbers
    rows = rows.select(F.pmod(F.xxhash64("name"), F.lit(groups)).alias("part"), "name", *known, F.unix_micros("ts").alias("at"), "value", "ts")
    return rows.groupBy("part").transformWithStateInPandas(
        Histories(half_life, w, idle), outputStructType=SCORES, outputMode="Append", timeMode="EventTime"
    )


def replay(spark: SparkSession, rows: DataFrame, folder: str, half_life: int, w: int, idle: int, parts: int = 2) -> DataFrame:
    """Scores of a table streamed by ``parts`` ranges of time. After each the query ends; the next starts from its
    checkpoint. A last row without an id lets all others settle."""
    live = spark.newSession()
    live.conf.set(_PROVIDER, ROCKS)
    cuts, end, n = rows.agg(F.percentile_approx(F.unix_micros("ts"), [k / parts for k in range(1, parts)] or [1.0]), F.max(F.unix_micros("ts")), F.count(F.lit(1))).first()
    if end is None:
        return spark.createDataFrame([], SCORES)
    bounds = [None, *sorted(set(cuts))[: parts - 1], None]
    at = F.unix_micros("ts")
    for low, high in zip(bounds, bounds[1:]):
        here = rows.where((at > low if low is not None else F.lit(True)) & (at <= high if high is not None else F.lit(True)))
        here.write.mode("append").parquet(f"{folder}/in")
        if high is None:
            tick = spark.range(1).select(*[
                {"name": F.lit(-1), "ts": F.timestamp_micros(F.lit(end + _END))}.get(c, F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes
            ])
            tick.write.mode("append").parquet(f"{folder}/in")
        source = live.readStream.schema(rows.schema).parquet(f"{folder}/in")
        query = history_scores(source, half_life, w, idle, groups=max(FEWEST, n // ROWS)).writeStream.format("parquet").option("path", f"{folder}/out")
        query.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(SCORES).parquet(f"{folder}/out")
