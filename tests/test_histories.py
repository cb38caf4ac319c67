"""Streams with typed state a name: any cuts and restarts give the scores of one pass over each history."""

import random

import pytest
from pyspark.sql import functions as F

from crossbar.streaming import histories

HALF, W, IDLE = 3_000_000, 4, 20_000_000


def by_hand(rows):
    out = []
    for name in {r[0] for r in rows}:
        seen = []
        for _, id_, at, value in sorted((r for r in set(rows) if r[0] == name), key=lambda r: (r[2], r[1])):
            if seen and at - seen[-1][0] > IDLE:
                seen = []
            seen.append((at, value))
            weighed = [(0.5 ** ((at - a) / HALF), v) for a, v in seen if v is not None]
            mean = sum(k * v for k, v in weighed) / sum(k for k, _ in weighed) if weighed else None
            below = None if value is None else sum(v is not None and v < value for _, v in seen[-W:])
            out.append((name, id_, at, len(seen), None if mean is None else round(mean, 6), below))
    return sorted(out)


def table(spark, rows):
    df = spark.createDataFrame(rows, "name bigint, id bigint, at bigint, value double")
    return df.select("name", "id", F.timestamp_micros("at").alias("ts"), "value", F.lit("x").alias("mean"))


def drawn(n, names):
    draw = random.Random(5)
    rows = [(draw.randrange(names), i, draw.randrange(500_000, 60_000_000) // 500_000 * 500_000 + draw.randrange(2), draw.choice([None, 1.0, 2.5, -3.0, 7.0])) for i in range(n)]
    return [*rows, rows[0], (7, 10_000, 1_000, 1.0), (7, 10_001, 50_000_000, 2.0)]


@pytest.mark.parametrize("parts", [1, 3])
def test_restarted_streams_give_the_scores_of_one_pass(spark, tmp_path, parts):
    rows = drawn(150, 4)
    found = histories.replay(spark, table(spark, rows), str(tmp_path / "s"), HALF, W, IDLE, parts)
    got = [(r["name"], r["id"], r["at"], r["n"], None if r["mean"] is None else round(r["mean"], 6), r["below"]) for r in found.collect()]
    assert sorted(got) == by_hand(rows)


def test_names_of_a_group_share_calls_and_frames(spark, tmp_path, monkeypatch):
    """A call a group, not a name: names of one group settle in one frame, with the scores of histories on their own."""
    rows = drawn(300, 40)
    monkeypatch.setattr(histories, "FEWEST", 3)
    found = histories.replay(spark, table(spark, rows), str(tmp_path / "g"), HALF, W, IDLE, 2)
    got = [(r["name"], r["id"], r["at"], r["n"], None if r["mean"] is None else round(r["mean"], 6), r["below"]) for r in found.collect()]
    assert sorted(got) == by_hand(rows)
    state = spark.read.format("statestore").option("stateVarName", "names").load(str(tmp_path / "g" / "checkpoint"))
    assert state.count() <= 3


def test_rows_that_say_nothing(spark, tmp_path):
    assert histories.replay(spark, table(spark, []), str(tmp_path / "none"), HALF, W, IDLE).count() == 0
    odd = table(spark, [(None, 1, 5, 1.0), (1, None, 6, 2.0), (1, 2, None, 3.0), (1, 3, 7, None)])
    found = histories.replay(spark, odd, str(tmp_path / "odd"), HALF, W, IDLE, 1).collect()
    assert [tuple(r) for r in found] == [(1, 3, 7, 1, None, None)]


def test_late_rows_go_and_state_ends(spark, tmp_path):
    live = spark.newSession()
    live.conf.set("spark.sql.streaming.stateStore.providerClass", histories.ROCKS)
    late = [(n, 900 + n, 1_000_000, 99.0) for n in range(3)]
    steps = [[(n, n, 1_000_000 * (n % 5 + 1), 1.0) for n in range(40)], [(100, 500, 15_000_000, 1.0)], late, [(100, 501, 60_000_000, 2.0)], [(100, 502, 61_000_000, 2.0)]]
    kept, folder = [], str(tmp_path / "late")
    for rows in steps:
        table(spark, rows).write.mode("append").parquet(f"{folder}/in")
        source = live.readStream.schema(table(spark, rows).schema).parquet(f"{folder}/in")
        query = histories.history_scores(source, HALF, W, IDLE, "1 second").writeStream.format("parquet").option("path", f"{folder}/out")
        query = query.option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = spark.read.schema(histories.SCORES).parquet(f"{folder}/out").collect()
    assert sorted(r["id"] for r in got) == [*range(40), 500, 501] and {r["mean"] for r in got} == {1.0, 2.0}
    # forty names are held while they may go on, and none of them once idle has passed
    assert kept[1] >= 40 and kept[-1] < 10


def test_the_state_store_is_asked_for(spark, tmp_path):
    table(spark, [(1, 1, 1, 1.0)]).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(table(spark, []).schema).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="RocksDB"):
        histories.history_scores(source, HALF, W, IDLE)
