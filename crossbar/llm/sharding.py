"""Operator 6: sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of slots; each shard owns the slots before its virtual nodes. A document
goes to the shard of its slot while that has room; what overflows continues clockwise to the next
virtual node whose shard has room. How many documents of a slot go where depends only on the slots'
counts, a table of fixed size, so the walk round the ring is done once on the driver and the documents
are placed by a join on slot and rank. DataFrame operations only.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

SLOT_BITS = 14
SLOTS = 1 << SLOT_BITS
VIRTUAL_NODES = 64
#: A slot with more than one in so many rows is hot; its rows are ordered in parts, by so many bits of their order.
HOT_SHARE, PART_BITS = 512, 10
#: Equal rows that one input row is spread to at most.
RUN = 10_000


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[int]:
    """The shard that owns each slot: that of the first virtual node at or after it."""
    nodes: dict[int, tuple[int, int]] = {}
    for shard in range(shards):
        for v in range(virtual_nodes):
            digest = hashlib.sha256(f"shard {shard} node {v}".encode()).digest()
            at, order = int.from_bytes(digest[:4], "big") % SLOTS, int.from_bytes(digest[4:8], "big")
            nodes[at] = min(nodes.get(at, (order, shard)), (order, shard))
    owner, current = [0] * SLOTS, nodes[min(nodes)][1]
    for slot in range(SLOTS - 1, -1, -1):
        current = nodes[slot][1] if slot in nodes else current
        owner[slot] = current
    return owner


def capacities(owner: list[int], counts: list[int], shards: int, slack: float) -> list[int]:
    """Rows that each shard may hold. Without slack they are at most one apart and add up to all rows;
    the shards with the greatest demand take the odd ones."""
    total, demand = sum(counts), [0] * shards
    for slot, n in enumerate(counts):
        demand[owner[slot]] += n
    if slack > 0:
        return [int(-(-total * (1 + slack) // shards))] * shards
    odd = set(sorted(range(shards), key=lambda s: (-demand[s], s))[: total % shards])
    return [total // shards + (s in odd) for s in range(shards)]


def walk(counts: list[int], shards: int, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES) -> list[dict]:
    """Segments (ring_slot, first, last, shard, base, home): ranks first..last of a slot go to ``shard``
    and take its places from ``base`` on."""
    owner = ring(shards, virtual_nodes)
    room = capacities(owner, counts, shards, slack)
    used, segments, over = [0] * shards, [], []

    def put(slot: int, first: int, n: int, shard: int) -> None:
        segments.append({"ring_slot": slot, "first": first, "last": first + n - 1, "shard": shard, "base": used[shard], "home": owner[slot]})
        used[shard] += n

    for slot, n in enumerate(counts):
        stay = min(n, room[owner[slot]] - used[owner[slot]])
        if stay:
            put(slot, 0, stay, owner[slot])
        if n > stay:
            over.append((slot, stay, n - stay))
    for slot, first, n in over:
        at = slot
        while n:
            at = (at + 1) % SLOTS
            take = min(n, room[owner[at]] - used[owner[at]])
            if take > 0:
                put(slot, first, take, owner[at])
                first, n = first + take, n - take
    return segments


def shard_documents(docs: DataFrame, shards: int = 16, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard of every row.

    With ``slack`` 0 the law is ``rows``: counts at most one apart. Only overflowing rows leave their
    home shard, so a change in the number of shards moves few rows.

    The order of a slot's rows is that of a hash of doc_id, checksum and size, whatever the size of the slot and wherever
    the rows come from: equal tables have equal shards. Rows that are equal in all three are counted, placed together
    and spread again, since they are interchangeable.

    Defined cases: a null text has size 1 and the checksum of no bytes; repeated rows each get a place; null doc_ids
    share one slot; an empty table gives no rows; other columns are never read.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("bigint")).alias("text_crc32"),
    ).withColumn("ring_slot", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - SLOT_BITS).cast("int"))
    counts = [0] * SLOTS
    for row in rows.groupBy("ring_slot").count().collect():  # at most SLOTS rows
        counts[row["ring_slot"]] = row["count"]
    kind = "array<struct<ring_slot:int,first:bigint,last:bigint,shard:int,base:bigint,home:int>>"
    text = json.dumps(walk(counts, shards, slack, virtual_nodes), separators=(",", ":"))
    segments = spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))
    hot = [slot for slot, n in enumerate(counts) if n > max(1, sum(counts) // HOT_SHARE)]  # at most HOT_SHARE slots
    keys = ["ring_slot", "doc_id", "text_crc32", "size"]
    same = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("mix", F.xxhash64("doc_id", "text_crc32", "size"))
    part = F.when(F.col("ring_slot").isin(hot), F.shiftright("mix", 64 - PART_BITS)).otherwise(0).cast("int")
    same = same.withColumn("part", part)
    before = Window.partitionBy("ring_slot", "part").orderBy("mix", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = same.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)))
    if hot:
        earlier = Window.partitionBy("ring_slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = same.where(F.col("ring_slot").isin(hot)).groupBy("ring_slot", "part").agg(F.sum("n").alias("n"))
        parts = parts.select("ring_slot", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
        # at most HOT_SHARE << PART_BITS rows
        placed = placed.join(F.broadcast(parts), ["ring_slot", "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("ahead", F.lit(0)))
    placed = placed.join(F.broadcast(segments), "ring_slot").where("rank <= last and rank + n > first")
    cut = placed.withColumns({"from": F.greatest("rank", "first"), "to": F.least(F.col("rank") + F.col("n") - 1, "last")})
    few = cut.where(F.col("to") - F.col("from") < RUN)
    many = cut.where(F.col("to") - F.col("from") >= RUN).withColumn("from", F.explode(F.sequence("from", "to", F.lit(RUN))))
    many = many.withColumn("to", F.least("to", F.col("from") + RUN - 1)).repartition("shard", "from")
    spread = few.unionByName(many).withColumn("at", F.explode(F.sequence("from", "to")))
    return spread.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows" if slack <= 0 else "bounded").alias("law"),
        "shard",
        (F.col("base") + F.col("at") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("home").alias("home_shard"),
    )
