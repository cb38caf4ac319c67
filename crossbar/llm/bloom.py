"""A blocked Bloom filter as a small table: one 64-bit word a block, built and probed by Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words at most: 2**20 rows of 16 bytes are safe to broadcast whatever the number of keys.
MOST_BLOCKS = 1 << 20
KEYS_PER_BLOCK = 4


def block_count(keys: int) -> int:
    """Blocks for so many keys, 16 bits a key; beyond the bound the filter passes more, never less."""
    return min(MOST_BLOCKS, max(1, -(-keys // KEYS_PER_BLOCK)))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def mask_of(key: Column) -> Column:
    """Four bits of the key's word; 0 never, null for a null key."""
    h = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return F.when(key.isNotNull(), out)


def build(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(bloom_block, bloom_bits) of all keys; at most ``blocks`` rows."""
    k = F.col(key)
    return keys.where(k.isNotNull()).groupBy(block_of(k, blocks).alias("bloom_block")).agg(F.bit_or(mask_of(k)).alias("bloom_bits"))


def possible(df: DataFrame, key: Column, words: DataFrame, blocks: int, flag: str) -> DataFrame:
    """``df`` with a boolean: may the key be in the filter. No row is lost or added."""
    block, bits = f"{flag}_block", f"{flag}_bits"
    small = F.broadcast(words.select(F.col("bloom_block").alias(block), F.col("bloom_bits").alias(bits)))
    mask = mask_of(key)
    joined = df.join(small, block_of(key, blocks) == F.col(block), "left")
    return joined.withColumn(flag, F.coalesce(F.col(bits).bitwiseAND(mask) == mask, F.lit(False))).drop(block, bits)
