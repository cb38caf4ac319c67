"""Operator 9: exact deduplication by a log-structured merge index, in DataFrame operations only.

    flush    every input split is a memtable: its (digest, row) entries are sorted and written as one run, whose
             Parquet minima, maxima and Bloom filters of the digest serve lookups (``lookup``); no shuffle. Runs
             are dealt into BATCHES batches
    compact  a batch of runs merges into the next level: one entry a digest with the smallest identifier and the
             number of rows (map-side combine first). Entries of the level that a blocked Bloom filter of the batch
             passes, and entries of the batch that a filter of those passes, are merged; all others, of either
             side, are carried over as they are. So a level is made of the one before it, batch by batch
    verify   texts whose digest is shared are compared byte by byte: the least and the greatest text
             of a digest are equal exactly if all are; partial aggregation makes a hot digest cheap
    resolve  digests that turn out to hold different texts are grouped by the text itself

Texts are read twice; only those that a blocked Bloom filter of the shared digests passes are sorted
or shuffled. Everything else that moves is some 50 bytes a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import DROP_KEY, Scratch, drop_rows, materialize, prepare

#: A digest with more than this share of the rows is hot; so there are at most as many hot digests.
HOT_SHARE = 512
#: Batches of runs, and so levels: an entry is written some (BATCHES + 1) / 2 times.
BATCHES = 4
#: Files have a filter of their digests, fitted to their number (without that, a megabyte a file).
_FILTER = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
_RUN = "doc_id bigint, batch int, row bigint, digest binary, text_sha256 string, memtable int"
_LEVEL = "digest binary, keep struct<no_id:boolean,doc_id:bigint,batch:int,row:bigint>, group_size bigint"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _digested(docs: DataFrame, digest_bytes: int) -> DataFrame:
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised(F.col("text")).alias("body"))
    return text.withColumn("text_sha256", F.sha2("body", 256)).withColumn(
        "digest", F.unhex(F.substring("text_sha256", 1, 2 * digest_bytes))
    )


def _first() -> Column:
    """The row that stays: smallest doc_id, rows without one last, of repeated rows the first number."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "batch", "row"))


def _numbered(rows: DataFrame, batch: int) -> DataFrame:
    return rows.withColumns({"batch": F.lit(batch), "row": F.monotonically_increasing_id()})


def flush(docs: DataFrame, folder: str, digest_bytes: int = 32, batch: int = 0) -> DataFrame:
    """Write sorted digest runs, one for each input split; the rows are numbered there once and for all."""
    rows = _numbered(_digested(docs, digest_bytes), batch)
    # the upper bits of the number are the split's
    rows = rows.withColumn("memtable", F.pmod(F.shiftright("row", 33), F.lit(BATCHES)).cast("int"))
    rows = rows.select("doc_id", "batch", "row", "digest", "text_sha256", "memtable").sortWithinPartitions("memtable", "digest", "doc_id")
    rows.write.partitionBy("memtable").options(**_FILTER).parquet(folder)
    return docs.sparkSession.read.schema(_RUN).parquet(folder)


def _written(level: DataFrame, folder: str) -> DataFrame:
    level.write.parquet(folder)
    return level.sparkSession.read.schema(_LEVEL).parquet(folder)


def _flagged(entries: DataFrame, others: DataFrame) -> DataFrame:
    """Entries with ``maybe``: whether a filter of the others' digests passes theirs."""
    blocks = bloom.block_count(others.count())
    return bloom.possible(entries, F.col("digest"), bloom.build(others, "digest", blocks), blocks, "maybe")


def compact(runs: DataFrame, folder: str, level: DataFrame | None = None) -> DataFrame:
    """Merge runs, and the level before them if there is one, into a new level. Of equal identifiers in several
    batches that of the first stays."""
    spark = runs.sparkSession
    fresh = runs.groupBy("digest").agg(_first().alias("keep"), F.count(F.lit(1)).alias("group_size"))
    if level is not None:
        fresh = _written(fresh, f"{folder}-fresh")
        held = _flagged(level, fresh)
        met = _written(held.where("maybe").drop("maybe"), f"{folder}-met")
        new = _flagged(fresh, met)
        both = met.unionByName(new.where("maybe").drop("maybe"))
        merged = both.groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"))
        fresh = merged.unionByName(held.where("not maybe").drop("maybe")).unionByName(new.where("not maybe").drop("maybe"))
    fresh.sortWithinPartitions("digest").write.options(**_FILTER).parquet(folder)
    return spark.read.schema(_LEVEL).parquet(folder)


def lookup(table: DataFrame, digests: list[str]) -> DataFrame:
    """Entries of runs or a level for some digests (hexadecimal). The files' minima, maxima and Bloom filters rule
    out row groups that don't hold them."""
    return table.where(F.col("digest").isin([bytearray.fromhex(d) for d in digests]))


def collisions(docs: DataFrame, hits: DataFrame, n_hits: int, digest_bytes: int = 32) -> DataFrame:
    """Digests whose texts differ in any byte."""
    blocks = bloom.block_count(n_hits)
    words = bloom.build(hits, "digest", blocks)
    texts = bloom.possible(_digested(docs, digest_bytes), F.col("digest"), words, blocks, "maybe").where("maybe")
    ends = texts.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("greatest"))
    return ends.where("least <> greatest").select("digest")


def _assigned(rows: DataFrame, level: DataFrame, key: str, total: int) -> DataFrame:
    """Rows with keep and group_size; hot keys (at most HOT_SHARE) by broadcast, the rest shuffled."""
    hot = F.broadcast(level.where(F.col("group_size") > max(1, total // HOT_SHARE)).withColumn("is_hot", F.lit(True)))
    first = rows.join(hot, key, "left")
    done = first.where("is_hot").drop("is_hot")
    cold = first.where("is_hot is null").drop("is_hot", "keep", "group_size")
    rest = cold.join(level.where(F.col("group_size") <= max(1, total // HOT_SHARE)), key, "left")
    return done.unionByName(rest)


def exact_dedup(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Defined cases: null text is the empty text and equal to other empty ones; the smallest doc_id
    stays, a null doc_id only where a group has no other; of repeated rows with that doc_id exactly one
    is kept; an empty table gives no rows; other columns are never read. ``digest_bytes`` below 32
    makes collisions likely; the result is the same.
    """
    spark: SparkSession = prepare(docs.sparkSession)
    log = Scratch(spark, "digest-log")
    runs = flush(docs, f"{log.folder}/runs", digest_bytes)
    batches = sorted(r[0] for r in runs.select("memtable").distinct().collect())  # BATCHES at most
    level = None
    for k, batch in enumerate(batches or [0]):
        before, level = level, compact(runs.where(F.col("memtable") == batch), f"{log.folder}/level{k}", level)
        if before is not None:  # nothing reads what the new level was made of
            log.drop(f"level{k}-fresh", f"level{k}-met", f"level{k - 1}")
    runs, hits = runs.drop("memtable"), level.where("group_size > 1")
    total, n_hits = runs.count(), hits.count()
    found = _assigned(runs, hits, "digest", total)
    if n_hits:
        scratch = Scratch(spark, "digest-clash")
        clash = scratch.write(collisions(docs, hits, n_hits, digest_bytes), "digests")
        if not clash.isEmpty():
            plain = runs.join(clash, "digest", "left_anti")
            # numbered anew, and written so that the numbers stay
            mixed = _digested(docs, digest_bytes).join(clash, "digest", "left_semi")
            mixed = scratch.write(_numbered(mixed, 0), "texts")
            level = mixed.groupBy("body").agg(_first().alias("keep"), F.count(F.lit(1)).alias("group_size"))
            found = _assigned(plain, hits, "digest", total).unionByName(_assigned(mixed, level, "body", total).drop("body"))
    single = F.coalesce("group_size", F.lit(1)) == 1
    return found.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (single | (F.col("row") == F.col("keep.row"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each set of equal texts, all columns as they are."""
    found = materialize(exact_dedup(docs), "exact-duplicates")
    keyed = docs.withColumn(DROP_KEY, F.sha2(normalised(F.col("text")), 256))
    here = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return drop_rows(
        keyed,
        found.where(~F.col("kept") & ~here).select("doc_id", "text_sha256"),
        found.where(here).select("doc_id", "text_sha256"),
    )
