"""What the training-data operators share: table access, the shared folder, worker set-up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, shared_folder


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, read by Spark only (any file system it knows)."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; checkpoints go there too."""
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def qualified(spark: SparkSession, path: str) -> str:
    """A path as the full URI that Spark would take it for."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    return given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toString()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Named tables of one computation in a folder of the shared one. A table is dropped once nothing reads it any
    more: what was made of it is written too."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, fresh_path(spark, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan behind is dropped, the rows are in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents_view(docs: DataFrame) -> DataFrame:
    """Only what the operators read: ``doc_id`` and ``text`` with null as the empty text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: A key with more than one in so many rows is hot; so there are at most as many hot keys.
HOT_SHARE = 512


def join_spread(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of unique keys. Hot keys (at most HOT_SHARE) go by broadcast, so that the
    rows of one key are never gathered; the rest is left to the planner. ``rows`` are read more than once."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max(1, total // HOT_SHARE))
    hot = [r[0] for r in counts.select(key).collect()]
    if not hot:
        return rows.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(table.where(is_hot))
    return rows.where(is_hot).join(few, key, how).unionByName(rows.where(~is_hot).join(table, key, how))


#: Name of the text key that ``drop_rows`` expects beside doc_id.
DROP_KEY = "__text_key"


def drop_rows(docs: DataFrame, dropped: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` (with DROP_KEY) without those in ``dropped``, and one row for a key of ``kept``.

    Both have (doc_id, text key). Only rows that a bounded Bloom filter of the dropped keys passes go
    through the exact join, so the texts of the others are never shuffled.
    """
    from . import bloom

    folder = fresh_path(docs.sparkSession, "dropped")
    schema = "drop_id bigint, drop_key " + docs.schema[DROP_KEY].dataType.simpleString()
    names = ["drop_id", "drop_key"]
    dropped.toDF(*names).distinct().write.parquet(f"{folder}/keys")
    keys = docs.sparkSession.read.schema(schema).parquet(f"{folder}/keys")
    blocks = bloom.block_count(keys.count())
    same = lambda a, b: F.xxhash64(F.coalesce(a.cast("string"), F.lit("null")), b)
    words = bloom.build(keys.withColumn("k", same(F.col("drop_id"), F.col("drop_key"))), "k", blocks)
    probe = same(docs["doc_id"].cast("bigint"), docs[DROP_KEY])
    flagged = bloom.possible(docs, probe, words, blocks, "__maybe")
    sure = flagged.where("not __maybe").drop("__maybe")
    maybe = flagged.where("__maybe").drop("__maybe")
    match = maybe["doc_id"].cast("bigint").eqNullSafe(keys["drop_id"]) & (maybe[DROP_KEY] == keys["drop_key"])
    left = sure.unionByName(maybe.join(keys, match, "left_anti"))
    # keys that stay but stand in several rows: usually none
    again = kept.toDF(*names).groupBy(*names).count().where("count > 1").drop("count")
    again.write.parquet(f"{folder}/again")
    again = docs.sparkSession.read.schema(schema).parquet(f"{folder}/again")
    if not again.isEmpty():
        match = left["doc_id"].cast("bigint").eqNullSafe(again["drop_id"]) & (left[DROP_KEY] == again["drop_key"])
        once = left.join(again, match, "left_semi").dropDuplicates(["doc_id", DROP_KEY])
        left = left.join(again, match, "left_anti").unionByName(once)
    return left.drop(DROP_KEY)
