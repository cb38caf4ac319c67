"""Operator 7: URL filter. A blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash
join, which removes the false positives. DataFrame operations only; only the url is read.

A listed URL is a host with a path prefix. It fits a page's url if the host is the listed one or one of
its subdomains and the path starts with the listed path. Whatever is listed, there are two lookups:

1. a url's host and the domains above it (as many labels as the longest listed host) against the listed hosts,
   each of which knows how long its listed paths are;
2. for each host found, the path's beginnings of those lengths, as canonical URLs, against the list.

Before each join stands a Bloom filter, so most rows are never joined or moved; the longest rule of a url is one
aggregate over its hits.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import join_spread, materialize, prepare

#: The rules of the contract (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Listed rows up to which the joins broadcast the list; a longer list is shuffled, hot hosts apart.
BROADCAST_ROWS = 100_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a DataFrame (verdict, rule_host, rule_path)."""
    quoted = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t(verdict, rule_host, rule_path)")


def _key(host, path):
    return F.concat(host, F.lit("\n"), path)


def _listed(rows: DataFrame, key: str, table: DataFrame, small: bool) -> DataFrame:
    """Rows whose key is in the table (of unique keys), with its columns: a Bloom filter, then an exact join."""
    blocks = bloom.block_count(table.count())
    likely = bloom.possible(rows, F.col(key), bloom.build(table, key, blocks), blocks, "__maybe").where("__maybe").drop("__maybe")
    if small:
        return likely.join(F.broadcast(table), key)
    likely = materialize(likely, "likely-urls")
    return join_spread(likely, table, key, max(1, likely.count()))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every row.

    The longest rule that fits wins (host and path together); of repeated rules the lesser verdict
    counts. Defined cases: a null url or one without ``://`` has empty host and path and the default
    verdict; repeated rows each get their row; an empty table or an empty list works; other columns are
    never read.
    """
    prepare(pages.sparkSession)
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = pages.select(
        "page_id",
        F.translate(F.regexp_extract(url, _PARTS, 1), string.ascii_uppercase, string.ascii_lowercase).alias("host"),
        F.regexp_extract(url, _PARTS, 2).alias("path"),
    )
    # written once, so that the number of a row is the same wherever it is read
    parts = materialize(parts.withColumn("row", F.monotonically_increasing_id()), "urls")
    listed = rules.groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("rule_verdict"))
    listed = materialize(listed, "listed-urls")
    small = listed.count() <= BROADCAST_ROWS
    hosts = listed.groupBy(F.col("rule_host").alias("domain")).agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    most = listed.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    canonical = listed.select(
        _key(F.col("rule_host"), F.col("rule_path")).alias("key"),
        F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")).alias("hit"),
    )
    labels = F.least(F.size(F.split("host", r"\.")), F.lit(most))
    above = F.when(labels > 0, F.transform(F.sequence(F.lit(1), labels), lambda k: F.call_function("substring_index", "host", F.lit("."), -k)))
    domains = parts.select("row", "path", F.explode(above).alias("domain"))
    known = _listed(domains, "domain", hosts, small)
    begun = known.select("row", F.explode("lengths").alias("length"), "domain", "path").where(F.length("path") >= F.col("length"))
    begun = begun.select("row", _key(F.col("domain"), F.call_function("substring", "path", F.lit(1), F.col("length"))).alias("key"))
    best = _listed(begun, "key", canonical, small).groupBy("row").agg(F.max("hit").alias("best"))
    judged = parts.join(best, "row", "left")
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")
    )
