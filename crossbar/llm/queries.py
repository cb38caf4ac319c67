"""The queries of the training-data operators and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .annulus import cluster_vectors
from .bpe import bpe_roundtrip
from .common import load
from .exact_dedup import exact_dedup
from .lexical import search
from .license_scan import BASE, SHARE, TEMPLATES, needed, scan_licenses
from .packing import pack_documents
from .sharding import shard_documents
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .token_store import token_store
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import judge_urls, rule_table
from .vptree import nearest


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(load(spark, sf_dir, "documents"))


def op3_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(load(spark, sf_dir, "documents"))
    return found.drop("places")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, load(spark, sf_dir, "labels")))


def op6_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(load(spark, sf_dir, "documents"), shards=16)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages"), rule_table(spark))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_roundtrip(load(spark, sf_dir, "documents"))


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(load(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_packing,
        op2_token_store,
        op3_vantage_point,
        op4_license_scan,
        op5_toxicity,
        op6_ring_sharding,
        op7_url_filter,
        op8_simhash,
        op9_exact_dedup,
        op10_bpe,
        op11_annulus_clusters,
        op12_lexical_search,
        op13_suffix_dedup,
    )
}


def _license_sql() -> str:
    """Every place of every phrase by trying all positions; the index only makes this quick."""
    words = lambda t: "[" + ", ".join(f"'{w}'" for w in t.split()) + "]"
    rows = [f"('{label}', {words(phrase)}, {words(phrase)}, 0, true, 0)" for phrase, label in BASE]
    for label, notice, key in TEMPLATES:
        at = len(notice[: notice.index(key)].split())
        rows.append(f"('{label}', {words(key)}, {words(notice)}, {at}, false, {needed(notice.split(), SHARE)})")
    return rf"""
        WITH w AS (
            SELECT row_number() OVER () AS r, doc_id,
                   list_filter(string_split_regex(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
            FROM documents),
        p(label, phrase, notice, skip, base, needed) AS (VALUES {", ".join(rows)}),
        f AS (
            SELECT r, label, base, skip, notice, needed, words,
                   unnest(list_filter(range(0, len(words) - len(phrase) + 1), lambda i: words[i + 1:i + len(phrase)] = phrase)) AS s
            FROM w, p WHERE list_has_all(words, phrase)),
        c AS (
            SELECT r, label, base, s, needed, len(notice) AS size,
                   CASE WHEN base THEN len(notice) ELSE list_sum(list_transform(range(0, len(notice)), lambda j:
                       CASE WHEN s - skip + j >= 0 AND words[s - skip + j + 1] = notice[j + 1] THEN 1 ELSE 0 END)) END AS same
            FROM f),
        g AS (SELECT r, label, base, s, same / CAST(size AS DOUBLE) AS share FROM c WHERE same >= needed),
        h AS (
            SELECT r, count(*) FILTER (base) AS n, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share
            FROM g GROUP BY r)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(share, 0.0e0) AS score
        FROM w LEFT JOIN h USING (r)"""


def _cluster_sql(clusters: int = 40, rounds: int = 5) -> str:
    """Every vector against every centroid, a CTE a round."""
    ctes = [
        """r AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS (
            SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x AS v FROM r
            QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), x) <= {clusters})""",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (
            SELECT r, vec_id, x, c, d FROM (
                SELECT r, vec_id, x, c, list_sum(list_transform(list_zip(x, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM r, c{i})
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            ctes.append(f"""s{i} AS (
                SELECT c, k, CAST(sum(x[k]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, 65) t(k) GROUP BY c, k),
            m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY k) AS v FROM s{i} GROUP BY c),
            c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))""")
    return f"""
        WITH {", ".join(ctes)}
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (c)"""


_TERMS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

ORACLE_SQL: dict[str, str] = {
    "op11_annulus_clusters": _cluster_sql(),
    "op12_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents),
        q AS (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS term FROM benchmark),
        t AS (SELECT count(*) FILTER (len(words) > 0) AS n, CAST(sum(len(words)) AS BIGINT) AS l FROM d),
        p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, t GROUP BY term),
        i AS (
            SELECT r, term, doc_id, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * len(words) * n) // l)))) AS impact
            FROM p JOIN d USING (r) JOIN w USING (term), t),
        s AS (SELECT q, item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(impact) > 0)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 20""",
    "op4_license_scan": _license_sql(),
    "op7_url_filter": r"""
        WITH parts AS (
            SELECT row_number() OVER () AS n, page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
            FROM pages),
        rules(verdict, rule_host, rule_path) AS (VALUES
            ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
            ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fits AS (
            SELECT n, rule_host || rule_path AS rule, verdict,
                   row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC) AS k
            FROM parts JOIN rules
              ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts LEFT JOIN fits ON parts.n = fits.n AND k = 1""",
    "op9_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AND row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1 AS kept,
               sha256(body) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY body)""",
}
