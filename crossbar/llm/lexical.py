"""Operator 12: ranked lexical search as a blocked sparse matrix product.

A is the matrix of items by terms (how often a term stands in an item), B that of terms by documents (64-bit integer
impacts). C = A B is made block by block: a task turns some megabytes of documents into rows of B, one a term, and
merges for each item the rows of its terms (Gustavson's order) into one dense row of sums, of which the k best stay.

    count    one scan: number of documents and terms, and in how many documents each term of the items stands
    product  one scan: k rows an item and block at most
    reduce   the k best of an item over parts of its blocks, then over the parts

Only terms of the items are counted, so what reaches the driver is bounded by them. Items come in pages of bounded
size (``page_bytes``); every page is a product of its own. No text is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents_view, materialize, prepare

#: Bytes of the items of one page, and of the documents of one block, about; parts that an item's blocks are dealt to.
PAGE_BYTES, BLOCK_BYTES, PARTS = 8 << 20, 16 << 20, 64
_BREAKS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Breaks as spaces and A-Z in lower case; bytes of characters beyond ASCII belong to terms.
_TABLE = bytes(0x20 if b in _BREAKS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_FOUND = "item int, doc_id bigint, score bigint, part int"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in order, repeats included."""
    return text.translate(_TABLE).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, terms: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """Impact of a term that stands tf times in a document of so many terms."""
    m = 75 + (25 * terms * documents) // all_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())


def _counts(vocabulary: dict[bytes, int]):
    """(term, n): documents that hold the term; -1 counts documents with any term, -2 all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, documents, total = vocabulary.keys(), Counter(), 0, 0
        for _, raw in _texts(batches):
            words = terms_of(raw)
            documents, total = documents + bool(words), total + len(words)
            df.update(known & set(words))
        rows = [(-1, documents), (-2, total), *((vocabulary[w], c) for w, c in df.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "n"])

    return run


class Block:
    """Rows of B for some documents: for each term the documents that hold it, and how often."""

    def __init__(self):
        self.ids, self.sizes, self.terms, self.tf, self.held, self.bytes = [], [], [], [], [], 0

    def add(self, doc_id: int | None, raw: bytes, vocabulary: dict[bytes, int]) -> None:
        words = terms_of(raw)
        found = [t for t in map(vocabulary.get, words) if t is not None]
        self.bytes += len(raw) + 64
        if found:
            terms, tf = np.unique(np.array(found, np.int32), return_counts=True)
            self.terms.append(terms)
            self.tf.append(tf)
            self.held.append(len(terms))
            self.ids.append(doc_id)
            self.sizes.append(len(words))

    def product(self, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, all_terms: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, numbers of its best documents, their scores) of each item that scores above 0 anywhere."""
        if not self.ids:
            return
        terms, tf = np.concatenate(self.terms), np.concatenate(self.tf).astype(np.int64)
        docs = np.repeat(np.arange(len(self.ids)), self.held)
        value = weights[terms] * impacts(tf, np.array(self.sizes, np.int64)[docs], documents, all_terms)
        order = np.argsort(terms, kind="stable")
        docs, value = docs[order], value[order]
        start = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        # places in ascending order of doc_id, null last: ties fall by them
        place = np.empty(len(self.ids), np.int64)
        place[sorted(range(len(self.ids)), key=lambda d: (self.ids[d] is None, self.ids[d] or 0))] = np.arange(len(self.ids))
        for number, (own, times) in enumerate(items):
            row = np.zeros(len(self.ids), np.int64)
            for t, n in zip(own.tolist(), times.tolist()):
                a, b = start[t], start[t + 1]
                row[docs[a:b]] += n * value[a:b]  # a document stands once in a term's row
            hit = np.flatnonzero(row > 0)
            if len(hit) > k:
                hit = hit[row[hit] >= np.partition(row[hit], len(hit) - k)[len(hit) - k]]
            best = hit[np.lexsort((place[hit], -row[hit]))][:k]
            if len(best):
                yield number, best, row[best]


def _best(vocabulary: dict[bytes, int], items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, all_terms: int, k: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(block: Block) -> pa.RecordBatch:
            item, ids, scores = [], [], []
            for number, best, score in block.product(items, weights, documents, all_terms, k):
                item += [number] * len(best)
                ids += [block.ids[d] for d in best]
                scores += score.tolist()
            part = [(hash(i) if i is not None else 0) % PARTS for i in ids]
            return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64()), pa.array(part, pa.int32())], names=["item", "doc_id", "score", "part"])

        block = Block()
        for doc_id, raw in _texts(batches):
            block.add(doc_id, raw, vocabulary)
            if block.bytes >= block_bytes:
                yield rows(block)
                block = Block()
        yield rows(block)

    return run


def _top(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _page(docs: DataFrame, page: list, k: int, block_bytes: int) -> DataFrame:
    """The product for the items of a page, rows of (item_id, text)."""
    spark = docs.sparkSession
    words = [terms_of((r["text"] or "").encode()) for r in page]
    vocabulary = {w: t for t, w in enumerate(sorted({w for ws in words for w in ws}))}
    counted = docs.mapInArrow(_counts(vocabulary), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r["term"]: r["n"] for r in counted.collect()}  # one row a term of the page
    documents, all_terms = df.get(-1, 0), df.get(-2, 0)
    weights = np.array([weight(documents, df.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    items = [np.unique(np.array([vocabulary[w] for w in ws], np.int32), return_counts=True) for ws in words]
    found = docs.mapInArrow(_best(vocabulary, items, weights, documents, all_terms, k, block_bytes), _FOUND)
    names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(page)], "item int, item_id bigint")
    best = _top(_top(found, k, "item", "part").drop("rank"), k, "item")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, page_bytes: int = PAGE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of each item that score highest, equal scores by doc_id.

    Defined cases: null texts have no terms; items without terms, or whose terms stand in no document, give no rows;
    every row of ``items`` is an item of its own, so a repeated item_id has several lists; every row of ``docs`` is a
    document, repeated doc_ids too; a null doc_id comes last among equal scores; an item longer than ``page_bytes``
    has a page to itself; empty tables give no rows; other columns are never read.
    """
    spark = prepare(docs.sparkSession)
    texts = documents_view(docs)
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    pages = -(-(asked.agg(F.sum(size)).first()[0] or 0) // page_bytes)
    if pages > 1:
        asked = materialize(asked.withColumn("row", F.monotonically_increasing_id()), "items")
        asked = asked.withColumn("page", F.pmod(F.xxhash64("row"), F.lit(pages)))
    found = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for p in range(pages):
        page = (asked.where(F.col("page") == p) if pages > 1 else asked).collect()  # about page_bytes
        if page:
            one = _page(texts, page, k, block_bytes)
            found = one if pages == 1 else found.unionByName(materialize(one, "page"))
    return found
