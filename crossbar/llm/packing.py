"""Operator 1: packing of documents into fixed-length training sequences.

First-fit decreasing with a tournament tree of bin capacities, run independently in randomised
groups of pieces. A group holds a bounded number of pieces whatever the size of the corpus,
so memory is bounded and the groups are packed side by side; the only loss against one global
packing is about one part-filled sequence a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_view, materialize, prepare
from .tokens import encoder, little_blocks, vocabulary_path

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


class TournamentTree:
    """Remaining room of bins in opening order; a node holds the most room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, weight: int) -> tuple[int, int]:
        """First bin with room for ``weight``; its number and the offset of the new piece."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < weight:
                node += 1
        offset = self.capacity - room[node]
        number = node - self.leaves
        room[node] -= weight
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return number, offset


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each length, which come sorted from long to short."""
    tree = TournamentTree(max(1, len(lengths)), capacity)
    return [tree.place(w) for w in lengths]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in little_blocks(texts):
                cols: list[list] = [[] for _ in range(5 + with_ids)]
                for doc, raw in zip(ids[a:b], enc.encode(texts[a:b])):
                    raw += end
                    total = len(raw) // 4
                    for start in range(0, total, capacity):
                        part = raw[4 * start : 4 * (start + capacity)]
                        row = (doc, start, len(part) // 4, zlib.crc32(part), total) + ((part,) if with_ids else ())
                        for col, value in zip(cols, row):
                            col.append(value)
                arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.binary()) for c in cols[5:]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _pack_group(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        placed = first_fit_decreasing(pdf["length"].tolist(), capacity)
        group = int(key[0])
        pdf["sequence_id"] = [(group << 32) + b for b, _ in placed]
        pdf["offset"] = [o for _, o in placed]
        return pdf.drop(columns=["pack_group"])

    return run


def pack_documents(
    docs: DataFrame,
    capacity: int = 4096,
    end_id: int = 2,
    vocabulary: str | None = None,
    group_docs: int = 8192,
    seed: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents and their places in sequences of ``capacity`` ids.

    Each document is encoded whole and closed with ``end_id``; documents longer than a sequence are
    cut every ``capacity`` ids. ``with_ids`` adds the ids of a piece (unsigned 32-bit, little-endian).
    Every piece draws its group by its row, not by its key, so no key can fill one; the draws are stored
    with the pieces, so that a task that runs again finds them unchanged.

    Defined cases: a null or empty text is the end id alone; very long texts make full pieces and one
    rest; equal lengths are placed by doc_id, then start; repeated rows are documents of their own;
    an empty table gives no rows; a null doc_id is kept; other columns are never read.
    """
    prepare(docs.sparkSession)
    path = vocabulary or vocabulary_path()
    schema = PIECES + (", ids binary" if with_ids else "")
    pieces = documents_view(docs).mapInArrow(_pieces(path, capacity, end_id, with_ids), schema)
    drawn = F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))
    pieces = materialize(pieces.withColumn("draw", drawn), "pieces")
    groups = max(1, -(-pieces.count() // group_docs))
    keyed = pieces.withColumn("pack_group", F.pmod("draw", F.lit(groups))).drop("draw")
    return keyed.groupBy("pack_group").applyInPandas(_pack_group(capacity), schema + ", sequence_id bigint, offset bigint")
