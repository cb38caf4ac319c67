"""Operator 2: token-id shards with a minimal perfect hash index for keyed access.

Documents are range-partitioned by doc_id. Each range becomes one shard file in the shared folder:

    header   8 x int64: magic, version, id width in bytes, rows, distinct keys, buckets, payload bytes, first-null rows
    keys     int64[rows]     doc_ids, ascending
    bounds   int64[rows + 1] payload position of each row, in ids
    seeds    uint32[buckets] displacement of each bucket of the hash function
    marks    uint32[keys]    fingerprint of the key in each slot
    slots    uint32[keys]    first row of the key in each slot
    payload  raw ids, little-endian, 2 bytes where the vocabulary fits, else 4

A key is found in constant time: bucket, displacement, slot, fingerprint, row, bounds.
"""

from __future__ import annotations

import bisect
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents_view, fresh_path, prepare, qualified
from .tokens import encoder, little_blocks, vocabulary_path

MAGIC, VERSION, HEADER = 0x31444853544F4B, 1, 8
MANIFEST = "shard bigint, path string, n_rows bigint, n_ids bigint, first_key bigint, last_key bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard bigint, row_in_shard bigint"


def _mix(keys: np.ndarray, seed) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multipliers), vectorised over keys and seeds."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.asarray(seed, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_hash(keys: np.ndarray, per_bucket: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Displacement seeds and the slot of each key: a bijection of n distinct keys onto 0..n-1."""
    n = len(keys)
    buckets = max(1, int(np.ceil(n / per_bucket)))
    seeds, slots = np.zeros(buckets, np.uint32), np.zeros(n, np.int64)
    if not n:
        return seeds, slots
    home = (_mix(keys, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    begin = np.searchsorted(home[order], np.arange(buckets + 1))
    sizes = np.diff(begin)
    taken = np.zeros(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        members = order[begin[b] : begin[b + 1]]
        first, found = 1, False
        while not found:
            tries = np.arange(first, first + 64, dtype=np.uint64)
            where = (_mix(keys[members][None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
            free = ~taken[where].any(axis=1)
            for k in np.flatnonzero(free):
                if len(np.unique(where[k])) == len(members):
                    seeds[b], slots[members] = tries[k], where[k]
                    taken[where[k]] = True
                    found = True
                    break
            first += 64
    return seeds, slots


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 0xF1A9) >> np.uint64(32)).astype(np.uint32)


def encode_shard(doc_ids: list[int | None], rows: list[bytes], width: int) -> bytes:
    """One shard file from rows in ascending doc_id order (nulls first)."""
    nulls = sum(d is None for d in doc_ids)
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    lengths = np.array([len(r) // width for r in rows], dtype="<i8")
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    distinct, first = np.unique(keys[nulls:], return_index=True)
    seeds, slots = build_hash(distinct)
    marks, at = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    marks[slots], at[slots] = _fingerprint(distinct), first + nulls
    head = np.array([MAGIC, VERSION, width, len(rows), len(distinct), len(seeds), int(bounds[-1]) * width, nulls], dtype="<i8")
    return b"".join([head.tobytes(), keys.tobytes(), bounds.tobytes(), seeds.astype("<u4").tobytes(), marks.tobytes(), at.tobytes(), *rows])


class Shard:
    """Keyed access to one shard file (any buffer: bytes, memory map)."""

    def __init__(self, buffer):
        head = np.frombuffer(buffer, "<i8", HEADER)
        if head[0] != MAGIC or head[1] != VERSION:
            raise ValueError("not a token shard")
        _, _, self.width, n, m, b, size, self.nulls = map(int, head)
        at = 8 * HEADER
        self.keys = np.frombuffer(buffer, "<i8", n, at)
        self.bounds = np.frombuffer(buffer, "<i8", n + 1, at := at + 8 * n)
        self.seeds = np.frombuffer(buffer, "<u4", b, at := at + 8 * (n + 1))
        self.marks = np.frombuffer(buffer, "<u4", m, at := at + 4 * b)
        self.slots = np.frombuffer(buffer, "<u4", m, at := at + 4 * m)
        self.payload = np.frombuffer(buffer, f"<u{self.width}", size // self.width, at + 4 * m)

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """First row of each key, -1 where the fingerprint says that it isn't here."""
        if not len(self.marks):
            return np.full(len(keys), -1, np.int64)
        bucket = (_mix(keys, 0) % np.uint64(len(self.seeds))).astype(np.int64)
        slot = (_mix(keys, self.seeds[bucket]) % np.uint64(len(self.marks))).astype(np.int64)
        return np.where(self.marks[slot] == _fingerprint(keys), self.slots[slot].astype(np.int64), -1)

    def ids(self, row: int) -> np.ndarray:
        return self.payload[self.bounds[row] : self.bounds[row + 1]]

    def get(self, key: int) -> np.ndarray | None:
        """Ids of a document, None if the key isn't in this shard."""
        row = int(self.rows_of(np.array([key], dtype=np.int64))[0])
        return self.ids(row) if row >= 0 and self.keys[row] == key else None


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a full URI."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _write(path: str, data: bytes) -> None:
    """Whole files only: a lost or repeated task never leaves half a shard under the final name."""
    fs, inner = _open(path)
    fs.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, inner)


def _read(path: str):
    fs, inner = _open(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(inner).read_buffer()
    with fs.open_input_file(inner) as f:
        return f.read_buffer()


def _writer(vocabulary: str, end_id: int, folder: str, shard_ids: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id) <= 1 << 16 else 4
        docs: list = []
        rows: list[bytes] = []
        made: list[tuple] = []
        held = 0

        def flush() -> None:
            nonlocal docs, rows, held
            if docs:
                path = f"{folder}/{part:06d}-{len(made):04d}.tokens"
                _write(path, encode_shard(docs, rows, width))
                made.append(((part << 32) + len(made), path, len(docs), held, next((d for d in docs if d is not None), None), docs[-1]))
            docs, rows, held = [], [], 0

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in little_blocks(texts):
                for doc, raw in zip(ids[a:b], enc.encode(texts[a:b])):
                    if held >= shard_ids:
                        flush()
                    raw += end
                    held += len(raw) // 4
                    docs.append(doc)
                    rows.append(raw if width == 4 else np.frombuffer(raw, "<u4").astype("<u2").tobytes())
        flush()
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
        cols = list(zip(*made)) or [[] for _ in kinds]
        names = ["shard", "path", "n_rows", "n_ids", "first_key", "last_key"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def write_token_shards(
    docs: DataFrame, folder: str, end_id: int = 1, vocabulary: str | None = None, shard_ids: int = 8_000_000
) -> DataFrame:
    """Encode all documents, write the shard files, return their manifest (one row a file).

    Shards follow doc_id order: a higher shard number holds no lower doc_ids. A document is never split; the rows
    of one doc_id (or without one) may fill several shards in a row, dealt out by their text's hash and the input
    partition they come from. File names depend on the partition only, and files appear
    under them whole, so a task that runs again replaces its own files by the same bytes.
    """
    spark = prepare(docs.sparkSession)
    keys = ["doc_id", "text_hash", "origin"]
    view = documents_view(docs).withColumns({"text_hash": F.xxhash64("text"), "origin": F.spark_partition_id()})
    folder = qualified(spark, folder)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = view.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    made = ordered.mapInArrow(_writer(vocabulary or vocabulary_path(), end_id, folder, shard_ids), MANIFEST)
    path = f"{folder}/manifest"
    made.write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, path, base in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "base"))):
            shard = Shard(_read(path))
            at = shard.rows_of(shard.keys)
            at[: shard.nulls] = 0
            same = np.arange(len(at))
            again = np.concatenate([[False], shard.keys[1:] == shard.keys[:-1]])
            again[: shard.nulls + 1] = False
            # a repeated key is found at its first row; the rows after it follow in the file
            firsts = np.maximum.accumulate(np.where(again, 0, same))
            if not np.array_equal(at[shard.nulls :], firsts[shard.nulls :]):
                raise ValueError(f"the index of {path} doesn't hold its keys")
            for a in range(0, len(at), 4096):
                rows = range(a, min(a + 4096, len(at)))
                crc = [zlib.crc32(shard.ids(r).astype("<u4").tobytes()) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if r < shard.nulls else int(shard.keys[r]) for r in rows], pa.int64()),
                        pa.array(base + shard.bounds[a : a + len(rows)], pa.int64()),
                        pa.array(np.diff(shard.bounds[a : a + len(rows) + 1]), pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array([number] * len(rows), pa.int64()),
                        pa.array(list(rows), pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "row_in_shard"],
                )


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: every key goes through the index of its shard.

    ``start`` counts the ids of all documents before it in doc_id order. The running sum is over the
    manifest, a row a file.
    """
    spark = prepare(manifest.sparkSession)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return based.repartition(parts, "shard").mapInArrow(_reader, ROWS)


class TokenStore:
    """Keyed access to a written store. The manifest's key ranges say which file may hold a key, the file's
    hash says where: one memory map and one slot a key, whatever the size of the store."""

    def __init__(self, manifest: DataFrame):
        rows = manifest.where("last_key is not null").select("first_key", "last_key", "path").orderBy("shard")
        self.ranges = [tuple(r) for r in rows.toLocalIterator()]  # a row a file
        self.lasts = [r[1] for r in self.ranges]
        self.shards: dict[str, Shard] = {}

    def get(self, key: int) -> np.ndarray | None:
        """Ids of a document (of several rows with this key, the first), None if there is none."""
        at = bisect.bisect_left(self.lasts, key)
        if at == len(self.ranges) or key < self.ranges[at][0]:
            return None
        path = self.ranges[at][2]
        if path not in self.shards:
            self.shards[path] = Shard(_read(path))
        return self.shards[path].get(key)


def token_store(docs: DataFrame, **options) -> DataFrame:
    """Write all documents to shards in the shared folder and read every one back by its key.

    Defined cases: a null or empty text is the end id alone; repeated doc_ids keep all their rows, one after
    the other in order of a hash of their text; null doc_ids come first; an empty table gives no rows;
    other columns are never read.
    """
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_token_shards(write_token_shards(docs, folder, **options))
