"""Operator 13: removal of repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first ``depth`` bytes, by passes over ever deeper digits; one that is alone in
its group leaves, so a pass reads less than the one before. Groups that are left at full depth are exactly the repeated
windows, and all but the earliest member of each are covered.

The first digit of a window is its anchor: of its GRAM-byte strings the one with the smallest hash, the first of those.
Equal windows have equal anchors at equal places, so windows fall into the same groups by it as by any other digit, and
the windows that share one occurrence of an anchor, a block, go through the passes together.

    1  count     anchors that stand once in all documents leave (a digit's count needs its hash only)
    2  blocks    equal blocks are one; all but the earliest are covered
    3  windows   anchors with several different blocks: their bytes are fetched, dealt out by anchor, and each task
                 sorts the windows by digits of DIGIT bytes, most significant first

Skew: a task keeps one of the equal blocks of a buffer, so no key has more rows than there are buffers; an anchor with
more than CROWD different blocks is dealt out to several tasks, whose earliest windows meet in one more pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, documents_view, materialize, prepare

#: Bytes of an anchor; bytes read by a task at once (a longer text is read in pieces); bytes of a digit.
GRAM, BUFFER, DIGIT = 32, 1 << 21, 5
#: Different blocks of one anchor that a task takes at most, and blocks sorted at once, about.
CROWD = 4096
#: 64-bit words of the filter of repeated anchors at most (16 MB); with more anchors it passes more, never less.
FILTER_WORDS = 1 << 21
_PLACE = 24
_BASE = 0x9E3779B97F4A7C15
_KEY = ["no_id", "id", "tie"]
_LOCAL = "cover boolean, h bigint, g1 bigint, g2 bigint, no_id boolean, id bigint, tie bigint, pos bigint, start bigint, stop bigint"
_BLOCK = "h bigint, part int, no_id boolean, id bigint, tie bigint, pos bigint, start bigint, body binary"
_SORTED = "cover boolean, w1 bigint, w2 bigint, no_id boolean, id bigint, tie bigint, start bigint, stop bigint"

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64; kept by the worker."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(n, b, np.uint64)
            out[0] = 1
            _powers.append(np.multiply.accumulate(out))
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each string of ``gram`` bytes, by differences of running sums."""
    n = len(x)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(x: np.ndarray, ends: np.ndarray, depth: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of texts that lie end to end in ``x``: hash and place of the anchor, first and last start of the windows."""
    none = np.zeros(0, np.int64)
    if len(x) < depth:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(x, gram)
    low = np.uint64((1 << _PLACE) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, span = depth - gram + 1, 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    windows = len(x) - depth + 1
    at = (np.minimum(least[:windows], least[width - span : width - span + windows]) & low).astype(np.int64)
    room = np.repeat(ends, np.diff(ends, prepend=0))[:windows]
    inside = np.arange(depth, depth + windows) <= room
    same = (at[1:] == at[:-1]) & inside[1:] & inside[:-1]
    first = np.flatnonzero(inside & ~np.concatenate([[False], same]))
    last = np.flatnonzero(inside & ~np.concatenate([same, [False]]))
    return h[at[first]], at[first], first, last


def _buffers(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[bytes, np.ndarray, list[tuple], np.ndarray]]:
    """Texts, or pieces of long ones, end to end and in the order of the documents: bytes, ends, documents, offsets."""
    for batch in batches:
        docs = list(zip(*(batch.column(c).to_pylist() for c in _KEY)))
        texts = batch.column("text").cast(pa.binary())
        parts, ends, owners, offsets, held = [], [], [], [], 0
        for d in sorted(range(len(docs)), key=docs.__getitem__):
            raw = texts[d].as_py()
            for a in range(0, max(len(raw) - depth + 1, 0), BUFFER):
                piece = raw[a : a + BUFFER + depth - 1]
                if held and held + len(piece) > BUFFER:
                    yield b"".join(parts), np.array(ends), owners, np.array(offsets)
                    parts, ends, owners, offsets, held = [], [], [], [], 0
                held += len(piece)
                parts.append(piece)
                ends.append(held)
                owners.append(docs[d])
                offsets.append(a)
        if parts:
            yield b"".join(parts), np.array(ends), owners, np.array(offsets)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _anchor_counts(depth: int):
    """(h, n) of the anchors of a buffer, n being 2 for two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buffer, ends, _, _ in _buffers(batches, depth):
            h, n = np.unique(anchors(np.frombuffer(buffer, np.uint8), ends, depth)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(h), pa.array(np.minimum(n, 2), pa.int32())], names=["h", "n"])

    return run


def filter_bits(h: np.ndarray) -> np.ndarray:
    """Three bits of a word for each hash."""
    bits = np.zeros(len(h), np.uint64)
    for shift in (30, 36, 42):
        bits |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
    return bits


def _filter(repeated: DataFrame) -> np.ndarray:
    """Words of the filter of repeated anchors: those that a bounded number of rows need."""
    words, n = 1, repeated.count()
    while 4 * words < n and words < FILTER_WORDS:
        words *= 2
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned("h", s).bitwiseAND(F.lit(63)).cast("int"))
    mask = bit(30).bitwiseOR(bit(36)).bitwiseOR(bit(42))
    rows = repeated.groupBy(F.col("h").bitwiseAND(F.lit(words - 1)).cast("int").alias("word")).agg(F.bit_or(mask).alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _blocks(depth: int, known):
    """Blocks of the buffers whose anchors may be repeated; of equal ones in a buffer all but the first as covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for buffer, ends, owners, offsets in _buffers(batches, depth):
            h, at, first, last = anchors(np.frombuffer(buffer, np.uint8), ends, depth)
            bits = filter_bits(h)
            may = words[(h & np.uint64(len(words) - 1)).astype(np.int64)] & bits == bits
            h, at, first, last = h[may], at[may], first[may], last[may]
            if not len(h):
                continue
            view = memoryview(buffer)
            g = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a : b + depth]) for a, b in zip(first.tolist(), last.tolist())]), np.uint64).reshape(-1, 2)
            order = np.lexsort((first, g[:, 1], g[:, 0], h))
            same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1]).all(axis=1)])
            again = np.zeros(len(h), bool)
            again[order] = same
            piece = np.searchsorted(ends, first, "right")
            base = offsets[piece] - np.concatenate([[0], ends[:-1]])[piece]
            start, stop, pos = first + base, last + depth + base, at + base
            # neighbouring covers of a piece are one
            c = np.flatnonzero(again)
            new = np.concatenate([[True], (piece[c][1:] != piece[c][:-1]) | (start[c][1:] > stop[c][:-1])]) if len(c) else c.astype(bool)
            heads = np.flatnonzero(new)
            tails = np.concatenate([heads[1:], [len(c)]]) - 1 if len(heads) else heads
            a, b = np.flatnonzero(~again), c[heads]
            rows = np.concatenate([a, b])
            ids, none = [owners[p] for p in piece[rows].tolist()], [None] * len(b)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([False] * len(a) + [True] * len(b)),
                    # covers spread out by themselves
                    _signed(np.concatenate([h[a], h[b] + start[b].astype(np.uint64)])),
                    _signed(np.concatenate([g[a, 0], g[b, 0]])),
                    _signed(np.concatenate([g[a, 1], g[b, 1]])),
                    *(pa.array([d[i] for d in ids], t) for i, t in enumerate((pa.bool_(), pa.int64(), pa.int64()))),
                    pa.array(pos[a].tolist() + none, pa.int64()),
                    pa.array(start[rows]),
                    pa.array(np.concatenate([stop[a], stop[c[tails]] if len(b) else stop[:0]])),
                ],
                names=[f.split()[0] for f in _LOCAL.split(", ")],
            )

    return run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the blocks asked for."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        rows: list[tuple] = []
        keys = list(zip(*(batch.column(c).to_pylist() for c in _KEY)))
        for d, (key, asked) in enumerate(zip(keys, batch.column("asked"))):
            raw = texts[d].as_py()
            for b in asked.as_py():
                rows.append((b["h"], b["part"], *key, b["pos"], b["start"], raw[b["start"] : b["stop"]]))
                if len(rows) == CROWD:
                    yield _block_rows(rows)
                    rows = []
        if rows:
            yield _block_rows(rows)


def _block_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _BLOCK.split(", ")])


def radix_groups(x: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int, digit: int = DIGIT) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``x`` at ``at``, ordered within their groups through ``depth`` bytes by passes from the first digit on:
    (rows, group) of those that are equal to another of their group. A suffix that is alone leaves after each pass."""
    rows = np.arange(len(at))
    value = np.zeros(max(len(x) - digit + 1, 0), np.uint64)
    for i in range(digit):
        value = (value << np.uint64(8)) | x[i : len(x) - digit + 1 + i]
    for offset in [None, *range(0, depth - digit, digit), depth - digit]:
        key = group.astype(np.uint64)
        if offset is not None:
            key = (key << np.uint64(8 * digit)) | value[at[rows] + offset]
        order = np.argsort(key)
        key, rows = key[order], rows[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        alone = new & np.concatenate([new[1:], [True]])
        group, rows = np.cumsum(new)[~alone], rows[~alone]
        if not len(rows):
            break
        group = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]]))
    return rows, group


def _order(depth: int):
    """Sort the windows of blocks, which come by anchor and part."""

    def chunk(table: pa.Table) -> pa.RecordBatch | None:
        pdf = {c: table.column(c).to_numpy() for c in ("h", "part", "no_id", "id", "tie", "pos", "start")}
        bodies = table.column("body").to_pylist()
        x = np.frombuffer(b"".join(bodies), np.uint8)
        sizes = np.array([len(b) for b in bodies])
        begin = np.cumsum(sizes) - sizes
        count = sizes - depth + 1
        block = np.repeat(np.arange(len(bodies)), count)
        inner = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
        start = pdf["start"][block] + inner
        # the first digit: the anchor and its place in the window
        new = np.concatenate([[True], (pdf["h"][1:] != pdf["h"][:-1]) | (pdf["part"][1:] != pdf["part"][:-1])])
        group = np.cumsum(new)[block] * depth + (pdf["pos"][block] - start)
        _, group = np.unique(group, return_inverse=True)
        rows, group = radix_groups(x, begin[block] + inner, group, depth)
        order = np.lexsort((start[rows], *(pdf[c][block[rows]] for c in ("tie", "id", "no_id")), group))
        rows, group = rows[order], group[order]
        later = np.zeros(len(block), bool)
        later[rows[1:][group[1:] == group[:-1]]] = True
        # neighbouring windows are one cover
        c = np.flatnonzero(later)
        fresh = np.concatenate([[True], (block[c][1:] != block[c][:-1]) | (inner[c][1:] != inner[c][:-1] + 1)]) if len(c) else c.astype(bool)
        heads = np.flatnonzero(fresh)
        tails = np.concatenate([heads[1:], [len(c)]]) - 1 if len(heads) else heads
        a, z = c[heads], c[tails]
        # earliest windows of crowded anchors meet those of other parts
        o = np.flatnonzero(~later & (pdf["part"][block] >= 0))
        view = memoryview(x)
        w = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[s : s + depth]) for s in (begin[block[o]] + inner[o]).tolist()]), np.int64).reshape(-1, 2)
        every = np.concatenate([a, o])
        if not len(every):
            return None
        gone = np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([True] * len(a) + [False] * len(o)),
                pa.array(np.concatenate([gone, w[:, 0]])),
                pa.array(np.concatenate([gone, w[:, 1]])),
                pa.array(pdf["no_id"][block[every]].astype(bool)),
                pa.array(pdf["id"][block[every]]),
                pa.array(pdf["tie"][block[every]]),
                pa.array(start[every]),
                pa.array(np.concatenate([start[z], start[o]]) + depth),
            ],
            names=[f.split()[0] for f in _SORTED.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            one = pa.Table.from_batches([batch])
            held = one if held is None else pa.concat_tables([held, one])
            if held.num_rows >= CROWD:
                h, part = held.column("h").to_numpy(), held.column("part").to_numpy()
                whole = np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1]))
                if len(whole):  # the last group may go on
                    done = chunk(held.slice(0, int(whole[-1]) + 1))
                    held = held.slice(int(whole[-1]) + 1)
                    if done is not None:
                        yield done
        if held is not None and held.num_rows:
            done = chunk(held)
            if done is not None:
                yield done

    return run


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and what is left."""
    removed, runs, left, reach = 0, 0, [], 0
    for a, b in sorted(spans):
        if runs == 0 or a > reach:
            left.append(raw[reach:a])
            runs += 1
            removed += b - a
        elif b > reach:
            removed += b - reach
        reach = max(reach, b)
    left.append(raw[reach:])
    return removed, runs, b"".join(left)


def _removed(with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            cols: list[list] = [[] for _ in range(5)]
            for d, spans in enumerate(batch.column("spans").to_pylist()):
                raw = texts[d].as_py()
                n, runs, left = cut_spans(raw, [(s["start"], s["stop"]) for s in spans or ()])
                row = (len(raw), n, runs, hashlib.sha256(left).hexdigest(), left if with_text else None)
                for col, value in zip(cols, row):
                    col.append(value)
            keys = [batch.column(c) for c in _KEY]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[*_KEY, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """Documents by what orders them: doc_id with null last, then a hash of the text."""
    view = documents_view(docs)
    return view.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.col("text").cast("binary")).alias("tie"), F.col("text").cast("binary").alias("text"))


def _earliest(*by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*_KEY, "start")) == 1


def repeated_spans(texts: DataFrame, depth: int = 100, crowd: int = CROWD) -> DataFrame:
    """(no_id, id, tie, start, stop): spans of bytes that repeated windows cover, all but the earliest; they may overlap.
    ``texts`` has one row for each (no_id, id, tie), which is also their order, and ``text`` as bytes."""
    if depth <= GRAM:
        raise ValueError(f"windows must be longer than {GRAM} bytes")
    spark = prepare(texts.sparkSession)
    scratch = Scratch(spark, "suffixes")
    counts = texts.mapInArrow(_anchor_counts(depth), "h bigint, n int").groupBy("h").agg(F.sum("n").alias("n"))
    repeated = scratch.write(counts.where("n > 1").select("h"), "anchors")
    known = spark.sparkContext.broadcast(_filter(repeated))  # at most FILTER_WORDS
    found = texts.mapInArrow(_blocks(depth, known), _LOCAL)
    first = _earliest("cover", "h", "g1", "g2")
    marked = scratch.write(found.withColumn("first", first), "blocks").withColumn("cover", F.col("cover") | ~F.col("first"))
    blocks = marked.where("not cover").drop("cover", "first")
    shared = scratch.write(blocks.groupBy("h").count().where("count > 1"), "shared")
    # part -1: all blocks of the anchor are in one task
    part = F.when(F.col("count") > crowd, F.pmod("g1", F.ceil(F.col("count") / crowd))).otherwise(-1).cast("int")
    asked = blocks.join(shared, "h").withColumn("part", part).groupBy(*_KEY).agg(F.collect_list(F.struct("h", "part", "pos", "start", "stop")).alias("asked"))
    bodies = texts.join(asked, _KEY).mapInArrow(_fetch, _BLOCK)
    dealt = bodies.repartition("h", "part").sortWithinPartitions("h", "part")
    ordered = scratch.write(dealt.mapInArrow(_order(depth), _SORTED), "windows")
    crowded = ordered.where("not cover").withColumn("first", _earliest("w1", "w2")).where("not first")
    spans = [s.select(*_KEY, "start", "stop") for s in (marked.where("cover"), ordered.where("cover"), crowded)]
    return spans[0].unionByName(spans[1]).unionByName(spans[2])


def remove_repeats(docs: DataFrame, depth: int = 100, with_text: bool = False, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes that are left) of every row.

    A byte goes if some string of ``depth`` bytes that covers it also starts earlier: in a document with a smaller
    doc_id, or earlier in the same one. Strings are judged on the input, not on what is left.

    Defined cases: a null text is empty; texts shorter than ``depth`` lose nothing; null doc_ids come last; rows of one
    doc_id are ordered by a hash of their texts; of rows that are equal in both, one stands first and the others, if
    long enough, lose all; very long texts are read in pieces; an empty table gives no rows; other columns are never read.
    """
    texts = _texts(docs)
    twins = texts.where(F.octet_length("text") >= depth).groupBy(*_KEY).count().where("count > 1").select(*_KEY)
    twins = materialize(twins, "twins")
    repeated = not twins.isEmpty()
    single = texts
    if repeated:  # one row of each
        single = materialize(texts.join(twins, _KEY, "left_anti").unionByName(texts.join(twins, _KEY, "left_semi").dropDuplicates(_KEY)), "single")
    spans = repeated_spans(single, depth, crowd).groupBy(*_KEY).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    schema = "no_id boolean, id bigint, tie bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    done = texts.join(spans, _KEY, "left").mapInArrow(_removed(with_text), schema)
    if repeated:
        done = materialize(done.withColumn("row", F.monotonically_increasing_id()), "removed")
        among = done.join(twins, _KEY, "left_semi")
        first = among.groupBy(*_KEY).agg(F.min("row").alias("row")).select("row")
        others = among.select("row").join(first, "row", "left_anti").withColumn("other", F.lit(True))
        none = F.lit(hashlib.sha256(b"").hexdigest())
        gone = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("bigint"), "kept_sha256": none, "kept": F.when(F.col("kept").isNotNull(), F.lit(b""))}
        done = done.join(others, "row", "left").withColumns({c: F.when(F.col("other"), v).otherwise(F.col(c)) for c, v in gone.items()})
    out = done.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return out if with_text else out.drop("kept")
