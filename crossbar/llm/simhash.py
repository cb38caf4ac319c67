"""Operator 8: SimHash near-duplicates by a Gray-order hierarchical index.

1. A fingerprint for every text; equal fingerprints are one row with the smallest doc_id.
2. Routing: fingerprints at ``k`` or fewer differing bits agree in one of k + 1 parts of the 64 bits,
   so each is sent to k + 1 cells, by the leading bits of each part. The number of those bits follows
   the number of fingerprints, so a cell holds a few thousand on average at any size.
3. A crowded cell is cut into blocks of consecutive Gray ranks. The bits that all of a block share are
   its masked pattern; pairs of blocks whose patterns differ in more than ``k`` bits are dropped, the
   others are one task each, so no task ever holds more than two blocks.
4. In a task the fingerprints, in Gray order, are the leaves of a tree. A node keeps only the shared bits
   that its parent doesn't: differences add up on the way down, and a whole group goes once they
   exceed ``k``. A task returns a spanning forest of its links, never all pairs.
5. Components of the forest edges, by alternating minimum-neighbour steps over checkpointed edges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .common import DROP_KEY, Scratch, cut, documents_view, drop_rows, join_spread, materialize, prepare

SEED = 42
CELL = 4096
BLOCK = 8192
FAN = 8
MARKS = 1024
#: Of similar texts: least hashes that a set is first met by, and the share of shingle hashes (the lowest) that come
#: first in the order of prefixes, among themselves by how many sets have them, and 64-bit words of the parity
#: fingerprint that pairs are compared by where they meet.
LEADS, COUNTED, SKETCH = 6, 0.3, 8
#: Differing bits up to which fingerprints of shingle sets are linked by the index.
RADIUS = 3
#: First shingles of a prefix that later ones of it are checked against, so that a pair is met about once.
HEAD = 8


# --- fingerprints -------------------------------------------------------------------------------------


def fingerprint(text: bytes, words: int = 3) -> int:
    """Bits that are set in over half of the hashes of all word shingles (unsigned)."""
    row = text.lower().split()
    if not row:
        return 0
    shingles = map(b" ".join, zip(*(row[i:] for i in range(min(words, len(row))))))

    def hashed() -> Iterator[np.ndarray]:
        while block := [xxhash.xxh64_intdigest(s, SEED) for s in islice(shingles, 1 << 14)]:
            yield np.array(block, dtype=">u8").view(np.uint8).reshape(len(block), 8)

    return int.from_bytes(majority(hashed()).tobytes(), "big")


def majority(blocks: Iterable[np.ndarray]) -> np.ndarray:
    """Bits (packed as bytes) that are set in over half of the rows of blocks of packed bits."""
    n, counts = 0, 0
    for packed in blocks:
        n += len(packed)
        for a in range(0, len(packed), 255):  # sums of so many bits fit a byte
            counts = counts + np.add.reduce(np.unpackbits(packed[a : a + 255], axis=1), axis=0, dtype=np.uint8).astype(np.int64)
    return np.packbits(2 * counts > n)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    row = text.lower().split()
    n = min(words, len(row))
    shingles = map(b" ".join, zip(*(row[i:] for i in range(n))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(texts))
            cols = [batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "bits", "text_hash"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, bits (the fingerprint as a signed 64-bit integer) and a hash of the text of every row."""
    prepare(docs.sparkSession)
    view = documents_view(docs).withColumn("text_hash", F.xxhash64("text"))
    return view.mapInArrow(_fingerprints(words), "doc_id bigint, bits bigint, text_hash bigint")


# --- the tree -----------------------------------------------------------------------------------------


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence: neighbours there differ in one bit."""
    rank = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayTree:
    """Fingerprints in Gray order with the shared masked patterns of their groups."""

    def __init__(self, bits: np.ndarray):
        self.order = np.argsort(gray_rank(bits), kind="stable")
        codes = bits[self.order]
        ones = [codes]
        zeros = [~codes]
        while len(ones[0]) > 1:
            starts = np.arange(0, len(ones[0]), FAN)
            ones.insert(0, np.bitwise_and.reduceat(ones[0], starts))
            zeros.insert(0, np.bitwise_and.reduceat(zeros[0], starts))
        # each level: the mask of bits that its nodes add to their parent's, and their values
        self.levels, above = [], np.zeros(1, np.uint64)
        for level, (one, zero) in enumerate(zip(ones, zeros)):
            shared = one | zero
            new = shared & ~(above[np.arange(len(one)) // FAN] if level else above)
            self.levels.append((new, one & new))
            above = shared

    def within(self, queries: np.ndarray, k: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, fingerprint number) at ``k`` or fewer differing bits, in blocks."""
        if not len(self.order):
            return
        everyone = np.arange(len(queries), dtype=np.int32)
        blocks = [everyone[a : a + 256] for a in range(0, len(queries), 256)]
        todo = [(0, b, np.zeros(len(b), np.int32), None) for b in blocks]
        while todo:
            level, query, node, far = todo.pop()
            mask, value = self.levels[level]
            more = np.bitwise_count((queries[query] ^ value[node]) & mask[node])
            far = more if far is None else far + more
            near = far <= k
            query, node, far = query[near], node[near], far[near]
            if level == len(self.levels) - 1:
                if len(query):
                    yield query, self.order[node]
                continue
            size = len(self.levels[level + 1][0])
            for a in range(0, len(query), most // FAN):
                q, p, f = (x[a : a + most // FAN] for x in (query, node, far))
                child = (p[:, None] * FAN + np.arange(FAN, dtype=np.int32)).ravel()
                inside = child < size
                todo.append((level + 1, np.repeat(q, FAN)[inside], child[inside], np.repeat(f, FAN)[inside]))


class Forest:
    """Components of numbered items; links come in blocks."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            low, high = np.minimum(x[differ], y[differ]), np.maximum(x[differ], y[differ])
            np.minimum.at(root, high, low)
            while not np.array_equal(up := root[root], root):
                root[:] = up


    def hook(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Links too; the numbers of those given links that span what was apart before."""
        root, at, used = self.root, np.arange(len(a)), [np.zeros(0, np.int64)]
        while True:
            x, y = root[a[at]], root[b[at]]
            differ = x != y
            if not differ.any():
                return np.concatenate(used)
            at, low, high = at[differ], np.minimum(x, y)[differ], np.maximum(x, y)[differ]
            high, first = np.unique(high, return_index=True)
            root[high] = low[first]
            used.append(at[first])
            while not np.array_equal(up := root[root], root):
                root[:] = up


def _cell_pairs(k: int):
    """Spanning edges of one task, each of which is a link itself: what is to be verified."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = pdf["bits"].to_numpy(np.int64).view(np.uint64)
        left = np.flatnonzero(pdf["side"].to_numpy() != 1)
        right = np.flatnonzero(pdf["side"].to_numpy() != 0)
        forest, ids, found = Forest(len(bits)), pdf["node"].to_numpy(np.int64), []
        for q, p in GrayTree(bits[left]).within(bits[right], k):
            a, b = right[q], left[p]
            used = forest.hook(a, b)
            found.append(np.stack([ids[a[used]], ids[b[used]]]))
        u, v = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
        return pd.DataFrame({"u": u, "v": v})

    return run


def _cell_links(k: int):
    """Spanning edges of one task."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = pdf["bits"].to_numpy(np.int64).view(np.uint64)
        left = np.flatnonzero(pdf["side"].to_numpy() != 1)
        right = np.flatnonzero(pdf["side"].to_numpy() != 0)  # side 2: one block against itself
        tree, forest = GrayTree(bits[left]), Forest(len(bits))
        for q, p in tree.within(bits[right], k):
            forest.link(right[q], left[p])
        linked = np.flatnonzero(forest.root != np.arange(len(bits)))
        ids = pdf["node"].to_numpy(np.int64)
        return pd.DataFrame({"u": ids[linked], "v": ids[forest.root[linked]]})

    return run


# --- links --------------------------------------------------------------------------------------------


def _cells(prints: DataFrame, k: int, route_bits: int) -> DataFrame:
    """Each fingerprint once for each of k + 1 parts, under the leading bits of that part."""
    parts = k + 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    cells = []
    for i in range(parts):
        width = min(route_bits, cuts[i + 1] - cuts[i])
        low = 64 - cuts[i] - width
        value = F.shiftrightunsigned("bits", low).bitwiseAND(F.lit((1 << width) - 1)) if width else F.lit(0).cast("bigint")
        cells.append(F.struct(F.lit(i).alias("part"), value.alias("cell")))
    return prints.select("node", "bits", F.inline(F.array(*cells)))


def _gray() -> F.Column:
    """Gray rank as an expression, shifted to sort as a signed number."""
    rank = F.col("bits")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank


def link_edges(prints: DataFrame, k: int = 2, cell: int = CELL, block: int = BLOCK, kernel=_cell_links) -> DataFrame:
    """Edges (u, v) that span every component of fingerprints at ``k`` or fewer differing bits.

    ``prints`` has distinct ``bits`` with their ``node`` numbers. With ``_cell_pairs`` each edge is such a link itself.
    """
    n = prints.count()
    route_bits = max(0, int(np.ceil(np.log2(max(1, n / cell)))))
    return _link_cells(_cells(prints, k, route_bits), kernel(k), k, block)


def _link_cells(routed: DataFrame, kernel, k: int, block: int) -> DataFrame:
    """Edges of all cells. ``routed`` has part, cell, node, bits and whatever else the kernel reads."""
    carried = [c for c in routed.columns if c not in ("part", "cell")]
    routed = routed.withColumn("rank", F.shiftrightunsigned(_gray(), 1))
    sizes = routed.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"))
    # boundaries of Gray blocks of crowded cells; at most n * (k + 1) / block of them exist
    crowded = sizes.where(F.col("n") > block).select(
        "part", "cell", F.ceil(F.col("n") / F.lit(block / 2)).cast("int").alias("blocks")
    )
    crowd = materialize(crowded, "crowded")
    step = [i / MARKS for i in range(1, MARKS)]
    is_crowded = not crowd.isEmpty()
    out = "u bigint, v bigint"
    if not is_crowded:
        plain = routed.withColumn("side", F.lit(2))
        return plain.groupBy("part", "cell").applyInPandas(kernel, out)
    # both tables of crowded cells have at most one value a block
    hint = F.broadcast if crowd.agg(F.sum("blocks")).first()[0] <= 1_000_000 else (lambda df: df)
    keyed = routed.join(hint(crowd), ["part", "cell"], "left")
    quiet = keyed.where("blocks is null").select("part", "cell", F.lit(0).alias("i"), F.lit(0).alias("j"), *carried, F.lit(2).alias("side"))
    loud = keyed.where("blocks is not null")
    # Gray blocks by exact distinct ranks are not needed: any cut is right, even cuts are balanced
    edges = loud.groupBy("part", "cell").agg(F.percentile_approx("rank", step, F.lit(10 * MARKS)).alias("marks"), F.max("blocks").alias("blocks"))
    marks = edges.select(
        "part",
        "cell",
        F.expr(f"array_distinct(transform(sequence(1, least({MARKS}, greatest(blocks, 2)) - 1), x -> element_at(marks, greatest(1, cast({MARKS} * x / least({MARKS}, greatest(blocks, 2)) as int)))))").alias("marks"),
    )
    placed = loud.drop("blocks").join(hint(marks), ["part", "cell"]).withColumn(
        "i", F.expr("size(filter(marks, m -> m < rank))")
    )
    patterns = placed.groupBy("part", "cell", "i").agg(
        F.bit_and("bits").alias("ones"), F.bit_and(F.bitwise_not("bits")).alias("zeros")
    )
    other = patterns.select("part", "cell", F.col("i").alias("j"), F.col("ones").alias("ones2"), F.col("zeros").alias("zeros2"))
    # whole groups go where their masked patterns already differ too much
    pairs = (
        patterns.join(other, ["part", "cell"])
        .where("i <= j")
        .where(F.expr("bit_count((ones & zeros2) | (zeros & ones2))") <= k)
        .select("part", "cell", "i", "j")
    )
    sides = pairs.select("part", "cell", "i", "j", F.inline(F.expr("if(i = j, array(struct(i as at, 2 as side)), array(struct(i as at, 0 as side), struct(j as at, 1 as side)))")))
    tasks = placed.select("part", "cell", F.col("i").alias("at"), *carried).join(sides, ["part", "cell", "at"])
    every = quiet.unionByName(tasks.select("part", "cell", "i", "j", *carried, "side"))
    return every.groupBy("part", "cell", "i", "j").applyInPandas(kernel, out)


#: Edges up to which a table of a row a node is broadcast and the rounds run on few partitions.
FEW_EDGES = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have an edge; component is the smallest node reachable.

    Alternating steps: every node links its larger neighbours to its smallest neighbour (large star),
    then its smaller ones (small star), until all edges are stars. Only minima are gathered, never a
    node's neighbours, and edges are checkpointed after each round.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    n, state = edges.count(), None
    while True:
        few = n <= FEW_EDGES  # rounds never add edges
        gather = (lambda df: df.coalesce(1 + n // 100_000)) if few else (lambda df: df)
        edges = gather(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = gather(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")))
        # the larger neighbours of one node may be a third of all edges
        larger = both.where("v > u")
        large = larger.join(F.broadcast(low), "u") if few else join_spread(larger, low, "u", n)
        large = gather(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = gather(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(F.broadcast(low) if few else low, "u")
        edges = gather(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        edges = cut(edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        n, state = now[0], now


def _named(classes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, least): the least member of the component of each class; classes without links keep their own."""
    member = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    joined = classes.join(member, "node", "left")
    alone = joined.where("component is null").select(key, "least")
    linked = materialize(joined.where("component is not null").select(key, "component", "least"), "linked")
    smallest = linked.groupBy("component").agg(F.min("least").alias("least"))
    named = join_spread(linked.select(key, "component"), smallest, "component", max(1, linked.count()))
    return materialize(alone.unionByName(named.select(key, "least")), "named")


def near_duplicates(docs: DataFrame, k: int = 2, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, text_hash, kept of every row.

    ``kept`` marks one text of each component: that of its smallest doc_id, then of the smallest hash.

    Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; texts
    with fewer words than a shingle are one shingle; equal fingerprints are one component; repeated rows
    each get their row (and share ``kept``); rows with a null doc_id take part, and a component of null
    doc_ids only has a null component_id; an empty table gives no rows; other columns are never read.
    """
    prints = materialize(fingerprints(docs, words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    # a distinct fingerprint is its own node number; what names a component is put on at the end
    distinct = materialize(prints.groupBy("bits").agg(first.alias("least")).withColumn("node", F.col("bits")), "classes")
    found = components(link_edges(distinct.select("node", "bits"), k))
    named = _named(distinct.select("bits", "node", "least"), found, "bits")
    every = join_spread(prints, named, "bits", max(1, prints.count()))
    return every.select(
        "doc_id",
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"),
        "text_hash",
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))).alias("kept"),
    )


# --- similar texts ------------------------------------------------------------------------------------


def set_fingerprint(shingles: np.ndarray) -> int:
    """Bits that are set in over half of a set's shingle hashes (unsigned); none of no shingles."""
    packed = shingles.astype(">u8").view(np.uint8).reshape(len(shingles), 8)
    return int.from_bytes(majority([packed]).tobytes(), "big") if len(shingles) else 0


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.uint64).view(np.int64)))


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, 256) for whole in batches for a in range(0, len(whole), 256)):
            sets = [shingle_set(t.as_py(), words) for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([_nodes(sets), _lists(sets)], names=["node", "shingles"])

    return run


def _nodes(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets), np.uint64, len(sets)).view(np.int64))


def candidates(shingles: np.ndarray, similarity: float) -> tuple[np.ndarray, int, int]:
    """The shingles that a prefix may hold, in the order of their hashes; how many of them are counted; and the length
    of the prefix: of two sets of this similarity so many first shingles, in any one order, have one in common."""
    counted = int(np.searchsorted(shingles, np.uint64(int(COUNTED * (1 << 64)))))
    reach = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9)) + 1 if len(shingles) else 0
    return shingles[: max(counted, reach)], counted, reach


def parities(shingles: np.ndarray, words: int = 1) -> np.ndarray:
    """A bit or more for each element, in 2^k words of 64 (``words`` at least): of two sets they differ in no more
    bits than the sets differ in elements, also once the longer one is folded to the length of the other."""
    bits = 64 * words
    while bits < len(shingles):
        bits *= 2
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(words: np.ndarray, length: int) -> np.ndarray:
    return np.bitwise_xor.reduce(words.reshape(-1, length), axis=0)


def _profiles(words: int, similarity: float):
    mixes = np.random.default_rng(SEED).integers(0, 1 << 63, LEADS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, 256) for whole in batches for a in range(0, len(whole), 256)):
            sets = [shingle_set(t.as_py(), words) for t in batch.column(1).cast(pa.binary())]
            leads = [((x[:, None] ^ (x[:, None] >> np.uint64(29))) * mixes).min(axis=0) if len(x) else x for x in sets]
            tokens, counted, reach = zip(*(candidates(x, similarity) for x in sets)) if sets else ((), (), ())
            odd = [parities(x) for x in sets]
            bits = np.array([set_fingerprint(x) for x in sets], np.uint64).view(np.int64)
            brief = np.array([folded(x, 1)[0] for x in odd], np.uint64).view(np.int64)
            n = pa.array([len(x) for x in sets], pa.int32())
            cols = [batch.column(0), batch.column(2), _nodes(sets), n, pa.array(bits), pa.array(brief), _lists(odd), _lists(leads)]
            sketch = [folded(parities(x, SKETCH), SKETCH) for x in sets]
            cols += [pa.array(counted, pa.int32()), pa.array(reach, pa.int32()), _lists(sketch), _lists(list(tokens))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "node", "n", "bits", "brief", "odd", "leads", "counted", "reach", "sketch", "tokens"])

    return run


def _fits(similarity: float, sketch: bool = False) -> tuple[Column, Column]:
    """Whether sizes n1, n2 and parities (brief1, brief2, or sketch1, sketch2) allow the similarity; how many shingles
    must then be shared."""
    least = F.lit(similarity / (1 + similarity)) * (F.col("n1") + F.col("n2")) - 1e-6
    sizes = F.least("n1", "n2") >= F.lit(similarity) * F.greatest("n1", "n2") - 1e-6
    word = lambda c, i: F.element_at(c, i) if sketch else F.col(c)
    name = "sketch" if sketch else "brief"
    differ = sum((F.bit_count(word(name + "1", i).bitwiseXOR(word(name + "2", i))) for i in range(1, (SKETCH if sketch else 1) + 1)), F.lit(0))
    return sizes & (differ <= F.col("n1") + F.col("n2") - 2 * least), least


def _close(similarity: float):
    """Pairs whose parities allow the similarity."""
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = (batch.column("n1").to_numpy() + batch.column("n2").to_numpy()) * share + 1e-6
            one, two = batch.column("odd1"), batch.column("odd2")
            keep = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                a, b = (c[i].values.to_numpy().view(np.uint64) for c in (one, two))
                size = min(len(a), len(b))
                keep[i] = np.bitwise_count(folded(a, size) ^ folded(b, size)).sum() <= n[i]
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return run


def _both_ends(pairs: DataFrame, table: DataFrame, columns: tuple[str, ...], total: int) -> DataFrame:
    """Pairs (u, v) with some columns of both their nodes, numbered 1 and 2."""
    for key, place in (("u", "1"), ("v", "2")):
        end = table.select(F.col("node").alias(key), *[F.col(c).alias(c + place) for c in columns])
        pairs = join_spread(pairs, end, key, max(1, total))
    return pairs


def _verified(pairs: DataFrame, profiles: DataFrame, view: DataFrame, classes: DataFrame, words: int, similarity: float, scratch: Scratch, step: str) -> DataFrame:
    """Those of the pairs (u, v, long) of nodes whose shingle sets have this Jaccard similarity or more. The parities of
    long ones are compared first; what meets by a sketch has nothing more to tell of the others."""
    pairs = scratch.write(pairs.distinct(), f"{step}-met")
    long, short = (pairs.where(c).select("u", "v") for c in ("long", "not long"))
    close = _both_ends(long, profiles, ("n", "odd"), long.count()).mapInArrow(_close(similarity), "u bigint, v bigint")
    close = scratch.write(short.unionByName(close), f"{step}-close")
    # sets are made again, of texts that a Bloom filter passes: one text of each node
    asked = close.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    asked = scratch.write(asked.join(classes, "node").select("node", F.col("least.text_hash").alias("text_hash")), f"{step}-asked")
    blocks = bloom.block_count(asked.count())
    passed = bloom.possible(view, F.col("text_hash"), bloom.build(asked, "text_hash", blocks), blocks, "__asked").where("__asked")
    sets = passed.select("text").mapInArrow(_sets(words), "node bigint, shingles array<bigint>")
    one = scratch.write(sets.groupBy("node").agg(F.any_value("shingles").alias("shingles")), f"{step}-sets")
    both = _both_ends(close, one, ("shingles",), close.count())
    shared = F.size(F.array_intersect("shingles1", "shingles2"))
    edges = both.where(shared / (F.size("shingles1") + F.size("shingles2") - shared) >= similarity).select("u", "v")
    edges = scratch.write(edges, f"{step}-edges")
    scratch.drop(*(f"{step}-{t}" for t in ("met", "close", "asked", "sets")))
    return edges


def _print_pairs(profiles: DataFrame, similarity: float, k: int, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of sets by their fingerprints: each set with one of the same fingerprint, and those along a forest
    of the fingerprints at ``k`` or fewer differing bits, which the Gray-order index finds."""
    columns = ("set", "n", "brief")
    sets = profiles.select("bits", F.col("node").alias("set"), "n", "brief")
    heads = sets.groupBy("bits").agg(F.min(F.struct(*columns)).alias("head"), F.count(F.lit(1)).alias("size"))
    heads = scratch.write(heads.select(F.col("bits").alias("node"), "head.*", "size"), "print-heads")
    total = heads.count()
    links = scratch.write(link_edges(heads.select("node", F.col("node").alias("bits")), k, kernel=_cell_pairs).distinct(), "print-links")
    forest = _both_ends(links, heads, columns, total).drop("u", "v")
    shared = heads.where("size > 1").select(F.col("node").alias("bits"), *(F.col(c).alias(c + "2") for c in columns))
    same = join_spread(sets.select("bits", *(F.col(c).alias(c + "1") for c in columns)), shared, "bits", max(1, profiles.count()))
    met = forest.unionByName(same.drop("bits")).where(_fits(similarity)[0] & (F.col("set1") != F.col("set2")))
    return met.select(F.greatest("set1", "set2").alias("u"), F.least("set1", "set2").alias("v"), F.lit(True).alias("long"))


def _lead_pairs(profiles: DataFrame, similarity: float, k: int, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of each set with one set of those that agree in one of LEADS least hashes, where fingerprints
    differ in more than ``k`` bits: a few a row."""
    columns = ("node", "n", "bits", "brief")
    keyed = profiles.select(*columns, F.posexplode("leads").alias("part", "lead"))
    keyed = scratch.write(keyed.select(F.col("lead").alias("key"), *(F.col(c).alias(c + "1") for c in columns)), "leads")
    chosen = F.min_by(F.struct(*(c + "1" for c in columns)), F.xxhash64("node1", "key")).alias("head")
    heads = keyed.groupBy("key").agg(chosen, F.count(F.lit(1)).alias("size")).where("size > 1")
    heads = heads.select("key", *(F.col("head")[c + "1"].alias(c + "2") for c in columns))
    met = join_spread(keyed, scratch.write(heads, "heads"), "key", max(1, keyed.count()))
    met = met.where(_fits(similarity)[0] & (F.col("node1") != F.col("node2")) & (F.bit_count(F.col("bits1").bitwiseXOR(F.col("bits2"))) > k))
    return met.select(F.greatest("node1", "node2").alias("u"), F.least("node1", "node2").alias("v"), F.lit(True).alias("long"))


def _with_component(profiles: DataFrame, found: DataFrame) -> DataFrame:
    """Profiles with the component of their node, its own number where it has no link. Only rows that a Bloom filter
    of the linked nodes passes are joined, so the prefixes of the others stay where they are."""
    blocks = bloom.block_count(found.count())
    flagged = bloom.possible(profiles, F.col("node"), bloom.build(found, "node", blocks), blocks, "__linked")
    alone = flagged.where("not __linked").drop("__linked").withColumn("component", F.col("node"))
    linked = flagged.where("__linked").drop("__linked").join(found, "node", "left")
    return alone.unionByName(linked.withColumn("component", F.coalesce("component", "node")))


def _open_pairs(profiles: DataFrame, similarity: float, cell: int, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of sets of different components that share a shingle of their prefixes, except those whose
    sizes, places in the order or parities rule the similarity out.

    The sets of a shingle outside its largest component meet all of them, in blocks of ``cell``.
    """
    rows = profiles.select("node", "n", "counted", "reach", "component", F.posexplode("tokens").alias("at", "token"))
    mixed = rows.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("sets"))
    mixed = scratch.write(mixed.where("a <> b").select("token", "sets"), "mixed")
    blocks = bloom.block_count(mixed.count())
    likely = bloom.possible(rows, F.col("token"), bloom.build(mixed, "token", blocks), blocks, "__mixed").where("__mixed").drop("__mixed")
    likely = scratch.write(likely, "likely")
    # places in the order: of a set's counted shingles those that aren't mixed come first, and aren't here
    placed = join_spread(likely, mixed, "token", max(1, likely.count()))
    late = F.col("at") >= F.col("counted")
    of_set = Window.partitionBy("node")
    first = F.col("counted") - F.count(F.when(~late, 1)).over(of_set)
    place = F.row_number().over(of_set.orderBy(late, F.when(~late, F.col("sets")), "token")) - 1
    placed = placed.withColumn("pos", F.when(late, F.col("at")).otherwise((first + place).cast("int")))
    # the first few of a set, of which each row keeps those before its own
    placed = placed.withColumn("place", place).withColumn("head", F.collect_list(F.when(F.col("place") < HEAD, F.struct("place", "token"))).over(of_set))
    before = F.transform(F.filter("head", lambda x: x["place"] < F.col("place")), lambda x: x["token"])
    placed = placed.where(F.col("pos") < F.col("reach")).select("token", "node", "n", "component", "pos", before.alias("before"))
    likely = scratch.write(placed, "placed")
    sizes = scratch.write(likely.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    bulk = sizes.groupBy("token").agg(
        F.max_by("component", F.struct("size", "component")).alias("bulk"), F.max("size").alias("most"), F.sum("size").alias("all")
    )
    # of some shingles only one component is left
    bulk = scratch.write(bulk.where("all > most").withColumns({"few": F.ceil((F.col("all") - F.col("most")) / cell), "many": F.ceil(F.col("all") / cell)}).drop("most", "all"), "bulks")
    met = scratch.write(join_spread(likely, bulk, "token", max(1, likely.count())), "met")
    members = scratch.write(met.join(profiles.select("node", "sketch"), "node"), "members")
    scratch.drop("mixed", "likely", "placed", "sizes", "bulks", "met")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    side = lambda x: [F.col(c).alias(c + x) for c in ("node", "n", "sketch", "component", "pos", "before")]
    left = members.where("component <> bulk").select("token", block("few").alias("i"), every("many").alias("j"), *side("1"))
    right = members.select("token", every("few").alias("i"), block("many").alias("j"), *side("2"))
    fits, least = _fits(similarity, sketch=True)
    possible = (
        (F.col("component1") != F.col("component2"))
        & (F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) >= least)
        & fits
        & ~F.arrays_overlap("before1", "before2")  # else they met before, under the same bounds
    )
    on = [left[c] == right[c] for c in ("token", "i", "j")]
    met = left.join(right, on[0] & on[1] & on[2] & possible)
    long = F.greatest("n1", "n2") > 64 * SKETCH
    return met.select(F.greatest("node1", "node2").alias("u"), F.least("node1", "node2").alias("v"), long.alias("long"))


def similar_documents(docs: DataFrame, similarity: float = 0.8, words: int = 5, cell: int = 512) -> DataFrame:
    """doc_id, text_hash, component_id, kept of every row: components of texts whose sets of word shingles have
    this Jaccard similarity or more.

    Every link is verified on the shingle sets (64-bit hashes), and none is missed:

    1. Each set has a SimHash fingerprint. The Gray-order index of ``near_duplicates`` links those at RADIUS or fewer
       differing bits, and each pair of its forest is compared exactly.
    2. No radius takes all sets of this similarity, so the rest has an exact way. Beyond RADIUS each set is compared
       with one of those that agree in a least hash, which joins most copies early.
    3. Sets of this similarity share a shingle of their prefixes in any fixed order of shingles. Here those with a low
       hash come first: those that no two components have (they make nothing meet), then the others by the number
       of sets that have them, so texts don't meet by a passage that many share. All pairs across components that
       meet are compared, but for those that exact bounds rule out: sizes, places in the order, and parities of the
       sets (a fingerprint of a bit a shingle, folded to one length).

    Shingles of many texts are split into blocks of ``cell``. The other rules of ``near_duplicates`` hold here too:
    texts without words are one component, and texts with fewer words than a shingle are one shingle.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "similar")
    view = documents_view(docs).withColumn("text_hash", F.xxhash64("text"))
    total = view.count()
    schema = "doc_id bigint, text_hash bigint, node bigint, n int, bits bigint, brief bigint, odd array<bigint>, leads array<bigint>, counted int, reach int, sketch array<bigint>, tokens array<bigint>"
    rows = scratch.write(view.mapInArrow(_profiles(words, similarity), schema), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    classes = scratch.write(rows.groupBy("node").agg(first.alias("least")), "classes")
    profiles = rows.drop("doc_id", "text_hash")
    if classes.count() < total:  # sets that several rows have are one profile
        profiles = scratch.write(profiles.groupBy("node").agg(*(F.any_value(c).alias(c) for c in profiles.columns if c != "node")), "profiles")
    early = _print_pairs(profiles, similarity, RADIUS, scratch).unionByName(_lead_pairs(profiles, similarity, RADIUS, scratch))
    edges = _verified(early, profiles, view, classes, words, similarity, scratch, "first")
    scratch.drop("leads", "heads", "print-heads", "print-links")
    found = components(edges)
    found = scratch.write(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()), "found")
    placed = _with_component(profiles.drop("leads", "odd", "bits"), found)
    edges = edges.unionByName(_verified(_open_pairs(placed, similarity, cell, scratch), profiles, view, classes, words, similarity, scratch, "second"))
    scratch.drop("members", "found", "profiles")
    named = _named(classes, components(edges), "node")
    names = rows.select("doc_id", "text_hash", "node")
    every = join_spread(names, named, "node", max(1, total))
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    done = scratch.write(every.select("doc_id", "text_hash", F.col("least.doc_id").alias("component_id"), kept.alias("kept")), "done")
    scratch.drop("rows", "classes", "first-edges", "second-edges")
    return done


def drop_near_duplicates(docs: DataFrame, similarity: float | None = 0.8) -> DataFrame:
    """``docs`` with one document of each component, all columns as they are: of similar texts, or of
    fingerprints at two or fewer differing bits where ``similarity`` is None."""
    found = materialize(near_duplicates(docs), "near-duplicates") if similarity is None else similar_documents(docs, similarity)
    hashed = docs.withColumn(DROP_KEY, F.xxhash64(F.coalesce("text", F.lit(""))))
    return drop_rows(hashed, found.where("not kept").select("doc_id", "text_hash"), found.where("kept").select("doc_id", "text_hash"))
