"""Operator 3: nearest neighbours by inner product with vantage-point trees, one a shard.

Vectors x with norm at most M become points (x, sqrt(M^2 - |x|^2)), a query q becomes (q, 0): the nearest
point is then the one with the largest inner product, and the triangle inequality holds. In a tree a
subtree is skipped if its least possible distance, times ``relax``, is beyond the k-th best so far.
``relax`` 1 is the exact search; more skips more.

1. Shards are the leaves of a small tree over a bounded sample (at most SAMPLE_POINTS points a shard and
   SAMPLE_VALUES numbers); every vector is placed in one. Crowded leaves are dealt out to several shards.
2. Each shard's tree is built once and written to the shared folder as a file, each block of queries as another.
3. Each query first visits the leaf whose centre is nearest. Its k-th best there bounds the second visit, to
   the leaves only that the triangle inequality leaves over, where the search starts from that bound.

Equal vectors are one point with its k + 1 smallest ids: a larger id of the same vector can't be among the
k nearest of any query, which loses at most its own row. A task holds one shard and one block of queries,
whatever the size of the table. A visit is a row of numbers: neither vectors nor trees are shuffled with it. Its task reads
the tree once for PAGE blocks of queries, and of each block the queries that visit.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .common import fresh_path, materialize, prepare
from .token_store import _read as read_file
from .token_store import _write as write_file

LEAF = 256
#: Leaves of the tree over the sample at most; sample points for each; numbers in the sample at most.
MOST_LEAVES, SAMPLE_POINTS, SAMPLE_VALUES = 4096, 16, 8_000_000
#: Blocks of queries for which a task reads a tree once.
PAGE = 16
#: Tasks of a search at most; each has one tree and page or several.
MOST_TASKS = 1 << 14
#: Rounding that a matrix product may add to a score, as a share of the product of the norms.
SLACK = 1e-10


class VantageTree:
    """Points in rows; inner children hold the half that is nearer to the vantage point."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.leaf, self.rng = leaf, np.random.default_rng(seed)
        self.root = self._build(points, np.arange(len(points)))

    def _build(self, points: np.ndarray, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        some = points[self.rng.choice(rows, size=min(64, len(rows)), replace=False)]
        far = np.linalg.norm(some[:, None, :] - some[None, :, :], axis=2).var(axis=1)
        vantage = some[int(far.argmax())]
        away = np.linalg.norm(points[rows] - vantage, axis=1)
        middle = np.median(away)
        inside = away <= middle
        if inside.all():
            return rows
        a, b = away[inside], away[~inside]
        return (vantage, middle, (a.min(), a.max()), (b.min(), b.max()), self._build(points, rows[inside]), self._build(points, rows[~inside]))

    def leaves(self) -> list[np.ndarray]:
        """Rows of each leaf, from the inside out."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, np.ndarray):
                out.append(node)
            else:
                todo += [node[5], node[4]]
        return out

    def place(self, points: np.ndarray) -> np.ndarray:
        """Number of the leaf that each point falls in."""
        out, number = np.zeros(len(points), np.int64), 0
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, who = todo.pop()
            if isinstance(node, np.ndarray):
                out[who] = number
                number += 1
                continue
            inside = np.linalg.norm(points[who] - node[0], axis=1) <= node[1]
            todo += [(node[5], who[~inside]), (node[4], who[inside])]
        return out


def lifted(vectors: np.ndarray, bound: float) -> np.ndarray:
    """The points of vectors whose squared norms are at most ``bound``."""
    lift = np.sqrt(np.maximum(bound - (vectors**2).sum(axis=1), 0.0))
    return np.concatenate([vectors, lift[:, None]], axis=1)


def radius(base: np.ndarray, worst: np.ndarray) -> np.ndarray:
    """Distance of a point with the score ``worst`` (with some room for rounding)."""
    return np.sqrt(np.maximum(base - 2 * worst, 0.0)) * (1 + 1e-9) + 1e-7


class Search:
    """The k best rows of a tree for many queries at once: each node is met by all queries that reach it.

    Ties of scores go to the smaller of ``ids``; rows that score below ``floor`` may be left out.
    """

    def __init__(self, tree: VantageTree, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, bound: float, k: int, relax: float, floor: np.ndarray | None = None):
        self.tree, self.vectors, self.ids, self.queries, self.k, self.relax = tree, vectors, ids, queries, k, relax
        square = (queries**2).sum(axis=1)
        self.base, self.slack = square + bound, SLACK * np.sqrt(square * bound)
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor
        self.best = np.full((len(queries), k), -np.inf)
        self.rows = np.full((len(queries), k), -1, np.int64)
        self.visited = 0
        self._visit(tree.root, np.arange(len(queries)))

    def _worst(self, who: np.ndarray) -> np.ndarray:
        return np.maximum(self.best[who, -1], self.floor[who])

    def _visit(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            self._scan(node, who)
            return
        vantage, middle, near, far, inner, outer = node
        width = self.queries.shape[1]
        away = np.sqrt(np.maximum((self.queries[who] ** 2).sum(axis=1) - 2 * self.queries[who] @ vantage[:width] + vantage @ vantage, 0.0))
        first = away <= middle
        self._visit(inner, who[first])
        self._visit(outer, who[~first])
        for child, span, left in ((outer, far, first), (inner, near, ~first)):
            rest, d = who[left], away[left]
            least = np.maximum(np.maximum(span[0] - d, d - span[1]), 0.0)
            self._visit(child, rest[least * self.relax <= radius(self.base[rest], self._worst(rest))])

    def _scan(self, rows: np.ndarray, who: np.ndarray) -> None:
        self.visited += len(rows) * len(who)
        for a in range(0, len(who), 2048):
            some = who[a : a + 2048]
            rough = self.queries[some] @ self.vectors[rows].T
            limit = self._worst(some)
            if len(rows) > self.k:
                limit = np.maximum(limit, np.partition(rough, -self.k, axis=1)[:, -self.k])
            q, r = np.nonzero(rough >= (limit - self.slack[some])[:, None])
            # scores in one fixed order of summation, so that equal ones are equal
            q, r = some[q], rows[r]
            score = (self.queries[q] * self.vectors[r]).sum(axis=1)
            old = np.nonzero(self.rows[some] >= 0)
            q = np.concatenate([some[old[0]], q])
            score = np.concatenate([self.best[some][old], score])
            r = np.concatenate([self.rows[some][old], r])
            order = np.lexsort((self.ids[r], -score, q))
            q, score, r = q[order], score[order], r[order]
            at = np.arange(len(q)) - np.searchsorted(q, q)
            top = at < self.k
            self.best[q[top], at[top]], self.rows[q[top], at[top]] = score[top], r[top]


# --- jobs ---------------------------------------------------------------------------------------------

_FOUND = "q1 bigint, q2 bigint, vec_id bigint, score double"
_TREE = "dim int, shard int, part int, points bigint"
_BLOCK = "dim int, block int, queries bigint"
_VISIT = "q1 bigint, q2 bigint, dim int, block int, floor double, shard int, part int"


def _matrix(lists: pa.Array | pd.Series) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(lists, pa.Array):
        return lists.flatten().to_numpy().reshape(len(lists), -1).astype(np.float64)
    return np.stack(lists.to_list()).astype(np.float64)


def _build(bound: float, folder: str):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort((pdf["least"].to_numpy(), pdf["h"].to_numpy()))]
        vectors = _matrix(pdf["v"])
        ids = [np.asarray(x, np.int64) for x in pdf["ids"]]
        write_file(f"{folder}/tree-{key[0]}-{key[1]}-{key[2]}", pickle.dumps((VantageTree(lifted(vectors, bound)), vectors, ids)))
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "part": [key[2]], "points": [len(pdf)]})

    return run


def _shelve(folder: str):
    """A block of queries as a file."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["q1", "q2"])
        write_file(f"{folder}/queries-{key[0]}-{key[1]}", pickle.dumps((pdf["q1"].to_numpy(), pdf["q2"].to_numpy(), _matrix(pdf["v"]))))
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "queries": [len(pdf)]})

    return run


def _search(k: int, relax: float, bound: float, folder: str):
    held: dict = {}  # the tree of the shard at hand

    def run(key: tuple, visits: pd.DataFrame) -> pd.DataFrame:
        dim, shard, part, _, block = key
        path = f"{folder}/tree-{dim}-{shard}-{part}"
        if path not in held:
            held.clear()
            held[path] = pickle.loads(read_file(path))
        tree, vectors, ids = held[path]
        q1, q2, asked = pickle.loads(read_file(f"{folder}/queries-{dim}-{block}"))
        asked = asked[pd.MultiIndex.from_arrays([q1, q2]).get_indexer(pd.MultiIndex.from_frame(visits[["q1", "q2"]]))]
        floor = visits["floor"].fillna(-np.inf).to_numpy(np.float64)
        found = Search(tree, vectors, np.array([x[0] for x in ids]), asked, bound, k, relax, floor)
        q, at = np.nonzero(found.rows >= 0)
        members = [ids[r] for r in found.rows[q, at]]
        sizes = np.array([len(x) for x in members], np.int64)
        q, score, vec_id = np.repeat(q, sizes), np.repeat(found.best[q, at], sizes), np.concatenate([*members, np.zeros(0, np.int64)])
        order = np.lexsort((vec_id, -score, q))
        q, score, vec_id = q[order], score[order], vec_id[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        q = q[top]
        return pd.DataFrame({"q1": visits["q1"].to_numpy()[q], "q2": visits["q2"].to_numpy()[q], "vec_id": vec_id[top], "score": score[top]})

    return run


def _place(router: VantageTree, dim: int, bound: float, centres: np.ndarray):
    """The leaf of each vector and its distance from the leaf's centre; vectors of other lengths have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = np.flatnonzero(batch.column("dim").to_numpy() == dim)
            leaf, away = np.full(len(batch), -1, np.int32), np.zeros(len(batch))
            if len(here):
                points = lifted(_matrix(batch.column("v").take(pa.array(here))), bound)
                leaf[here] = router.place(points)
                away[here] = np.linalg.norm(points - centres[leaf[here]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(away)], names=[*batch.schema.names, "leaf", "away"])

    return run


def _visits(dim: int, shards: int, bound: float, centres: np.ndarray, spans: np.ndarray, parts: np.ndarray, relax: float, first: bool):
    """A row for each shard of each leaf that a query visits: the one with the nearest centre, or all others that may hold better."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (centres**2).sum(axis=1)
        for batch in (b.slice(a, 256) for b in batches for a in range(0, b.num_rows, 256)):
            dims = batch.column("dim").to_numpy()
            rows, leaves = [], []
            other = np.flatnonzero(dims != dim)
            if first:  # vectors of lengths that the sample lacks meet all shards of their length at once
                rows.append(np.repeat(other, shards)), leaves.append(np.tile(np.arange(shards), len(other)))
            here = np.flatnonzero(dims == dim)
            if len(here):
                q = _matrix(batch.column("v").take(pa.array(here)))
                norm = (q**2).sum(axis=1)
                away = np.sqrt(np.maximum(norm[:, None] - 2 * q @ centres[:, :-1].T + square, 0.0))
                home = np.where(spans[:, 1] >= 0, away, np.inf).argmin(axis=1)
                if first:
                    rows.append(here), leaves.append(home)
                else:
                    floor = np.nan_to_num(batch.column("floor").take(pa.array(here)).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf, neginf=-np.inf)
                    least = np.maximum(np.maximum(spans[:, 0] - away, away - spans[:, 1]), 0.0)
                    may = (least * relax <= radius(norm + bound, floor)[:, None]) & (spans[:, 1] >= 0)
                    may[np.arange(len(here)), home] = False
                    a, b = np.nonzero(may)
                    rows.append(here[a]), leaves.append(b)
            at, shard = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (rows, leaves))
            times = np.where(dims[at] == dim, parts[np.minimum(shard, len(parts) - 1)], 1)
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at, shard = pa.array(np.repeat(at, times)), pa.array(np.repeat(shard, times).astype(np.int32))
            names = ["q1", "q2", "dim", "block", "floor"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), shard, pa.array(part.astype(np.int32))], names=[*names, "shard", "part"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of vectors without null, non-finite or only zero components."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & fine & F.exists(v, lambda x: x != 0)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0).cast("float")).alias("v")
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k hits of each query."""
    order = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("r", order).where(F.col("r") <= k).drop("r")


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, relax: float = 1.0, shard_rows: int = 8192, block_rows: int = 4096
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows to each row whose vec_id is divisible by ``every``.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
    do null vec_ids; a query meets only vectors of its own length; its own vec_id is never a candidate; ties
    go to the smaller vec_id, also between different vectors; repeated rows count once; fewer than k candidates
    give fewer rows; an empty table gives none; other columns are never read.
    """
    prepare(vectors.sparkSession)
    rows = usable(vectors).where("vec_id is not null").distinct()
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    classes = (
        rows.withColumn("r", rank)
        .where(F.col("r") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumns({"h": F.xxhash64("v"), "least": F.element_at("ids", 1), "dim": F.size("v")})
    )
    classes = materialize(classes, "vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    query = asked.groupBy("v").agg(F.min("vec_id").alias("q2")).withColumns({"q1": F.xxhash64("v"), "dim": F.size("v")})
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, bound, dim = classes.agg(F.count(F.lit(1)), F.max(square), F.mode("dim")).first()
    bound, dim, shards = bound or 0.0, dim or 0, max(1, -(-n // shard_rows))
    blocks = max(1, -(-query.count() // block_rows))
    query = query.withColumns({"block": F.pmod("q1", F.lit(blocks)).cast("int"), "floor": F.lit(None).cast("double")})
    query = materialize(query, "queries")
    folder = fresh_path(vectors.sparkSession, "vantage")
    query.select("dim", "block", "q1", "q2", "v").groupBy("dim", "block").applyInPandas(_shelve(folder), _BLOCK).agg(F.sum("queries")).collect()

    leaves = min(shards, MOST_LEAVES)
    some = classes.where(F.col("dim") == dim).orderBy("h", "least").limit(max(1, min(leaves * SAMPLE_POINTS, SAMPLE_VALUES // max(1, dim))))
    points = lifted(_matrix(pd.Series([np.array(r["v"]) for r in some.select("v").collect()])), bound) if n else np.zeros((1, 1))
    router = VantageTree(points, leaf=max(1, -(-len(points) // leaves)))
    centres = np.array([points[x].mean(axis=0) for x in router.leaves()])
    wider = StructType([*classes.schema.fields]).add("leaf", IntegerType()).add("away", DoubleType())
    placed = classes.mapInArrow(_place(router, dim, bound, centres), wider)
    placed = materialize(placed, "placed")
    spans = np.tile([np.inf, -np.inf], (len(centres), 1))
    sizes = np.zeros(len(centres), np.int64)
    for r in placed.where("leaf >= 0").groupBy("leaf").agg(F.min("away"), F.max("away"), F.count(F.lit(1))).collect():  # at most 2 * MOST_LEAVES rows
        spans[r[0]], sizes[r[0]] = (r[1] - 1e-7, r[2] + 1e-7), r[3]
    parts = np.maximum(1, -(-sizes // (2 * shard_rows)))
    routed, several = F.col("leaf") >= 0, F.element_at(F.lit(parts.tolist()), F.greatest("leaf", F.lit(0)) + 1)
    placed = placed.withColumn("shard", F.when(routed, F.col("leaf")).otherwise(F.pmod("h", F.lit(shards))).cast("int"))
    placed = placed.withColumn("part", F.when(routed, F.pmod("h", several)).otherwise(0).cast("int"))
    trees = placed.select("dim", "shard", "part", "h", "least", "ids", "v").groupBy("dim", "shard", "part")
    trees = materialize(trees.applyInPandas(_build(bound, folder), _TREE), "trees")

    # a stated number: visits are few bytes and much work, and would be put together by size
    tasks = min(MOST_TASKS, max(1, trees.count()) * -(-blocks // PAGE))

    def visit(asking: DataFrame, first: bool) -> DataFrame:
        made = asking.select("q1", "q2", "v", "dim", "block", "floor").mapInArrow(_visits(dim, shards, bound, centres, spans, parts, relax, first), _VISIT)
        made = materialize(made, "visits").withColumn("page", F.floor(F.col("block") / PAGE).cast("int"))
        shard = ["dim", "shard", "part"]
        met = made.join(trees, shard, "left_semi").repartition(tasks, *shard, "page")
        found = met.groupBy(*shard, "page", "block").applyInPandas(_search(k + 1, relax, bound, folder), _FOUND)
        return materialize(_best(found, k + 1), "found")

    top = visit(query, True)
    if len(centres) > 1:
        full = top.groupBy("q1", "q2").agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("n"))
        bounded = query.join(full, ["q1", "q2"], "left").withColumn("floor", F.when(F.col("n") > k, F.col("bound")))
        top = _best(top.unionByName(visit(bounded, False)), k + 1)
    lists = top.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    lists = lists.join(query.select("q1", "q2", "v"), ["q1", "q2"])
    each = asked.join(lists, "v").select(
        F.col("vec_id").alias("query_id"),
        F.posexplode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)).alias("pos", "hit"),
    )
    return each.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
