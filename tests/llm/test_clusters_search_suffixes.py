"""Operators 11 to 13 against plain rules."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crossbar.llm import queries, suffix_dedup
from crossbar.llm.annulus import Annulus, cluster_vectors
from crossbar.llm.lexical import search, terms_of
from crossbar.llm.suffix_dedup import anchors, cut_spans, radix_groups, remove_repeats


def plain_clusters(rows, k, rounds, size, scale, seed=2):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(scale * float(np.float32(x))) for x in v]
            if max(map(abs, x)) <= 1 << 27:
                kept.append((i, x))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [x for _, x in start]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for c in set(own):
            group = [x for (_, x), o in zip(kept, own) if o == c]
            centroids[c] = [sum(col) // len(group) for col in zip(*group)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return sorted((i is None, i or 0, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found)


def got_clusters(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


VECTORS = "vec_id bigint, embedding array<float>, cluster string, distance int"


def test_clusters(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    rows += [(300 + i, [0.5, 0.5, -0.5, 0.25]) for i in range(60)]  # copies
    rows += [(400, None), (401, [1.0] * 3), (402, [1.0, None, 1.0, 1.0]), (403, [float("nan")] * 4), (404, [float("inf")] * 4), (405, [3e38] * 4), (None, [0.1] * 4), (7, [2.0] * 4)]
    rows += [(500, [0.0] * 4), (501, [1e5] * 4), (502, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)
    for k, rounds in ((9, 5), (1, 2), (40, 3)):
        assert got_clusters(cluster_vectors(df, k, rounds, size=4)) == plain_clusters(rows, k, rounds, 4, 256.0)


def test_clusters_of_few(spark):
    rows = [(i, [float(i), 1.0]) for i in range(3)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)
    assert got_clusters(cluster_vectors(df, 40, 5, size=2)) == plain_clusters(rows, 40, 5, 2, 256.0)
    empty = cluster_vectors(df.limit(0), 40, 5, size=2)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=1, max_size=12), st.lists(st.lists(st.integers(-9, 9), min_size=3, max_size=3), min_size=1, max_size=30))
def test_annulus_keeps_ties(centroids, vectors):
    c, x = np.array(centroids, np.int64), np.array(vectors, np.int64)
    number, distance, compared = Annulus(c).nearest(x)
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert number.tolist() == d.argmin(axis=1).tolist() and distance.tolist() == d.min(axis=1).tolist()
    assert compared <= len(c) * len(x)


def test_annulus_passes_few_centroids_of_other_norms():
    rng = np.random.default_rng(1)
    c = rng.normal(size=(64, 8)) * np.geomspace(10, 10_000, 64)[:, None]
    x = c[rng.integers(0, 64, 500)] + rng.normal(size=(500, 8))
    assert Annulus(c.astype(np.int64)).nearest(x.astype(np.int64))[2] < 500 * 8


def plain_search(docs, items, k):
    found = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(found(t)), len(found(t))) for i, t in docs]
    n, total = sum(s > 0 for _, _, s in bags), sum(s for _, _, s in bags)
    df = Counter(w for _, bag, _ in bags for w in bag)
    out = []
    for item, text in items:
        scored = []
        for i, bag, size in bags:
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * bag[w] // (1000 * bag[w] + 12 * (75 + 25 * size * n // total))) for w in found(text) if bag[w])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(repr, out))


def test_search(spark):
    rng = random.Random(4)
    words = ["a", "B", "c9", "é", "straße", "Ünder", "d", "e", "common"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))) + rng.choice([".", "\n", "_", " common" * 5])) for i in range(150)]
    docs += [(1000 + i, "a common common") for i in range(40)] + [(None, "a common common"), (5, "a a"), (5, "a a"), (2000, None), (2001, ""), (2002, "c9 " * 50_000)]
    items = [(1, "a b, a common"), (2, "C9-É_straße"), (3, None), (4, "absent"), (5, "common"), (5, "common"), (6, "...")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, rank int, score string")
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id bigint, text string, doc_id string")
    want = plain_search(docs, items, 7)
    for page, block in ((1 << 20, 1 << 20), (200, 300), (1, 1)):
        got = search(d, q, 7, page_bytes=page, block_bytes=block)
        assert sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in got.collect()) == want
    assert search(d.limit(0), q).count() == 0 and search(d, q.limit(0)).count() == 0
    assert terms_of("Ab_c-é".encode()) == [b"ab", b"c", "é".encode()]


def plain_removal(docs, depth):
    """docs in their order; (bytes, removed, spans, digest, rest) of each."""
    seen, out = set(), []
    for raw in docs:
        gone = bytearray(len(raw))
        for s in range(len(raw) - depth + 1):
            w = raw[s : s + depth]
            if w in seen:
                gone[s : s + depth] = b"\1" * depth
            seen.add(w)
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest(), rest))
    return out


def tricky_documents():
    rng = random.Random(11)
    text = lambda n, a="abcdefgh ": "".join(rng.choices(a, k=n))
    line, passage = text(120), text(700)
    docs = [text(900) for _ in range(20)]
    docs += [text(rng.randint(0, 80)) + line + text(rng.randint(0, 80)) for _ in range(60)]  # one line, other neighbours
    docs += [text(200) + passage[a : a + 300] + text(50) for a in range(0, 400, 37)]
    base = text(1500)
    for _ in range(15):  # near copies
        b = list(base)
        for _ in range(6):
            b[rng.randrange(len(b))] = "X"
        docs.append("".join(b))
    docs += [base, base, "long " * 3000, "a" * 5000, "ab" * 700, "", None, "short", "short", "é" * 300, text(99), line[:100], line[:99]]
    docs += ["ü" + line * 3 + "ö"]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("crowd", [4096, 3])
def test_removal(spark, crowd, monkeypatch):
    docs = tricky_documents()
    df = spark.createDataFrame([(3 * i, t, 4, "x", True) for i, t in enumerate(docs)], "doc_id bigint, text string, n_bytes int, spans string, kept boolean")
    want = plain_removal([(t or "").encode() for t in docs], 100)
    got = {r.doc_id: r for r in remove_repeats(df.repartition(3), with_text=True, crowd=crowd).collect()}
    assert len(got) == len(docs)
    for i, w in enumerate(want):
        r = got[3 * i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == w
    other = plain_removal([(t or "").encode() for t in docs], 50)
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeats(df, depth=50).collect()) == [(3 * i, w[1]) for i, w in enumerate(other)]


def test_removal_of_equal_rows(spark):
    body = "".join(random.Random(2).choices("abcdef", k=400))
    rows = [(None, body)] * 3 + [(1, "head " + body)] + [(2, body)] * 4 + [(None, "none")] * 2 + [(3, "x" * 50)] * 2 + [(0, "y" * 40)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert Counter(got) == Counter([(None, 400, 400, 1)] * 3 + [(1, 405, 0, 0)] + [(2, 400, 400, 1)] * 4 + [(None, 4, 0, 0)] * 2 + [(3, 50, 0, 0)] * 2 + [(0, 40, 0, 0)])
    alone = [(9, body)] * 3
    got = sorted((r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(alone, "doc_id bigint, text string")).collect())
    assert got == [(0, 0), (400, 1), (400, 1)]
    assert remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    body = "".join(rng.choices("abc", k=9000))
    docs = [body[:5000], "z" + body + body[2000:4000]]
    want = plain_removal([t.encode() for t in docs], 100)
    x = np.frombuffer(docs[1].encode(), np.uint8)
    whole = {int(s) for a, b in zip(*anchors(x, np.array([len(x)]), 100)[2:]) for s in range(a, b + 1)}
    assert whole == set(range(len(x) - 99))  # every window has one anchor
    batch = __import__("pyarrow").RecordBatch.from_pydict({"no_id": [False] * 2, "id": [0, 1], "tie": [1, 2], "text": [t.encode() for t in docs]})
    monkeypatch.setattr(suffix_dedup, "BUFFER", 1000)
    seen = Counter()
    for buffer, ends, owners, offsets in suffix_dedup._buffers(iter([batch]), 100):
        assert len(buffer) == ends[-1] <= 2 * 1000 + 99
        _, _, first, last = anchors(np.frombuffer(buffer, np.uint8), ends, 100)
        for a, b in zip(first.tolist(), last.tolist()):
            p = int(np.searchsorted(ends, a, "right"))
            seen.update((owners[p][1], s + int(offsets[p]) - int(ends[p - 1] if p else 0)) for s in range(a, b + 1))
    assert set(seen) == {(d, s) for d, t in enumerate(docs) for s in range(len(t) - 99)} and max(seen.values()) == 1
    got = sorted((r.doc_id, r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")).collect())
    assert got == [(i, w[1], w[2]) for i, w in enumerate(want)]


def test_radix_passes():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, 400).astype(np.uint8)
    at, group = np.arange(0, 380), rng.integers(0, 3, 380)
    rows, found = radix_groups(x, at, group, 11)
    want = Counter((int(g), x[a : a + 11].tobytes()) for a, g in zip(at, group))
    assert {int(r) for r in rows} == {i for i in range(380) if want[(int(group[i]), x[i : i + 11].tobytes())] > 1}
    keys = [(int(group[r]), x[r : r + 11].tobytes()) for r in rows]
    assert keys == sorted(keys) and len(set(zip(found.tolist(), keys))) == len(set(keys)) == len(set(found.tolist()))


def test_spans():
    assert cut_spans(b"0123456789", [(2, 4), (3, 6), (6, 7), (9, 10)]) == (6, 2, b"0178")
    assert cut_spans(b"abc", []) == (0, 0, b"abc") and cut_spans(b"abc", [(0, 3)]) == (3, 1, b"")


def test_suffix_query(spark, data):
    docs = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{data}/documents.parquet' ORDER BY doc_id").fetchall()
    want = plain_removal([t.encode() for _, t in docs], 100)
    got = {r.doc_id: r for r in queries.op13_suffix_dedup(spark, data).collect()}
    assert len(got) == len(docs)
    for (i, _), w in zip(docs, want):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w[:4]
