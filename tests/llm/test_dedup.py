import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from crossbar.llm.exact_dedup import compact, drop_exact_duplicates, exact_dedup, flush, lookup
from crossbar.llm.simhash import (
    GrayTree,
    components,
    drop_near_duplicates,
    fingerprint,
    gray_rank,
    link_edges,
    near_duplicates,
    similar_documents,
)

TEXTS = [
    (1, "a  b\n c"), (2, "a b c"), (3, " a b c"), (4, None), (5, ""), (6, " "), (7, "\t\n "), (8, "long " * 20_000),
    (9, "long  " * 20_000), (10, "x"), (10, "x"), (12, "x"), (None, "y"), (None, "y"), (13, "only"), (14, "a b"), (15, "a b"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, "k", False) for i, t in rows], "doc_id bigint, text string, keep_id int, digest string, kept boolean")


@pytest.mark.parametrize("digest_bytes", [32, 0, 1])
def test_exact_dedup(spark, digest_bytes):
    # no digest at all: every text collides and is told apart by its bytes
    rows = exact_dedup(frame(spark, TEXTS), digest_bytes).collect()
    assert len(rows) == len(TEXTS)
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    want = {hashlib.sha256(b.encode()).hexdigest(): (min((i for i in g if i is not None), default=None), len(g)) for b, g in groups.items()}
    for r in rows:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    kept = [r.text_sha256 for r in rows if r.kept]
    assert sorted(kept) == sorted(want)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


@pytest.mark.parametrize("splits", [1, 3, 9])
def test_levels_of_the_query(spark, monkeypatch, splits):
    from crossbar.llm import exact_dedup as module

    made = []
    monkeypatch.setattr(module, "compact", lambda runs, folder, level=None: made.append(level) or compact(runs, folder, level))
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(300)]), f"copy {rng.randint(0, 9)}" if rng.random() < 0.4 else f"text {rng.randint(0, 900)}") for _ in range(900)]
    got = exact_dedup(frame(spark, rows).repartition(splits)).collect()
    assert len(made) == min(splits, module.BATCHES) and made[0] is None and all(x is not None for x in made[1:])
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
    want = {d: (min((i for i in g if i is not None), default=None), len(g)) for d, g in groups.items()}
    assert len(got) == len(rows) and all((r.keep_id, r.group_size) == want[r.text_sha256] for r in got)
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(want)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_dropping(spark):
    left = drop_exact_duplicates(frame(spark, TEXTS))
    assert left.columns == ["doc_id", "text", "keep_id", "digest", "kept"]
    groups = {re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in TEXTS}
    assert left.count() == len(groups)
    assert exact_dedup(frame(spark, [])).count() == 0 and drop_exact_duplicates(frame(spark, [])).count() == 0


def test_levels_of_several_batches(spark, tmp_path):
    rng = random.Random(5)
    batches = [[(rng.randint(0, 400) if rng.random() < 0.9 else None, f"t{rng.randint(0, 150)}") for _ in range(300)] for _ in range(3)]
    level, every = None, []
    for b, rows in enumerate(batches):
        runs = flush(frame(spark, rows), str(tmp_path / f"runs{b}"), batch=b)
        level = compact(runs, str(tmp_path / f"level{b}"), level)
        every += rows
        groups = {}
        for i, t in every:
            groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
        got = {bytes(r.digest).hex(): (r.keep.doc_id, r.group_size) for r in level.collect()}
        assert got == {d: (min((i for i in g if i is not None), default=None), len(g)) for d, g in groups.items()}
    some = [*groups][:3]
    assert {bytes(r.digest).hex() for r in lookup(level, [*some, "00" * 32]).collect()} == set(some)
    assert lookup(runs, some).count() == sum(hashlib.sha256(t.encode()).hexdigest() in some for _, t in batches[-1])


def plain_fingerprint(text):
    words = [w for w in re.split(b"[\x20\x09-\x0d]+", text.encode().lower()) if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(items, k):
    """Smallest id reachable for each (id, fingerprint)."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if (items[a][1] ^ items[b][1]).bit_count() <= k:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(items):
        least[find(a)] = min(i, least.get(find(a), i))
    return [least[find(a)] for a in range(len(items))]


def test_fingerprint():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("abC éÀ\n\t\x1c ") for _ in range(rng.randint(0, 60)))
        assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_near_duplicates(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "one", "one two", "One  two", "w" * 5000]
    for _ in range(12):
        words = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(300)]
        for _ in range(6):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(300)] = "changed"
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id bigint, text string, component_id string")
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    items = [(i, plain_fingerprint(t or "")) for i, t in enumerate(texts)]
    assert [got[i].component_id for i in range(len(texts))] == brute(items, 2)
    assert all(got[i].fingerprint == f"{f:016x}" for i, f in items)
    assert drop_near_duplicates(df, None).count() == len({r.component_id for r in got.values()})
    empty = df.limit(0)
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "q"), (None, "q"), (3, "r"), (3, "r"), (3, "other text here")], "doc_id bigint, text string")
    assert near_duplicates(odd).count() == 5 and drop_near_duplicates(odd, None).count() == 3


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_similar_documents(spark):
    """Copies above the threshold are one group, texts well below it are not; cells may be small or crowded."""
    rng = random.Random(9)
    texts, groups = [None, "", "lone word", "Lone  WORD"], [0, 0, 1, 1]
    for g in range(60):
        words = ["".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(400)]
        for _ in range(rng.randint(1, 4)):
            copy = list(words)
            for _ in range(6):  # about 0.86 similar to the first
                copy[rng.randrange(400)] = "edit" + str(rng.random())
            texts.append(" ".join(words if not groups or groups[-1] != 10 + g else copy))
            groups.append(10 + g)
        half = words[:200] + ["".join(rng.choice("lmnop") for _ in range(5)) for _ in range(200)]
        texts.append(" ".join(half))  # a third similar: not a copy
        groups.append(1000 + g)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id bigint, text string, component_id string")
    for cell in (512, 8):
        got = {r.doc_id: r.component_id for r in similar_documents(df, cell=cell).collect()}
        first = {}
        for i, g in enumerate(groups):
            first.setdefault(g, i)
        assert [got[i] for i in range(len(texts))] == [first[g] for g in groups]
    left = drop_near_duplicates(df)
    assert left.columns == df.columns and left.count() == len(set(groups))
    assert drop_near_duplicates(df.limit(0)).count() == 0 and similar_documents(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "q"), (None, "q"), (3, "r"), (3, "r"), (3, "other text here")], "doc_id bigint, text string")
    assert similar_documents(odd).count() == 5 and drop_near_duplicates(odd).count() == 3


def test_crowded_cells_lose_no_link(spark):
    rng = random.Random(6)
    codes = {rng.getrandbits(64) for _ in range(300)}
    ball = rng.getrandbits(64)
    while len(codes) < 1300:  # one dense group and random others
        codes.add(ball ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 4))))
    codes = sorted(codes)
    signed = [(c - (1 << 64) if c >> 63 else c) for c in codes]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(signed)], "node bigint, bits bigint")
    want = brute(list(enumerate(codes)), 2)
    for cell, block in ((4096, 8192), (64, 100), (4096, 200)):
        found = {r.node: r.component for r in components(link_edges(df, 2, cell, block)).collect()}
        assert [found.get(i, i) for i in range(len(codes))] == want


def test_gray_tree():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 14, 2000).astype(np.uint64) << np.uint64(20))
    assert sorted(gray_rank(np.arange(64, dtype=np.uint64)).tolist()) == list(range(64))
    pairs = {(a, b) for q, p in GrayTree(codes).within(codes, 2) for a, b in zip(q.tolist(), p.tolist())}
    far = np.bitwise_count(codes[:, None] ^ codes[None, :])
    assert pairs == set(zip(*(x.tolist() for x in np.nonzero(far <= 2))))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)], "u bigint, v bigint")
    found = {r.node: r.component for r in components(edges).collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and found[101] == found[102] == 100
