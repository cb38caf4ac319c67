"""Similar texts held against brute force: exact Jaccard similarity of shingle sets and union-find."""

import random
import re

import numpy as np
import pytest

from crossbar.llm import simhash
from crossbar.llm.simhash import candidates, drop_near_duplicates, folded, parities, shingle_set, similar_documents


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_components(rows, similarity=0.8):
    """Smallest id reachable for each (id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= similarity:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(i, least.get(find(a), i))
    return {i: least[find(a)] for a, (i, _) in enumerate(rows)}


def invented(rng, n):
    return ["".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(n)]


def copy_of(words, low, high, rng):
    """The words with so many replaced that the similarity is between the bounds."""
    while True:
        copy = list(words)
        while (now := jaccard(shingles(" ".join(words)), shingles(" ".join(copy)))) >= high:
            copy[rng.randrange(len(copy))] = invented(rng, 1)[0]
        if now >= low:
            return copy


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def components(df, **how):
    return {r.doc_id: r.component_id for r in similar_documents(df, **how).collect()}


def test_texts_below_the_threshold_stay(spark):
    rng = random.Random(21)
    texts = []
    for i in range(60):
        words = invented(rng, 300)
        texts += [" ".join(words), " ".join(copy_of(words, 0.74, 0.795, rng))]
    rows = list(enumerate(texts))
    assert components(frame(spark, rows)) == {i: i for i, _ in rows}
    assert drop_near_duplicates(frame(spark, rows)).count() == len(rows)


def planted(rng):
    """Pairs on both sides of the threshold, chains, short texts and texts that share a common passage."""
    line = " ".join(invented(rng, 30))
    texts = [None, "", " \n", "one", "One", "one two", "a b c d", "a b c d e", "A B c d e f"]
    for i in range(40):
        words = invented(rng, rng.choice([60, 150, 400]))
        texts += [" ".join(words), " ".join(copy_of(words, 0.72, 0.795, rng))]
        words = invented(rng, rng.choice([60, 150, 400]))
        near = copy_of(words, 0.80, 0.85, rng)
        texts += [" ".join(words), " ".join(near), " ".join(copy_of(near, 0.80, 0.85, rng))]
        words = invented(rng, 9)
        texts += [" ".join(words), " ".join(words[:8]), " ".join(words[:7])]  # 4 of 5 shingles: just 0.8
        texts += [f"{line} {' '.join(invented(rng, k))}" for k in (1, 5, 9, 60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def test_links_by_brute_force(spark):
    rows = planted(random.Random(22))
    want = brute_components(rows)
    for cell in (512, 3):
        assert components(frame(spark, rows), cell=cell) == want


def test_filters_lose_no_pair():
    rng = random.Random(23)
    for _ in range(300):
        n = rng.choice([1, 2, 4, 5, 9, 10, 50, 300])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), rng.randint(max(1, n * 3 // 4), n))) | {rng.getrandbits(64) for _ in range(rng.randint(0, n // 4))}
        a, b = (np.array(sorted(x), np.uint64) for x in (a, b))
        both = len(np.intersect1d(a, b))
        if both / (len(a) + len(b) - both) >= 0.8:
            first = {}  # prefixes in an order of low hashes by any weight, then the others by hash
            for one in (a, b):
                tokens, counted, reach = candidates(one, 0.8)
                assert reach == len(one) - int(np.ceil(0.8 * len(one) - 1e-9)) + 1 <= len(tokens)
                first[id(one)] = {*sorted(tokens[:counted].tolist(), key=lambda t: (t % 7, t))[:reach], *tokens[counted:reach].tolist()}
            assert first[id(a)] & first[id(b)]
        x, y = parities(a), parities(b)
        for size in {1, min(len(x), len(y))}:
            assert np.bitwise_count(folded(x, size) ^ folded(y, size)).sum() <= len(a) + len(b) - 2 * both
    assert len(shingle_set(b"", 5)) == 0 and len(shingle_set(b"a b", 5)) == 1 and len(shingle_set(b"A b c d e a b c d e", 5)) == 5


def test_a_shared_passage_does_not_make_texts_meet(spark, monkeypatch):
    """Texts with one passage in common are no candidates of each other: none are compared in the second step."""
    rng = random.Random(27)
    line = " ".join(invented(rng, 60))
    texts = [f"{' '.join(invented(rng, 120))} {line} {' '.join(invented(rng, 120))}" for _ in range(150)]
    met, write = {}, simhash.Scratch.write
    monkeypatch.setattr(simhash.Scratch, "write", lambda self, df, name: met.setdefault(name, write(self, df, name).persist()))
    assert components(frame(spark, list(enumerate(texts)))) == {i: i for i in range(150)}
    assert met["mixed"].count() > 5 and met["second-met"].count() < 20


def test_the_fingerprint_index_links_near_copies(spark, monkeypatch):
    """Without the way for the rest, the links are those of fingerprints at RADIUS or fewer differing bits, verified."""
    rng = random.Random(29)
    texts = [" ".join(invented(rng, 9))] * 2
    for i in range(60):
        words = invented(rng, 200)
        texts += [" ".join(words), " ".join(copy_of(words, 0.95, 0.99, rng)), " ".join(copy_of(words, 0.80, 0.85, rng))]
    rows = list(enumerate(texts))
    prints = [simhash.set_fingerprint(shingle_set(t.encode(), 5)) for t in texts]
    sets = [shingles(t) for t in texts]
    want = {i: i for i, _ in rows}
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS:
                assert jaccard(sets[a], sets[b]) >= 0.8
                want = {i: want[b] if c == want[a] else c for i, c in want.items()}
    least = {}
    for i, c in want.items():
        least.setdefault(c, i)
    assert len(least) < len(rows) - 20
    none = lambda *a: spark.createDataFrame([], "u bigint, v bigint, long boolean")
    monkeypatch.setattr(simhash, "_lead_pairs", none)
    monkeypatch.setattr(simhash, "_open_pairs", none)
    assert components(frame(spark, rows)) == {i: least[c] for i, c in want.items()}


def test_pipeline_keeps_what_brute_force_keeps(spark, tmp_path):
    """The kept documents hang on links near the threshold and on the least doc_id of each component."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = planted(random.Random(24))
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(rows[:20])]  # exact copies
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    # without labels nothing is toxic
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t or "", i)
    want = brute_components([(i, t) for t, i in first.items()])
    got = pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
    assert {r.doc_id for r in got} | {want[first[""]]} == set(want.values())


def test_every_stage_by_plain_rules(spark, tmp_path):
    """Each stage's rows against a plain rewrite, on what the stage before it kept."""
    pipeline = pytest.importorskip("corpus_pipeline")
    import zlib

    import public_tokenizers
    from test_filters_search import plain_features
    from tokenizers import Tokenizer

    from crossbar.llm.toxicity import fit_toxicity

    rng = random.Random(31)
    rows = planted(rng)
    clean = len(rows)
    for i in range(clean, clean + 400):
        words = invented(rng, 40)
        if i % 4 == 0:
            words[3], words[20], words[30] = "you", rng.choice(["idiot", "moron", "scum"]), "stupid"
        rows.append((i, " ".join(words)))
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(rows[:30])]
    docs = spark.createDataFrame([(i, t, "en", "web", 5) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(clean, clean + 400)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages, folder = dict(pipeline.STAGES), str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    model = fit_toxicity(docs, labels)
    words = model.lexicon().words
    insults = {w: x for w, (kind, x) in words.items() if kind == 1}
    weights = np.array(model.weights)
    score = lambda t: 1 / (1 + np.exp(-np.clip(np.array(plain_features(t or "", insults, model.stems)) @ weights[:-1] + weights[-1], -30, 30)))
    want = {i: t for i, t in rows if score(t) < 0.3}
    step = stages["toxicity"](spark, docs, folder).persist()
    assert {r.doc_id: r.text for r in step.collect()} == want and 0 < len(rows) - len(want) < 130
    assert not any(i % 4 == 0 for i in want if clean <= i < clean + 400)

    first = {}
    for i, t in sorted(want.items()):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), i)
    step = stages["exact_dedup"](spark, step, folder).persist()
    assert step.columns == docs.columns and {r.doc_id for r in step.collect()} == set(first.values())

    kept = [(r.doc_id, r.text) for r in step.collect()]
    near = brute_components(kept)
    step = stages["simhash_near_dedup"](spark, step, folder).persist()
    assert step.columns == docs.columns and {r.doc_id for r in step.collect()} == set(near.values())

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages["packing"](spark, step, folder).toPandas()
    assert set(pieces.doc_id) == set(near.values())
    for doc, own in pieces.groupby("doc_id"):
        own = own.sort_values("start")
        ids = np.array([*library.encode(dict(kept)[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 4096
