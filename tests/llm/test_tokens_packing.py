import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crossbar.llm.bpe import bpe_roundtrip, codec
from crossbar.llm.packing import TournamentTree, first_fit_decreasing, pack_documents
from crossbar.llm.token_store import Shard, TokenStore, build_hash, encode_shard, read_token_shards, token_store, write_token_shards
from crossbar.llm.tokens import encoder, vocabulary_path

EDGE = [
    None,
    "",
    "   \n\t ",
    "Hello, world's best!",
    "<|startoftext|>a<|endoftext|> <|ENDOFTEXT|>",
    "Å ẖ H̱ ΑΣ ΟΔΟΣ ß İstanbul",
    "a\x1cb\x85c d e",
    "word " * 30_000,
    "x" * 9000,
    "日本語 🙂 ½ 12345",
    "don't can't 's'S It'S",
    "same",
    "same",
]
SCHEMA = "doc_id bigint, text string, start int, sequence_id string, DOC int"


def frame(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def ids_of(library, text, end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = "abcdefgh tionreaABCDÉéñßΣσİKÅå日本̧́\t\n  \x1c\x85 .,!?;'\"()|<>-_0123456789½🙂…"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_both_encoders_equal_the_library(library):
    bpe, chunks = codec(vocabulary_path()), encoder(vocabulary_path())
    for text in [t for t in EDGE if t is not None] + random_texts(4000, 3):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bpe.encode(text.encode()), "<u4").tolist() == want
        assert np.frombuffer(chunks.encode([text.encode()])[0], "<u4").tolist() == want
        assert bpe.decode(bpe.encode(text.encode())).decode() == library.decode(want, skip_special_tokens=False)


def test_roundtrip_operator(spark, library):
    rows = {r.doc_id: r for r in bpe_roundtrip(frame(spark, EDGE), with_ids=True).collect()}
    assert len(rows) == len(EDGE)
    for i, text in enumerate(EDGE):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert rows[i].ids == want and rows[i].n_tokens == len(want)
        assert rows[i].decoded == library.decode(want, skip_special_tokens=False)
    assert bpe_roundtrip(frame(spark, [])).count() == 0


def test_tournament_tree_is_first_fit():
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    room, want = [], []
    for w in lengths:
        b = next((i for i, r in enumerate(room) if r >= w), len(room))
        if b == len(room):
            room.append(100)
        want.append((b, 100 - room[b]))
        room[b] -= w
    assert first_fit_decreasing(lengths, 100) == want
    assert TournamentTree(1, 10).place(10) == (0, 0)


def test_packing(spark, library):
    for group_docs in (8192, 3):
        pieces = pack_documents(frame(spark, EDGE), group_docs=group_docs).toPandas()
        for i, text in enumerate(EDGE):
            own = pieces[pieces.doc_id == i].sort_values("start")
            ids = ids_of(library, text, 2)
            assert own.length.sum() == len(ids) and set(own.doc_tokens) == {len(ids)}
            for r in own.itertuples():
                assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        for _, s in pieces.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 4096
    assert pack_documents(frame(spark, [])).count() == 0
    assert pack_documents(frame(spark, ["a", "a", "b"], [None, None, 7])).count() == 3


def hot(spark, n=40_000):
    """Rows without a doc_id and rows of one doc_id, all of one length."""
    ids = F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(7).cast("bigint")
    return spark.range(0, n, 1, 16).select(ids.alias("doc_id"), F.lit("one two three").alias("text"))


def test_rows_of_one_key_are_packed_in_many_groups(spark):
    pieces = pack_documents(hot(spark), group_docs=1000)
    groups = pieces.groupBy(F.shiftright("sequence_id", 32).alias("g")).count().toPandas()
    assert len(groups) == 40 and groups["count"].max() < 1400
    assert pieces.count() == 40_000 and pieces.groupBy("sequence_id", "offset").count().where("count > 1").isEmpty()


def test_rows_of_one_key_fill_many_shards(spark, tmp_path):
    manifest = write_token_shards(hot(spark), str(tmp_path / "hot"))
    assert manifest.agg(F.sum("n_rows")).first()[0] == 40_000
    assert manifest.where("n_rows > 0").count() > 3 and manifest.agg(F.max("n_rows")).first()[0] < 20_000
    rows = read_token_shards(manifest)
    assert rows.count() == 40_000 and rows.where("doc_id is null").agg(F.max("start")).first()[0] < rows.where("doc_id = 7").agg(F.min("start")).first()[0]
    assert rows.select("start").distinct().count() == 40_000
    store = TokenStore(manifest)
    assert store.get(7) is not None and store.get(6) is None and store.get(8) is None


def test_hash_is_minimal_and_perfect():
    keys = np.array(sorted(random.Random(2).sample(range(-(1 << 60), 1 << 60), 3000)), dtype=np.int64)
    seeds, slots = build_hash(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    shard = Shard(encode_shard(keys.tolist(), [np.array([i % 50_000, 1], "<u2").tobytes() for i in range(3000)], 2))
    assert shard.rows_of(keys).tolist() == list(range(3000))
    assert shard.get(int(keys[17])).tolist() == [17, 1] and shard.get(int(keys[17]) + 1) is None
    assert Shard(encode_shard([], [], 2)).get(3) is None


def test_token_store(spark, library):
    ids = [5, 3, 99, -4, 7, 8, 9, 10, 11, 12, None, 20, 20]
    rows = token_store(frame(spark, EDGE, ids)).toPandas()
    assert len(rows) == len(EDGE) and rows.doc_id.isna().sum() == 1
    rows = rows.sort_values("start")
    assert rows.doc_id.fillna(-(10**9)).is_monotonic_increasing
    assert rows.start.tolist() == [0, *rows.n_tokens.cumsum().tolist()[:-1]]
    for doc, text in zip(ids, EDGE):
        if doc is not None and doc != 20:
            r, want = rows[rows.doc_id == doc].iloc[0], ids_of(library, text, 1)
            assert r.n_tokens == len(want) and r.ids_crc32 == zlib.crc32(want.tobytes())
    assert token_store(frame(spark, [])).count() == 0


def test_lookup_in_several_files(spark, library, tmp_path):
    manifest = write_token_shards(frame(spark, EDGE), str(tmp_path / "t"), shard_ids=100)
    assert manifest.count() > 3
    store = TokenStore(manifest)
    for i, text in enumerate(EDGE):
        assert store.get(i).tolist() == ids_of(library, text, 1).tolist()
    assert store.get(500) is None and store.get(-1) is None
    assert TokenStore(write_token_shards(frame(spark, []), str(tmp_path / "e"))).get(1) is None
    assert read_token_shards(manifest).count() == len(EDGE)
