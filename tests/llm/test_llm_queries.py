"""The registered queries over the smallest tables: DuckDB where SQL can say it, brute force elsewhere."""

import glob
import os
import zlib

import duckdb
import numpy as np
import pytest

from crossbar.llm import queries
from crossbar.llm.simhash import fingerprint


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_sql(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    got = sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))
    assert got == sorted(map(repr, want.select(*cols).fetchall()))


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_nearest_by_brute_force(spark, data, duck):
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    got = queries.op3_vantage_point(spark, data).toPandas()
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        best = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        np.testing.assert_allclose(own.score, [s[ids == v][0] for v in own.vec_id], rtol=1e-12)
        hits += len({i for _, i in best} & set(own.vec_id))
    assert hits == 20 * (ids % 20 == 0).sum()


def test_simhash_by_brute_force(spark, data, duck):
    docs = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    prints = {i: fingerprint((t or "").encode()) for i, t in docs}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                u, v = sorted((find(a), find(b)))
                root[v] = u
    got = {r.doc_id: r for r in queries.op8_simhash(spark, data).collect()}
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in prints}
    assert all(r.fingerprint == f"{prints[i]:016x}" for i, r in got.items())


def test_sharding_law(spark, data, duck):
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    got = queries.op6_ring_sharding(spark, data).toPandas()
    counts = got.groupby("shard").size().reindex(range(16), fill_value=0)
    assert set(got.law) == {"rows"} and counts.max() - counts.min() <= 1 and len(got) == len(texts)
    for r in got.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
