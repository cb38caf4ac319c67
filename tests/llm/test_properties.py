"""Properties over generated inputs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crossbar.llm.bpe import codec
from crossbar.llm.packing import first_fit_decreasing
from crossbar.llm.simhash import GrayTree
from crossbar.llm.sharding import SLOTS, walk
from crossbar.llm.tokens import encoder, vocabulary_path

LIBRARY = Tokenizer.from_file(vocabulary_path())
TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_encoders_equal_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    bpe = codec(vocabulary_path())
    assert np.frombuffer(bpe.encode(text.encode()), "<u4").tolist() == want
    assert np.frombuffer(encoder(vocabulary_path()).encode([text.encode()])[0], "<u4").tolist() == want
    assert bpe.decode(bpe.encode(text.encode())).decode() == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_packing_fits_and_wastes_little(lengths):
    lengths = sorted(lengths, reverse=True)
    placed = first_fit_decreasing(lengths, 64)
    used: dict[int, int] = {}
    for (b, offset), w in zip(placed, lengths):
        assert offset == used.get(b, 0)
        used[b] = offset + w
    assert all(u <= 64 for u in used.values())
    assert len(used) <= 11 / 9 * -(-sum(lengths) // 64) + 1 or len(used) <= sum(w > 32 for w in lengths) + 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=60, unique=True), st.integers(0, 8))
def test_tree_finds_all_near_codes(codes, k):
    bits = np.array(codes, dtype=np.uint64)
    found = {(a, b) for q, p in GrayTree(bits).within(bits, k) for a, b in zip(q.tolist(), p.tolist())} if codes else set()
    assert found == {(i, j) for i, a in enumerate(codes) for j, b in enumerate(codes) if (a ^ b).bit_count() <= k}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, SLOTS - 1), st.integers(1, 50)), max_size=40), st.integers(1, 20))
def test_every_row_has_one_place(filled, shards):
    counts = [0] * SLOTS
    for slot, n in filled:
        counts[slot] += n
    places, ranks = set(), set()
    for s in walk(counts, shards):
        for i in range(s["last"] - s["first"] + 1):
            places.add((s["shard"], s["base"] + i))
            ranks.add((s["ring_slot"], s["first"] + i))
    assert len(places) == len(ranks) == sum(counts)
    sizes = [sum(p[0] == k for p in places) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(max((p[1] for p in places if p[0] == k), default=-1) == sizes[k] - 1 for k in range(shards))
