"""Operator 10: BPE encoding by backtracking over Aho-Corasick matches, decoding by an offset table.

A token sequence is the one that the merges give exactly if each neighbouring pair is compatible:
the merges that build the two tokens never prefer a merge across their border. So the encoder takes
the longest token at each place, checks it against the token before, tries the next shorter one where
the pair clashes, and steps back where none is left. A place that failed once is never tried again,
which keeps the time linear in the length of the word.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import documents_view, prepare
from .tokens import little_blocks, vocabulary_path

RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: Stands for the end of a word inside a search string; no byte-level character equals it.
_END = "\ue000"
_BIG = 1 << 40
_LATIN = "\u0250"


def byte_characters() -> list[str]:
    """The printable character of each byte in byte-level vocabularies.

    Printable Latin-1 stands for itself; the other bytes take the characters from 256 on, in order.
    """
    plain = {b for a, z in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(a), ord(z) + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BacktrackingBpe:
    """Ids of one word; tables are built once from a vocabulary and its merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        def spell(t: str) -> str:
            return t[: -len(suffix)] + _END if suffix and t.endswith(suffix) and t != suffix else t

        self.end = bool(suffix)
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for n, (a, b) in enumerate(merges):
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((left, right), n)
            if both not in self.halves:
                self.halves[both], self.made_at[both] = (left, right), n
        self.words = {i: spell(t) for t, i in vocab.items()}
        base = {t: i for i, t in self.words.items() if i not in self.halves and len(t.rstrip(_END)) == 1}
        usable = base | {self.words[i]: i for i in self.halves}
        self.compatible: dict[tuple[int, int], bool] = {}
        # A token that its own merges don't rebuild never comes out of the merges either.
        usable = {t: i for t, i in usable.items() if i in self.halves and self._joins(*self.halves[i], self.made_at[i]) or i not in self.halves}
        self.search = ahocorasick.Automaton()
        for t, i in usable.items():
            self.search.add_word(t, (len(t), i))
        self.search.make_automaton()
        self.shorter: dict[int, tuple[int, int] | None] = {}
        for t, i in usable.items():
            cut = next((n for n in range(len(t) - 1, 0, -1) if t[:n] in usable), 0)
            self.shorter[i] = (cut, usable[t[:cut]]) if cut else None

    def _joins(self, left: int, right: int, until: int) -> bool:
        """True if no merge before number ``until`` happens across the border of the two tokens.

        Walks down the two facing edges in reverse order of their merges: at each step the token
        that was built last is opened, and the merge of the two edge tokens that then face each
        other must not come before the merge that hides it.
        """
        limit = until
        while True:
            if self.rank.get((left, right), _BIG) < limit:
                return False
            made_l, made_r = self.made_at.get(left, -1), self.made_at.get(right, -1)
            if made_l < 0 and made_r < 0:
                return True
            if made_l >= made_r:
                # before this merge the right half of the left token was at the border; a merge with the
                # same number further left goes first, so across the border it must come strictly before
                left, limit = self.halves[left][1], made_l if made_l < limit else limit
            else:
                right, limit = self.halves[right][0], made_r + 1 if made_r < limit else limit

    def fits(self, left: int, right: int) -> bool:
        """The pair-compatibility table, filled as pairs come up."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            known = self.compatible[left, right] = self._joins(left, right, _BIG)
        return known

    def encode(self, word: str) -> list[int]:
        if not word:
            return []
        text = word + _END if self.end else word
        n = len(text)
        longest: list[tuple[int, int] | None] = [None] * n
        for stop, found in self.search.iter(text):
            longest[stop + 1 - found[0]] = found  # later matches of one start are longer
        failed = bytearray(n + 1)
        out: list[int] = []
        starts: list[int] = []
        at, choice = 0, longest[0]
        while at < n:
            while choice is not None:
                size, token = choice
                if not failed[at + size] and (not out or self.fits(out[-1], token)):
                    break
                choice = self.shorter[token]
            if choice is not None:
                out.append(token)
                starts.append(at)
                at += size
                choice = longest[at] if at < n else None
                continue
            failed[at] = 1
            if not out:
                raise ValueError(f"no tokens for {word!r}")
            choice = self.shorter[out.pop()]
            at = starts.pop()
        return out


class WordBpe:
    """Whole texts with a word-level vocabulary file: normalise, split, encode, decode."""

    def __init__(self, path: str, memory: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.bpe = BacktrackingBpe(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.characters = byte_characters()
        # outside Latin, letters and case are as the library's own Unicode tables have them
        parts = Tokenizer.from_file(path)
        self.normalize, self.split = parts.normalizer.normalize_str, parts.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        table = [tokens.get(i, "").encode() + b" " for i in range(max(tokens) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in table])])
        self.buffer = np.frombuffer(b"".join(table), np.uint8)
        self.memory = memory
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            chars = self.characters
            ids = self.bpe.encode("".join([chars[b] for b in piece.encode()]))
            known = np.array(ids, dtype="<u4").tobytes()
            if len(piece) <= 64:
                self.pieces[piece] = known
        return known

    def _plain(self, text: str) -> bytes:
        if text and max(text) < _LATIN:
            # no character of this range composes with another, and all Unicode versions agree on its classes
            return b"".join(map(self._piece, self.pattern.findall(text.lower())))
        pieces = self.split(self.normalize(text))
        return np.array([i for p, _ in pieces for i in self.bpe.encode(p)], dtype="<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        out = []
        for part in self.cut_special.split(text):
            out.append(np.array([self.special[part]], "<u4").tobytes() if part in self.special else self._plain(part))
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if b"<|" in text or b"\xcc" in text or b"\xcd" in text:
            return self._whole(text.decode())
        if len(self.chunks) > self.memory or len(self.pieces) > self.memory:
            self.chunks.clear()
            self.pieces.clear()
        known = self.chunks
        row = text.lower().split()
        for chunk in set(row).difference(known):
            ids = self._plain(chunk.decode())
            known[chunk] = ids
        out = b"".join(map(known.__getitem__, row))
        if len(text) > 64 and len(row) and max(map(len, row)) > 64:
            for chunk in [c for c in set(row) if len(c) > 64]:
                del known[chunk]
        return out

    def decode(self, ids: bytes) -> bytes:
        """Tokens joined by one space, gathered from the buffer by their offsets."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(tokens):
            return b""
        begin, sizes = self.offsets[tokens], self.offsets[tokens + 1] - self.offsets[tokens]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(begin - (ends - sizes), sizes)
        return self.buffer[places].tobytes()[:-1]


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    return WordBpe(path)


def _digests(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in little_blocks(texts):
                ids = [bpe.encode(t) for t in texts[a:b]]
                back = [bpe.decode(i) for i in ids]
                cols = [
                    pa.array(docs[a:b], pa.int64()),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(t).hexdigest() for t in back]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array([np.frombuffer(i, "<u4").astype(np.int64).tolist() for i in ids], pa.list_(pa.int64())), pa.array([t.decode() for t in back])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def bpe_roundtrip(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again; ``with_ids`` adds both in full.

    Defined cases: a null or empty text has no ids and decodes to the empty text; texts of any length
    are encoded whole, in bounded blocks; repeated rows each get their row; an empty table gives no
    rows; other columns are never read.
    """
    prepare(docs.sparkSession)
    schema = RESULT + (", ids array<bigint>, decoded string" if with_ids else "")
    return documents_view(docs).mapInArrow(_digests(vocabulary or vocabulary_path(), with_ids), schema)
