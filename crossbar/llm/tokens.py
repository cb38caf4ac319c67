"""Encoding whole texts with the tokenizers library, one call per distinct chunk.

The vocabulary drops white space and splits words there, so a text's ids are the ids of its
white-space separated chunks in a row. Each worker process keeps the chunks it has met.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are kept as little-endian unsigned 32-bit integers")

VOCABULARY = "word_bpe_49k.json"

#: Punctuation that ends a word is a piece of its own (no apostrophe: it starts contractions).
_TAIL = b".,;:!?|()\"*%$#&-"
#: Words of lower-case ASCII letters and Latin-1 letters only are one piece, already composed.
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_ENDS_WORD = re.compile(rb"(?:[a-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])\Z")
_LONG = 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


class ChunkEncoder:
    """``encode(texts as UTF-8 bytes) -> ids as little-endian unsigned 32-bit bytes``.

    Equal to ``Tokenizer.encode(text, add_special_tokens=False)`` without truncation and padding.
    Texts that could behave differently when cut or lower-cased first (special-token spellings,
    combining marks that compose with capitals) go to the library whole.
    """

    def __init__(self, path: str, memory: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        letters = {c: chr(c) for c in range(ord("a"), ord("z") + 1)}
        # the byte-level characters of Latin-1 letters, asked from the library once
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        latin = {c: split(chr(c))[0][0] for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)}
        self.spelling = letters | latin
        self.memory = memory
        self.known: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        """Ids of one chunk, by its parts where they are sure to be pieces of their own."""
        ids = self.known.get(chunk)
        if ids is not None:
            return ids
        if _WORD.fullmatch(chunk):
            word = chunk.decode().lower().translate(self.spelling)
            ids = array("I", [t.id for t in self.tokenize(word)]).tobytes()
        else:
            head = chunk.rstrip(_TAIL)
            if head and len(head) < len(chunk) and _ENDS_WORD.search(head):
                ids = self._chunk(head) + self._chunk(chunk[len(head) :])
            else:
                ids = self._whole(chunk.decode())
        if len(chunk) <= _LONG:
            self.known[chunk] = ids
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > self.memory:
            self.known.clear()
        known, out = self.known.get, []
        for text in texts:
            if b"<|" in text or b"\xcc" in text or b"\xcd" in text:
                out.append(self._whole(text.decode()))
                continue
            chunks = text.lower().split()
            found = list(map(known, chunks))
            if None in found:
                found = [self._chunk(c) if f is None else f for c, f in zip(chunks, found)]
            out.append(b"".join(found))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and vocabulary."""
    return ChunkEncoder(path)


def little_blocks(texts: list[bytes], limit: int = 1 << 20):
    """Runs of rows of about ``limit`` bytes, so that split chunks never fill the memory."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def word_ids(raw: bytes) -> array:
    """Ids as a Python array."""
    a = array("I")
    a.frombytes(raw)
    return a
