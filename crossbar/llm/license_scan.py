"""Operator 4: licence scan with a positional rare-token index, in DataFrame operations only.

The index holds templates under words of theirs, rarest first by document frequency over all documents, with the
words' places. A document's words that are in it are looked up with their positions, and each posting says where
its template would start (position less place). A start counts if it comes from the rarest word of the template's
mandatory key phrase and from another rare word of the notice; then the phrase must stand there word for word, and
a share of the notice's words at their places.

So many rare words are entered that no start is lost: a notice with the share SHARE of its words in place lacks
at most ``d`` of them, so of d + 1 entered words at least one stands at its place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: The phrases of the contract and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, notice, mandatory key phrase (part of the notice).
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    (
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "except in compliance with the license",
    ),
    ("mit", "released under the mit license", "mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "retain the above copyright notice",
    ),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "gnu general public license",
    ),
    ("lgpl", "licensed under the gnu lesser general public license version 3", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0", "dedicated to the public domain under cc0 1 0", "public domain under cc0"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify",
    ),
)
#: Of a notice's words, the share that must stand at their places.
SHARE = 0.6
#: A start is one number, so that sets of them are hashed: template * 2^32 + start + NEGATIVE.
NEGATIVE = 1 << 20
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z. Only the Kelvin sign would become an ASCII letter in ``lower``."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(lowered, _NOT_WORD), "")


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each word of the vocabulary, counted over all documents."""
    seen = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), _literal(vocabulary))).alias("word"))
    counts = dict.fromkeys(vocabulary, 0)
    counts.update({r["word"]: r["count"] for r in seen.groupBy("word").count().collect()})  # one row a word
    return counts


def needed(words: list[str], share: float) -> int:
    """Words of a notice that must stand at their places."""
    return math.ceil(share * len(words) - 1e-9)


def anchors(words: list[str], at: int, length: int, share: float, frequency: dict[str, int]) -> tuple[int, list[int]]:
    """Place of the rarest word of the phrase, and of so many other rarest words of the notice that one of them
    stands at its place in every notice with the share."""
    rarest = sorted(range(len(words)), key=lambda i: (frequency[words[i]], -len(words[i]), i))
    key = next(i for i in rarest if at <= i < at + length)
    others = [i for i in rarest if i != key]
    return key, others[: len(words) - needed(words, share) + 1]


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    ``places`` lists (label, start, length) of every phrase found. ``score`` is the greatest share of a
    template's words that stand at their places, 1 for a base phrase, 0 for none.

    Defined cases: null text is empty and has no words; overlapping and repeated places all count; documents
    without a label have empty strings and null first and last words; repeated rows each get their row; an
    empty table gives no rows; other columns are never read.
    """
    prepare(docs.sparkSession)
    entries = [(label, phrase.split(), phrase.split(), 0, True) for phrase, label in base]
    for label, notice, key in templates:
        words, phrase = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        entries.append((label, words, phrase, at, False))
    frequency = document_frequencies(docs, sorted({w for _, words, *_ in entries for w in words}))
    # postings of the two kinds: word -> (template, place)
    sure: dict[str, list[tuple[int, int]]] = {}
    other: dict[str, list[tuple[int, int]]] = {}
    for t, (_, words, phrase, at, is_base) in enumerate(entries):
        key, rest = anchors(words, at, len(phrase), share, frequency)
        sure.setdefault(words[key], []).append((t, key))
        for i in [] if is_base else rest:
            other.setdefault(words[i], []).append((t, i))
    known = F.array(
        *[
            F.struct(F.lit(label).alias("label"), _literal(words).alias("words"), _literal(phrase).alias("phrase"), F.lit(at).alias("at"), F.lit(is_base).alias("base"), F.lit(needed(words, share)).alias("needed"))
            for label, words, phrase, at, is_base in entries
        ]
    )
    split = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    # a document without the rarest word of any phrase has no place
    split = split.withColumns({"n_words": F.size("words").cast("bigint"), "maybe": F.arrays_overlap("words", _literal(sorted(sure)))})
    spots = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    hits = F.filter(spots, lambda x: x["word"].isin(sorted({*sure, *other})))

    def starts(postings: dict[str, list[tuple[int, int]]]) -> Column:
        """Template and start, as one number, of every posting of every hit."""
        shifts = [F.array(*[F.lit((t << 32) + NEGATIVE - i) for t, i in p]) for p in postings.values()]
        index = F.map_from_arrays(_literal(list(postings)), F.array(*shifts))
        here = F.filter("hits", lambda h: h["word"].isin(list(postings)))
        move = lambda h: F.transform(F.element_at(index, h["word"]), lambda p: p + h["at"])
        return F.array_distinct(F.flatten(F.transform(here, move)))

    def judged(c: Column) -> Column:
        """A start with its template, whether the key phrase stands there, and how many words are in place."""
        template = F.element_at(known, F.shiftright(c, 32).cast("int") + 1)
        start = (c.bitwiseAND(F.lit((1 << 32) - 1)) - NEGATIVE).cast("int")
        first = start + template["at"]
        phrase = (first >= 0) & (F.slice("words", F.greatest(first, F.lit(0)) + 1, F.size(template["phrase"])) == template["phrase"])
        same = F.filter(template["words"], lambda w, j: (start + j >= 0) & (F.get("words", start + j) == w))
        return F.struct(
            template["label"].alias("label"),
            first.cast("bigint").alias("start"),
            F.size(template["phrase"]).cast("bigint").alias("length"),
            template["base"].alias("base"),
            (F.size(same).cast("double") / F.size(template["words"])).alias("share"),
            (phrase & (F.size(same) >= template["needed"])).alias("fits"),
        )

    none = "array<struct<label:string,start:bigint,length:bigint,base:boolean,share:double,fits:boolean>>"
    found = split.withColumn("hits", F.when(F.col("maybe"), hits))
    found = found.withColumns({"sure": starts(sure), "other": starts(other) if other else F.array().cast("array<bigint>")})
    # base phrases have one posting list, notices two to intersect
    both = F.concat(F.filter("sure", lambda c: c < F.lit(len(base) << 32)), F.array_intersect("sure", "other"))
    every = F.filter(F.transform(both, judged), lambda p: p["fits"])
    found = found.select("doc_id", "n_words", F.when(F.col("maybe"), every).otherwise(F.array().cast(none)).alias("places"))
    found = found.withColumn("base", F.filter("places", lambda p: p["base"]))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    begin = F.transform("base", lambda p: p["start"])
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(begin).alias("first_word"),
        F.array_max(begin).alias("last_word"),
        join("base").alias("base_labels"),
        join("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
        F.transform("places", lambda p: F.struct(p["label"].alias("label"), p["start"].alias("start"), p["length"].alias("length"))).alias("places"),
    )
