"""Operator 5: toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reported speech, other) by a lexicon; five small
transducers read a clause's symbols side by side and are composed into one machine, whose transitions carry
the weight of what they match. A clause counts as a whole: an insult weighs more near a target, less after
a negation and in reported speech; a threat needs a target after it. A document's features are taken from
its matched clauses and a logistic model maps them to a score.

Insults beyond the built-in words are learned from labelled documents: whole words, and word beginnings that
many different words share. Learning reads at most ``fit_rows`` labelled documents (a documented bound, those
with the smallest hash) and counts every word of theirs; scoring reads every whole text and every clause whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

#: Words of the closed classes, four languages.
INSULT = ("idiot", "idiots", "moron", "morons", "stupid", "scum", "loser", "losers", "worthless", "pathetic", "disgusting", "trash", "clown", "imbecile", "vermin", "trottel", "abschaum", "dummkopf", "crétin", "imbécile", "connard", "estúpido", "idiota", "imbécil", "escoria")
THREAT = ("kill", "hurt", "destroy", "murder", "burn", "hang", "shoot", "töten", "umbringen", "tuer", "frapper", "matar", "golpear")
TARGET = ("you", "your", "you're", "he", "she", "they", "them", "him", "her", "these", "those", "people", "du", "dich", "ihr", "euch", "sie", "tu", "toi", "vous", "ils", "elles", "usted", "tú", "ellos", "ellas")
NEGATION = ("not", "no", "never", "isn't", "aren't", "wasn't", "don't", "nobody", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun", "nunca", "jamás", "ningún")
REPORT = ("said", "says", "called", "wrote", "quoted", "quote", "claimed", "alleged", "sagte", "schrieb", "nannte", "zitat", "dit", "écrit", "citation", "dijo", "escribió", "cita")
O, I, P, T, N, R = range(6)  # other, insult, threat, target, negation, report
NEAR = 3

FEATURES = ("hits", "weight", "strongest", "density", "negated", "reported", "threats")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_ENDS = ".!?;:\n|"
_CLAUSE = re.compile(f"[{_ENDS}]")


# --- transducers --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """``step[state, symbol] -> (next state, what it says about the symbol)``; starts in state 0."""

    states: int
    step: dict[tuple[int, int], tuple[int, float]] = field(hash=False)


def _machine(states: int, rule) -> Transducer:
    return Transducer(states, {(s, x): rule(s, x) for s in range(states) for x in range(6)})


def negation() -> Transducer:
    """Says 1 for a symbol within NEAR words after a negation."""
    return _machine(NEAR + 1, lambda s, x: (NEAR if x == N else max(0, s - 1), float(s > 0)))


def reported() -> Transducer:
    """Says 1 for symbols after a word of speech, to the end of the clause."""
    return _machine(2, lambda s, x: (int(s == 1 or x == R), float(s == 1)))


def target() -> Transducer:
    """Says 1 for symbols within NEAR words after a target."""
    return _machine(NEAR + 1, lambda s, x: (NEAR if x == T else max(0, s - 1), float(s > 0)))


def threat() -> Transducer:
    """Says 1 for a target within NEAR words after a threat."""
    return _machine(NEAR + 1, lambda s, x: (NEAR if x == P else max(0, s - 1), float(s > 0 and x == T)))


def insult() -> Transducer:
    """Says 1 for an insult."""
    return _machine(1, lambda s, x: (0, float(x == I)))


#: Shares of an insult's weight that stay after a negation and in reported speech; what a target adds.
NEGATED, REPORTED, AIMED, THREATENED = 0.6, 0.7, 0.25, 2.0


@lru_cache(maxsize=1)
def grammar() -> list[list[tuple[int, float, int]]]:
    """The composed machine: ``grammar()[state][symbol] -> (next, factor, marks)``.

    ``factor`` multiplies the weight of an insult; marks are bits: 1 insult, 2 negated, 4 reported, 8 threat.
    Only states that can be reached are kept.
    """
    parts = (insult(), negation(), reported(), target(), threat())
    number = {(0,) * len(parts): 0}
    table: list[list[tuple[int, float, int]]] = []
    todo = list(number)
    while todo:
        state = todo.pop(0)
        row = []
        for symbol in range(6):
            moves = [p.step[s, symbol] for p, s in zip(parts, state)]
            follow = tuple(m[0] for m in moves)
            hit, neg, rep, aim, thr = (m[1] for m in moves)
            factor = hit * (NEGATED if neg else 1) * (REPORTED if rep else 1) * (1 + AIMED * aim)
            marks = int(hit) | (2 if hit and neg else 0) | (4 if hit and rep else 0) | (8 if thr else 0)
            if follow not in number:
                number[follow] = len(number)
                todo.append(follow)
            row.append((number[follow], factor, marks))
        table.append(row)
    return table


# --- lexicon and features -----------------------------------------------------------------------------


class Lexicon:
    """Whole words and word beginnings with weights; finds the clauses that hold any of them."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        closed = {w: (P, 0.0) for w in THREAT} | {w: (T, 0.0) for w in TARGET} | {w: (N, 0.0) for w in NEGATION} | {w: (R, 0.0) for w in REPORT}
        self.words = closed | {w: (I, x) for w, x in words.items()}
        self.stems = stems
        self.sizes = sorted({len(s) for s in stems}, reverse=True)
        self.search = ahocorasick.Automaton()
        for w in {*words, *stems, *THREAT}:
            self.search.add_word(w, len(w))
        if len(self.search):
            self.search.make_automaton()

    def symbol(self, word: str) -> tuple[int, float]:
        found = self.words.get(word)
        if found is None:
            for n in self.sizes:
                if (weight := self.stems.get(word[:n])) is not None:
                    return I, weight
            return O, 0.0
        return found

    def features(self, text: str) -> list[float]:
        """One value for each of FEATURES over the clauses of a whole text.

        A clause that holds a word of the lexicon is read whole and once, whatever its length.
        """
        low = text.lower()
        out = dict.fromkeys(FEATURES, 0.0)
        done = 0  # everything before is read or holds no word of the lexicon
        table = grammar()
        for end, size in self.search.iter(low) if len(self.search) else ():
            start = end + 1 - size
            if start < done or (start and low[start - 1].isalnum()):
                continue
            begin = max(done, *(low.rfind(sign, done, start) + 1 for sign in _ENDS))
            stop = _CLAUSE.search(low, end)
            done = stop.start() if stop else len(low)
            state = weight = 0
            for m in _WORD.finditer(low, begin, done):
                symbol, strength = self.symbol(m[0])
                state, factor, marks = table[state][symbol]
                if marks:
                    weight += strength * factor + (THREATENED if marks & 8 else 0.0)
                    out["hits"] += marks & 1
                    out["negated"] += bool(marks & 2)
                    out["reported"] += bool(marks & 4)
                    out["threats"] += bool(marks & 8)
            out["weight"] += weight
            out["strongest"] = max(out["strongest"], weight)
        out["density"] = out["weight"] / (1 + len(low) / 200)
        return [math.log1p(out[f]) for f in FEATURES]


# --- learning -----------------------------------------------------------------------------------------

#: Least counts and log-odds of a learned form; the shortest word beginning that is counted.
LEAST_DOCS, LEAST_ODDS, LEAST_STEM = 5, 0.5, 4


def stem_sizes(length: int) -> Iterator[int]:
    """Lengths of the beginnings that are counted of a word: each up to 12, then in growing steps, so that a
    word of any length has few of them and words with a common beginning always share one."""
    n = LEAST_STEM
    while n < length:
        yield n
        n += max(1, n // 12)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold a word ("=word") or a word beginning ("word~"), by blocks of a few rows."""
    for batch in (whole.slice(a, 128) for whole in batches for a in range(0, len(whole), 128)):
        texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        pos: Counter = Counter()
        neg: Counter = Counter()
        for text, label in zip(texts, toxic):
            words = set(_WORD.findall(text.lower()))
            forms = {"=" + w for w in words}
            forms.update(w[:n] + "~" for w in words for n in stem_sizes(len(w)))
            (pos if label else neg).update(forms)
        forms = [*pos.keys() | neg.keys()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(forms, pa.string()), pa.array([pos[f] for f in forms], pa.int64()), pa.array([neg[f] for f in forms], pa.int64())],
            names=["form", "pos", "neg"],
        )


def speaking(counts: DataFrame, pos: int, neg: int) -> DataFrame:
    """form, pos, odds of the forms that speak for label 1: at least as many documents labelled 1 as 0, and
    surely more than by chance. Odds are smoothed log-odds, lowered for small counts."""
    p, n = F.col("pos") + F.lit(0.5), F.col("neg") + F.lit(0.5)
    odds = F.log(p / n) - F.lit(math.log((pos + 1) / (neg + 1))) - F.lit(3.0) * F.sqrt(1 / p + 1 / n)
    return counts.where((F.col("pos") >= LEAST_DOCS) & (F.col("pos") >= F.col("neg"))).select("form", "pos", odds.alias("odds")).where(F.col("odds") > LEAST_ODDS)


def choose_terms(forms: list[tuple[str, int, float]]) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their weights out of forms (form, documents labelled 1, odds).

    A stem stands for its words if no single word makes up most of it; of nested stems with the same
    documents the longest is enough.
    """
    words = {f[1:]: (p, odds) for f, p, odds in forms if f[0] == "="}
    stems = {f[:-1]: (p, odds) for f, p, odds in forms if f[0] != "="}
    most: dict[str, int] = {}  # of the words that begin so, the greatest count
    for w, (p, _) in words.items():
        for n in {*stem_sizes(len(w)), len(w)}:
            most[w[:n]] = max(p, most.get(w[:n], 0))
    kept: dict[str, float] = {}
    below: dict[str, int] = {}  # of the stems kept so far that begin so, the greatest count
    for stem in sorted(stems, key=lambda s: (-stems[s][0], -len(s), s)):
        p, odds = stems[stem]
        if most.get(stem, 0) > 0.6 * p or below.get(stem, 0) >= 0.95 * p:
            continue
        if any(stem[:n] in kept for n in stem_sizes(len(stem))):
            continue
        kept[stem] = odds
        for n in stem_sizes(len(stem)):
            below[stem[:n]] = max(p, below.get(stem[:n], 0))
    single = {w: odds for w, (_, odds) in words.items() if not any(w[:n] in kept for n in {*stem_sizes(len(w)), len(w)})}
    return dict(sorted(single.items())), kept


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and bias (last) by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicityModel:
    words: dict[str, float]
    stems: dict[str, float]
    weights: list[float]

    def lexicon(self) -> Lexicon:
        return Lexicon(self.words, self.stems)


def remainder(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> ToxicityModel:
    """Learn from labelled documents whose crc32(doc_id) mod 4 is not 2; at most ``fit_rows`` of them.

    This bound is on labelled rows only: of a chosen document the whole text and every form of it are counted.
    Of several labels of one doc_id the greater counts, of several texts the least. Without labels of both
    kinds the score is that of built-in weights.
    """
    prepare(docs.sparkSession)
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 2))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = materialize(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "labelled")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(sample), "doc_id")  # at most fit_rows small rows
    train = materialize(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).drop("doc_id"), "training")
    totals = train.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    pos, n = int(totals[0] or 0), int(totals[1])
    counts = train.mapInArrow(_count, "form string, pos bigint, neg bigint").groupBy("form").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # what bounds this table is fit_rows: a form stands in LEAST_DOCS of so many texts
    words, stems = choose_terms([tuple(r) for r in speaking(counts, pos, n - pos).collect()])
    mean = sum(words.values()) / len(words) if words else 1.0
    words = {w: mean for w in INSULT if not any(w.startswith(s) for s in stems)} | words
    lexicon = Lexicon(words, stems)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [lexicon.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    got = train.mapInArrow(features, "x array<double>, toxic int").collect()  # at most fit_rows short rows
    if not got or not 0 < pos < n:
        return ToxicityModel(words, stems, [0.5] * len(FEATURES) + [-4.0])
    order = sorted((r.x, r.toxic) for r in got)
    weights = fit_logistic(np.array([x for x, _ in order]), np.array([float(t) for _, t in order]))
    return ToxicityModel(words, stems, weights.tolist())


def _scorer(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = model.lexicon(), np.array(model.weights)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = np.array([lexicon.features(t) for t in texts]).reshape(-1, len(FEATURES))
            score = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Defined cases: null and empty texts have no clauses and get the score of the bias; texts of any length are
    read whole; repeated rows each get their row; a null doc_id hashes as the empty text; an empty table gives
    no rows; other columns are never read.
    """
    prepare(docs.sparkSession)
    view = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scored = view.mapInArrow(_scorer(model), "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id")) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text scores below ``threshold``."""
    prepare(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = model.lexicon(), np.array(model.weights)
        for batch in batches:
            x = np.array([lexicon.features(t or "") for t in batch.column(place).to_pylist()]).reshape(-1, len(FEATURES))
            score = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
