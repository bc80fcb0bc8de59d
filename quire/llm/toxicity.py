"""5. Toxicity by a weighted lexicon.

Texts are folded first: compatibility forms, look-alike letters of other
scripts, and digits or signs that stand for letters inside a word become the
plain lower-case letter. The lexicon is learned from labelled documents: whole
words and word beginnings whose document frequency among toxic documents is
far above that among the others, weighted by the smoothed log-odds. Phrases
(the entry with the word before or after it) that are about as frequent in
documents that are not toxic become exceptions, which cancel the entry they
contain. One Aho-Corasick automaton matches entries and exceptions; matches
begin at word starts, and of those that begin at the same word the longest
counts. A text's score is a logistic function of its total weight and of its
weight per hundred words.

Learning reads a bounded sample: the ``SAMPLE`` labelled documents of least
hash, whose ids (not texts) go to all tasks. The lexicon is bounded by
``ENTRIES``. Scoring reads every whole text.

Contract: a NULL or empty text scores as a text without matches; scores are in
0..1; without any labelled toxic document nothing is known and every score is
0; repeated rows are kept, a NULL doc_id is held out of learning; of several
labels for a document the highest counts; NULL labels are ignored; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import forget, ship, slices
from quire.session import cut_lineage

ship(__name__)

SAMPLE = 10_000      # labelled documents read to learn from
ENTRIES = 5_000      # lexicon entries, exceptions not counted
LEAST_DF = 4         # toxic documents an entry must be seen in
LEAST_ODDS = 2.5     # log-odds from which on a word or beginning is an entry
PREFIXES = range(4, 10)
THRESHOLD = 0.7

# Look-alikes of Latin letters, by letter.
HOMOGLYPHS = {
    "a": "аαɑ", "b": "ЬƄ", "c": "сϲ", "d": "ԁ", "e": "еεҽ", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ", "k": "кκ",
    "l": "ӏⅼ", "m": "м", "n": "пո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս",
    "v": "νѵ", "w": "ԝш", "x": "хχ", "y": "уγ", "z": "ᴢ",
}
# Digits and signs written for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
_GLYPHS = str.maketrans({g: letter for letter, gs in HOMOGLYPHS.items() for g in gs + gs.upper()})
_LEET_RUN = re.compile(r"(?<![^\W_])[0134578@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578@$!]+(?=[^\W\d_])")
_LEET_MAP = str.maketrans(LEET)
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_APART = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Words of the folded text between single spaces, a space before and after."""
    text = text or ""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).translate(_GLYPHS)
    text = _LEET_RUN.sub(lambda m: m[0].translate(_LEET_MAP), text.lower())
    return f" {_APART.sub(' ', text).strip()} "


class Lexicon:
    """``weights``: folded words (`` idiot ``) and word beginnings (`` achlich``)
    with their log-odds. ``exceptions``: folded phrases. ``fit``: intercept and
    slopes of the logistic function."""

    def __init__(self, weights: dict[str, float], exceptions: dict[str, str], fit: tuple[float, float, float] | None):
        self.weights, self.exceptions, self.fit = weights, exceptions, fit
        self._machine = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.fit

    def __setstate__(self, state):
        self.__init__(*state)

    def machine(self):
        if self._machine is None:
            import ahocorasick

            m = ahocorasick.Automaton()
            for entry in self.weights:
                m.add_word(entry, (len(entry), entry, None))
            for phrase, entry in self.exceptions.items():
                m.add_word(phrase, (len(phrase), entry, phrase.index(entry)))
            m.make_automaton()
            self._machine = m
        return self._machine

    def matches(self, folded: str) -> list[tuple[int, str]]:
        """(start, entry) in order; the longest entry at a word start."""
        if not self.weights:
            return []
        found, excused = {}, set()
        for end, (size, entry, inside) in self.machine().iter(folded):
            start = end - size + 1
            if inside is not None:
                excused.add(start + inside)
            elif start not in found or len(found[start]) < len(entry):
                found[start] = entry
        return sorted((s, e) for s, e in found.items() if s not in excused)

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        total = sum(self.weights[e] for _, e in self.matches(folded))
        return math.log1p(total), math.log1p(100 * total / max(20, folded.count(" ") - 1))

    def score(self, text: str | None) -> float:
        if self.fit is None:
            return 0.0
        a, b = self.features(text)
        z = self.fit[0] + self.fit[1] * a + self.fit[2] * b
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _fitting(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Of entries that extend each other: the longest one that holds nearly all
    toxic documents of a shorter one, and no longer ones that a shorter one
    with nearly their weight covers. ``found``: weight and toxic documents."""
    narrower: dict[str, int] = {}
    for entry, (_, n) in found.items():
        for k in range(2, len(entry)):
            if entry[:k] in found:
                narrower[entry[:k]] = max(n, narrower.get(entry[:k], 0))
    kept: dict[str, float] = {}
    for entry in sorted(found, key=lambda e: (len(e), e)):
        weight, n = found[entry]
        if narrower.get(entry, 0) >= 0.9 * n:
            continue
        covers = [kept[entry[:k]] for k in range(2, len(entry)) if entry[:k] in kept]
        if not covers or weight > max(covers) + 1.0:
            kept[entry] = weight
    return kept


def _prefix_entries(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


def _counted(train: DataFrame, items, least: int) -> DataFrame:
    """item, n0, n1: documents of each label that hold the item. Counted per
    batch first, then per item; the shuffle carries items, not texts."""

    def kernel(batches):
        forget()
        for b in slices(batches):
            counts = (Counter(), Counter())
            for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[label].update(items(t))
            keys = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)],
                names=["item", "n0", "n1"])

    return train.mapInArrow(kernel, "item string, n0 long, n1 long").groupBy("item") \
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n1") >= least)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Ridge-regularised Newton steps on at most ``SAMPLE`` rows."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * len(x) * np.eye(len(w)),
                               x.T @ (p - y) + ridge * len(x) * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's label may not be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Lexicon from the documents whose labels may be learned from."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")) \
        .where(F.col("y").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # at most SAMPLE ids and labels go to the tasks, and one row of each id is learned from, that of the
    # least text hash: a repeated doc_id weighs no more than any other
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id") \
        .withColumn("h", F.xxhash64("text"))
    least = cut_lineage(named.groupBy("doc_id").agg(F.min("h").alias("h")))
    train = cut_lineage(named.join(F.broadcast(least), ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("text", "y"))

    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n1:
        return Lexicon({}, {}, None)
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    best = _counted(train, lambda t: _prefix_entries(fold(t)), LEAST_DF).withColumn("w", odds) \
        .where(F.col("w") >= LEAST_ODDS).orderBy(F.desc("w"), "item").limit(ENTRIES).collect()
    weights = _fitting({r["item"]: (r["w"], r["n1"]) for r in best})
    draft = Lexicon(weights, {}, None)

    def phrases(text):
        folded, out = fold(text), set()
        for start, entry in draft.matches(folded):
            stop = folded.find(" ", start + 1)
            before = folded.rfind(" ", 0, start)
            after = folded.find(" ", stop + 1)
            if before >= 0:
                out.add((folded[before:stop + 1], entry))
            if after >= 0:
                out.add((folded[start:after + 1], entry))
        return {f"{p}\t{e}" for p, e in out}

    excused = _counted(train, phrases, 0).where((F.col("n0") >= LEAST_DF) & (odds <= 0.0)) \
        .orderBy(F.desc("n0"), "item").limit(ENTRIES).collect() if weights else []
    exceptions = dict(r["item"].split("\t") for r in excused)
    lexicon = Lexicon(weights, exceptions, None)

    def measure(batches):
        forget()
        for b in slices(batches):
            got = [lexicon.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got]), pa.array([g[1] for g in got]), b.column(1)],
                                             names=["a", "b", "y"])

    rows = train.mapInArrow(measure, "a double, b double, y int").collect()  # SAMPLE rows at most
    fit = _logistic(np.array([[r["a"], r["b"]] for r in rows]), np.array([r["y"] for r in rows], float))
    return Lexicon(weights, exceptions, tuple(map(float, fit)))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def kernel(batches):
        lex = shared.value
        forget()
        for b in slices(batches):
            got = [lex.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, "doc_id long, score double")


def reject(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns as they are, whose score is under ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    column = docs.schema.fieldNames().index("text")

    def kernel(batches):
        lex = shared.value
        forget()
        for b in slices(batches):
            clean = [lex.score(t) < threshold for t in b.column(column).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(kernel, docs.schema)
