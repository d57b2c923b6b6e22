"""Toxicity by multiple-instance learning: sentences score, documents have the labels.

A document is a bag of sentences.  A sentence's evidence z is a bias plus the weights of
the features it has; its probability is p = 1 - exp(softplus(bias) - softplus(z)),
which is zero without evidence.  The document's is the noisy-or of its sentences,
1 - (1 - leak) * product of (1 - p).  Weights are fitted to document labels alone by
gradient steps on the noisy-or likelihood, after which the sentences with a high
probability are the offending ones (``offending``).

Features are the lower-cased words and their first four, five and six characters.
Fitting reads a bounded sample of labelled rows (``max_docs`` by a hash of ``doc_id``,
texts whole) and keeps the features that carry weight, whose occurrences an
Aho-Corasick automaton then finds in one pass over every whole text.

Defined results: a null or empty text has no sentence and gets the leak, the
score of an empty bag; repeated rows score alike; a null ``doc_id`` is never learned from; labels
that are null or have no document are ignored; without both labels to learn from
there are no weights and every score is the leak; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents that fitting reads at most.
MAX_DOCS = 4_000
#: A document's score with no evidence, and a sentence's log odds with none.
LEAK, BIAS = 0.02, -5.0
#: Probability from which on a sentence is an offending one.
OFFENDS = 0.5

_END = re.compile(r"[.!?\n]")
_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> set[str]:
    """A lower-cased word, closed by a mark, and its beginnings."""
    return {word + "$", *(word[:k] for k in (4, 5, 6) if len(word) >= k)}


class Model:
    """Weights of features; a name that ends in ``$`` is a whole word, any other a beginning."""

    def __init__(self, weights: dict[str, float]):
        self.weights = dict(weights)
        self.finder = None
        if self.weights:
            ends: dict[str, list[tuple[str, bool]]] = {}
            for f in self.weights:
                ends.setdefault(f.rstrip("$"), []).append((f, f.endswith("$")))
            self.finder = ahocorasick.Automaton()
            for text, kinds in ends.items():
                self.finder.add_word(text, (len(text), kinds))
            self.finder.make_automaton()

    def bags(self, text: str) -> list[set[str]]:
        """Features of each sentence that has any, in text order."""
        if self.finder is None:
            return []
        text = text.lower()
        found: list[set[str]] = []
        last = -1
        for end, (size, kinds) in self.finder.iter(text):
            start = end - size + 1
            if start and text[start - 1].isalpha():
                continue
            whole = end + 1 == len(text) or not text[end + 1].isalpha()
            own = [f for f, closed in kinds if whole or not closed]
            if own:
                if last < 0 or _END.search(text, last, end):
                    found.append(set())
                found[-1].update(own)
                last = end
        return found

    def evidence(self, bags: list[set[str]]) -> np.ndarray:
        """-log(1 - p) of each bag."""
        z = np.array([BIAS + sum(self.weights[f] for f in sorted(b)) for b in bags])
        return np.logaddexp(0, z) - np.logaddexp(0, BIAS)

    def document(self, text: str) -> float:
        """Noisy-or over the text's sentences."""
        bags = self.bags(text)
        return float(1 - (1 - LEAK) * np.exp(-self.evidence(bags).sum())) if bags else LEAK

    def located(self, text: str, threshold: float) -> list[tuple[int, int, int, float]]:
        """Sentences whose probability reaches the threshold: number in the text, start and end (code points), probability."""
        bags = self.bags(text)
        if not bags or -np.expm1(-self.evidence(bags).max()) < threshold:
            return []
        out, start = [], 0
        for k, m in enumerate([*_SENTENCE.finditer(text), None]):
            end = m.start() if m else len(text)
            p = float(-np.expm1(-self.evidence(self.bags(text[start:end])).sum()))
            if p >= threshold:
                out.append((k, start, end, p))
            start = m.end() if m else end
        return out


def fit(texts: list[str], labels: np.ndarray, rounds: int = 80, l1: float = 5e-4) -> Model:
    """Weights that make the noisy-or likelihood of the labels large.

    Only features of several documents that come with label 1 clearly more often than
    the average are taken up.  Steps are Adam's; after each, weights shrink by ``l1`` and
    those below zero are set to zero: a word can offend, not excuse.
    """
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model({})
    has: Counter[str] = Counter()
    hits: Counter[str] = Counter()
    for t, label in zip(texts, y, strict=True):
        own = set().union(*map(features, set(_WORD.findall(t.lower()))))
        has.update(own)
        if label:
            hits.update(own)
    rate = y.mean()
    least = min(0.9, 3 * rate)
    lift = {f: (n + 0.5 * rate) / (has[f] + 0.5) for f, n in hits.items() if has[f] >= 2}
    names = sorted(f for f, x in lift.items() if x > least)
    if not names:
        return Model({})
    number = {f: k for k, f in enumerate(names)}
    scan = Model(dict.fromkeys(names, 1.0))
    col: list[int] = []
    sent: list[int] = []
    doc: list[int] = []
    for d, t in enumerate(texts):
        for bag in scan.bags(t):
            col += [number[f] for f in bag]
            sent += [len(doc)] * len(bag)
            doc.append(d)
    col, sent, doc = np.array(col, np.int64), np.array(sent, np.int64), np.array(doc, np.int64)
    n = len(names)
    w = np.array([np.log(lift[f] / rate) * min(1.0, hits[f] / 5) for f in names])
    m = v = np.zeros(n)
    for k in range(1, rounds + 1):
        z = np.clip(BIAS + np.bincount(sent, w[col], minlength=len(doc)), -50, 50)
        soft = np.logaddexp(0, z) - np.logaddexp(0, BIAS)
        stay = np.bincount(doc, soft, minlength=len(y)) - np.log(1 - LEAK)  # -log(1 - score)
        # d loss / d stay: 1 for label 0, -(1 - score) / score for label 1
        g_doc = np.where(y == 1, -1 / np.expm1(np.clip(stay, 1e-9, 50)), 1.0) / len(y)
        g = np.bincount(col, (g_doc[doc] / (1 + np.exp(-z)))[sent], minlength=n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        w = np.clip(w - l1, 0, 12)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if x > 0.05})


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Fit to at most ``max_docs`` labelled documents, those of the smallest hash of ``doc_id``.

    Rows whose crc32 of ``doc_id`` as text leaves 2 modulo 4 are held out and never read.
    """
    y = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("y is not null and doc_id is not null")
    y = y.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # rows that share an id count each; the bound holds for rows
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_docs).collect()
    return fit([r.text for r in rows], np.array([r.y for r in rows]))


def scored(docs: DataFrame, model: Model, locate: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``score`` (which replaces one of that name), the noisy-or over the whole ``text``.

    With ``locate`` also ``offending``: ``start:end`` of each offending sentence (code points, end exclusive), comma-joined.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    docs = docs.drop("score", "offending") if locate else docs.drop("score")
    fields = [*docs.schema.fields, T.StructField("score", T.DoubleType()), *[T.StructField("offending", T.StringType())] * locate]
    at = docs.columns.index("text")

    def run(batches):
        own = Model(weights.value)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            made = [pa.array([own.document(t) for t in texts], pa.float64())]
            if locate:
                made.append(pa.array([",".join(f"{x}:{y}" for _, x, y, _ in own.located(t, OFFENDS)) for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def offending(docs: DataFrame, model: Model, threshold: float = OFFENDS) -> DataFrame:
    """Offending sentences: ``doc_id``, ``sentence`` (number in the text, from 0), ``words`` and ``p``."""
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches):
        own = Model(weights.value)
        for b in batches:
            rows = []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [{"doc_id": key, "sentence": k, "words": t[x:y].strip(), "p": p} for k, x, y, p in own.located(t or "", threshold)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("sentence", pa.int64()), ("words", pa.string()), ("p", pa.float64())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sentence long, words string, p double")
