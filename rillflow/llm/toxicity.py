"""Toxicity by multiple-instance learning.

Labels belong to documents, toxicity to sentences. A sentence's probability is logistic in the words and word
beginnings it holds; a document's is the noisy-or of its sentences and a leak (toxic without a known word):
1 - (1 - leak) * prod(1 - p). The parameters maximise the likelihood of the document labels; afterwards the
sentence probabilities locate what is offending.

The vocabulary comes from document counts of every feature in the labelled sample, counted by Spark. A feature is in it if
it stands in the larger share of the toxic documents: `ratio` times that of the others at least, and the logarithm of that
is at least `sure` times its standard error. No number of features is set, and none of documents that must hold one.

Defined results: a null text counts as empty; an empty text, or one without known features, scores the leak;
documents without a label do not train; without any labelled toxic document every score is the leak. Repeated rows are scored
each and alike. Texts of any length are scored whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, labelled_sample, map_rows

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: Word beginnings of these lengths are features beside the whole word.
STEMS = (3, 4, 5, 6)


def keys(word: str) -> list[str]:
    return [f"={word}", *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]


class Vocabulary(dict):
    """Lower-case word -> its features' positions, filled as words are met; forgotten when it grows large."""

    def __init__(self, names: list[str], most: int = 300_000):
        super().__init__()
        self.at, self.most = {k: i for i, k in enumerate(names)}, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = tuple(self.at[k] for k in keys(word) if k in self.at)
        return found


def instances(text: str | None, known: Vocabulary) -> list[tuple[int, int, list[int]]]:
    """Sentences with known features: start, end, positions of the features."""
    text = text or ""
    if not any(map(known.__getitem__, WORD.findall(text.lower()))):
        return []
    out = []
    for m in SENTENCE.finditer(text):
        found = {i for w in WORD.findall(m[0].lower()) for i in known[w]}
        if found:
            out.append((m.start(), m.end(), sorted(found)))
    return out


@dataclass(frozen=True)
class NoisyOr:
    names: list[str]
    weights: np.ndarray
    bias: float
    leak: float

    def sentence(self, found: list[int]) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.bias + float(self.weights[found].sum())))))

    def score(self, text: str | None, known: Vocabulary) -> float:
        none = 1 - self.leak
        for *_, found in instances(text, known):
            none *= 1 - self.sentence(found)
        return 1 - none


def maximise(bags: list[list[list[int]]], label: np.ndarray, names: list[str], start: np.ndarray, steps: int = 300, ridge: float = 1e-3) -> NoisyOr:
    """Adam on the noisy-or likelihood; bags hold each document's sentences as lists of features."""
    n, k = len(bags), len(names)
    flat = [(d, f) for d, bag in enumerate(bags) for f in bag]
    doc = np.array([d for d, _ in flat], int)
    row = np.repeat(np.arange(len(flat)), [len(f) for _, f in flat]) if flat else np.zeros(0, int)
    col = np.concatenate([f for _, f in flat]).astype(int) if flat else np.zeros(0, int)
    base = float(np.clip(label.mean() if n else 0.0, 1e-4, 0.5))
    x = np.concatenate([start, [-2.0, math.log(base / 10)]])  # weights, bias, log-odds of the leak
    m, v = np.zeros(k + 2), np.zeros(k + 2)
    for t in range(1, steps + 1 if n else 1):
        z = np.clip(x[k] + np.bincount(row, x[col], len(flat)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        leak = 1 / (1 + math.exp(-x[k + 1]))
        log_none = math.log1p(-leak) - np.bincount(doc, np.logaddexp(0, z), n)
        none = np.exp(log_none)
        pull = np.where(label == 1, none / np.maximum(1 - none, 1e-9), -1.0)  # d log-likelihood / d(-log none)
        by_sentence = pull[doc] * p
        g = np.concatenate([np.bincount(col, by_sentence[row], k), [by_sentence.sum(), pull.sum() * leak]]) / n
        g[:k] -= ridge * x[:k] / math.sqrt(n)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        x[k + 1] = min(x[k + 1], -0.5)
    return NoisyOr(names, x[:k], float(x[k]), float(1 / (1 + math.exp(-x[k + 1]))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 20_000, ratio: float = math.e, sure: float = 2.0) -> NoisyOr:
    """Train on at most `rows` labelled documents (the only bound)."""
    sample = cut(labelled_sample(docs, labels, label, rows))

    def counted():
        def f(ids: list, texts: list, marks: list) -> Iterable[tuple]:
            for t, m in zip(texts, marks, strict=True):
                for k in {k for w in set(WORD.findall((t or "").lower())) for k in keys(w)}:
                    yield k, m

        return f

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    weight = F.log((F.col("a") + 0.5) / (pos + 1)) - F.log((F.col("b") + 0.5) / (neg + 1))
    counts = map_rows(sample.repartition(12, "doc_id"), counted, "feature string, label int").groupBy("feature")
    counts = counts.agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).withColumn("w", weight)
    best = counts.where(F.col("w") >= F.greatest(F.lit(math.log(ratio)), sure * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5)))).orderBy("feature").collect()
    names = [r["feature"] for r in best]

    def bagged():
        known = Vocabulary(names)
        return lambda ids, texts, marks: ((m, [f for *_, f in instances(t, known)]) for t, m in zip(texts, marks, strict=True))

    rows_ = map_rows(sample, bagged, "label int, bags array<array<int>>").toPandas()
    bags = [[list(f) for f in bag] for bag in rows_["bags"]]
    start = np.array([min(3.0, r["w"]) / 2 for r in best], float)
    return maximise(bags, rows_["label"].to_numpy(), names, start)


def score_toxicity(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of every row, and the worst sentence's place: worst_start, worst_end."""

    def make():
        known = Vocabulary(model.names)

        def f(ids: list, texts: list) -> Iterable[tuple]:
            for i, t in zip(ids, texts, strict=True):
                none, worst = 1 - model.leak, (0.0, None, None)
                for start, end, found in instances(t, known):
                    p = model.sentence(found)
                    none *= 1 - p
                    if p > worst[0]:
                        worst = p, start, end
                yield i, 1 - none, int(1 - none >= 0.5), worst[1], worst[2]

        return f

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, score double, predicted int, worst_start long, worst_end long")


def offending_sentences(docs: DataFrame, model: NoisyOr, least: float = 0.5) -> DataFrame:
    """doc_id, start, end, sentence and probability of every sentence from `least` on."""

    def make():
        known = Vocabulary(model.names)

        def f(ids: list, texts: list) -> Iterable[tuple]:
            for i, t in zip(ids, texts, strict=True):
                for start, end, found in instances(t, known):
                    if (p := model.sentence(found)) >= least:
                        yield i, start, end, t[start:end], p

        return f

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, start long, end long, sentence string, probability double")
