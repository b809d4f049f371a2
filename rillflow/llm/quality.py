"""Quality classifier: Bradley-Terry ranking of documents.

A document's score is linear in features of its whole text. Preference pairs (a good and a bad labelled
document) give the likelihood sigmoid(score(good) - score(bad)); its logistic loss on feature differences is
minimised. Every labelled document trains: Spark pairs them by their rank in the order of a hash, each in one pair at least (all pairs
where they are few), and sums gradients over the stored pairs. The threshold is the quantile of all training scores below which the labels put the bad share, and
the returned score is sigmoid(score - threshold), so 0.5 stands for the threshold.

Defined results: a null text counts as empty; documents whose label is null or missing do not train; if only
one class (or none) is labelled, every document gets that class's share as its score (0.5 without labels). Repeated rows are
scored each and alike, and keep_good keeps all or none of them. Texts of any length are scored whole.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.planning import numbered
from .common import Stored, cut, forget, map_rows

#: Kinds of bytes: 0 lower-case letter or part of a non-ASCII character, 1 upper case, 2 digit, 3 white space, 4 sentence mark, 5 other.
_KIND = bytes(
    0 if 97 <= b <= 122 or b >= 128 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in b" \t\r\n\f\v" else 4 if b in b".,;:!?'\"-()" else 5 for b in range(256)
)


def features(text: str | None) -> list[float]:
    """Shape, repetition and variety of a text; none depends on its language."""
    data = (text or "").encode()
    n = len(data)
    if not n:
        return [0.0] * N_FEATURES
    kinds = data.translate(_KIND)
    share = [kinds.count(k) / n for k in range(6)]
    words = data.lower().split()
    count = Counter(words)
    n_words = max(1, len(words))
    top = count.most_common(2)
    most = [c / n_words for _, c in top] + [0.0] * (2 - len(top))
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n_words
    short = sum(c for w, c in count.items() if len(w) <= 3) / n_words
    marks = sum(c for w, c in count.items() if not w.isalnum() and not any(48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in w)) / n_words
    odd = sum(c for w, c in count.items() if len(w) > 2 and w[-1] < 128 and w[-2] < 128 and not w[-2:].isalnum() and not (97 <= w[-2] <= 122)) / n_words
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = 1 - len(set(lines)) / max(1, len(lines))
    ended = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines))
    packed = len(zlib.compress(data, 1)) / n
    size = sum(len(w) * c for w, c in count.items()) / n_words
    return [
        *share, math.log1p(n_words), len(count) / n_words, len(count) / math.sqrt(n_words), *most, doubled, short, marks, odd, same, ended, packed,
        size, max(map(len, count), default=0) ** 0.5, math.log1p(len(data) / max(1, len(lines))), most[0] ** 2, min(1.0, size / 20) ** 2,
    ]


N_FEATURES = 23


@dataclass(frozen=True)
class Ranker:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        s = np.clip((rows - self.centre) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(s - self.threshold, -50, 50)))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column: features as bytes, or plain numbers."""
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, N_FEATURES) if pa.types.is_binary(column.type) else column.to_numpy()


def totals(df: DataFrame, f: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum of f(*columns), a vector for each batch, over all rows. One vector for each task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [0.0]
        for batch in batches:
            if batch.num_rows:
                found = found + f(*map(matrix, batch.columns)) if len(found) > 1 else f(*map(matrix, batch.columns))
        if len(found) > 1:
            yield pa.record_batch([pa.array([found.tobytes()], pa.binary())], names=["t"])

    return np.sum([np.frombuffer(r["t"]) for r in df.mapInArrow(run, "t binary").collect()], axis=0)


def quantile(values: DataFrame, n: int, share: float) -> float:
    """The exact quantile, between two values if it falls there, of n values (s), equal ones counted together, sorted by ranges."""
    held = cut(values.groupBy("s").count().repartitionByRange("s").withColumn("p", F.spark_partition_id()))
    sizes = sorted((r["p"], r["n"]) for r in held.groupBy("p").agg(F.sum("count").alias("n")).collect())

    def at(k: int) -> float:
        for p, size in sizes:
            if k < size:
                upto = F.sum("count").over(W.partitionBy("p").orderBy("s"))
                return held.where(F.col("p") == p).withColumn("upto", upto).where(F.col("upto") > k).agg(F.min("s")).first()[0]
            k -= size
        raise ValueError("no such rank")

    low = min(int(share * (n - 1)), n - 1)
    below, above = at(low), at(min(low + 1, n - 1))
    forget(held)
    return below + (share * (n - 1) - low) * (above - below)


def rank(rows: DataFrame, pairs: int = 40_000, steps: int = 60, ridge: float = 1e-4, small: int = 20_000) -> Ranker:
    """Fit the scores by Newton's method. rows (stored): doc_id, label, key and x, features as bytes.

    The j-th row of the larger class meets the (j + t)-th of the smaller, for as many t as make `pairs` pairs, or as many as there are
    rows if those are more; with t up to the size of the smaller class these are all pairs.
    """
    k = N_FEATURES
    size = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    good, bad = size.get(1, 0), size.get(0, 0)
    if not good or not bad:
        p = 0.5 if not good + bad else (0.999 if good else 0.001)
        return Ranker(np.zeros(k), np.ones(k), np.zeros(k), -math.log(p / (1 - p)))
    n, large, most, least = good + bad, int(good >= bad), max(good, bad), min(good, bad)
    centre = totals(rows.select("x"), lambda x: x.sum(0)) / n
    scale = np.maximum(np.sqrt(totals(rows.select("x"), lambda x: ((x - centre) ** 2).sum(0)) / n), 1e-6)
    standard = lambda x: np.clip((x - centre) / scale, -8, 8)

    tiles = min(least, -(-max(pairs, n) // most))
    ranked = numbered(rows, ["label"], [F.col("key"), F.col("doc_id")], "rank").withColumn("at", F.col("rank") - 1)
    one = ranked.where(F.col("label") == large).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select(F.col("x").alias("a"), ((F.col("at") + F.col("t")) % least).alias("at"))
    other = ranked.where(F.col("label") != large).select(F.col("x").alias("b"), "at")
    met = one.join(F.broadcast(other) if least <= small else other.hint("merge"), "at").select("a", "b")
    sign = 1 if large else -1

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = sign * (standard(matrix(batch.column(0))) - standard(matrix(batch.column(1))))
            yield pa.record_batch([pa.array([x.tobytes() for x in d], pa.binary())], names=["d"])

    stored, made = Stored(met.mapInArrow(differ, "d binary")), most * tiles
    w = np.zeros(k)
    for _ in range(steps):

        def slope(d: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            p = 1 / (1 + np.exp(-np.clip(d @ w, -50, 50)))
            return np.concatenate([d.T @ (1 - p), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])

        found = totals(stored.read(), slope) / made
        step = np.linalg.solve(found[k:].reshape(k, k) + ridge * np.eye(k), found[:k] - ridge * w)
        w = w + step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    stored.drop()

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(standard(matrix(batch.column(0))) @ w, pa.float64())], names=["s"])

    return Ranker(centre, scale, w, quantile(rows.select("x").mapInArrow(scores, "s double"), n, bad / n))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, small: int = 200_000) -> DataFrame:
    """doc_id, label, key (a hash that orders them) and x (features as bytes) of every labelled document.

    Rows without a label take no part; for conflicting labels of one document the larger counts. Rows that repeat an id
    train once, with the text of the smallest hash (null only if there is no other). Texts are not shuffled: up to `small`
    labels are broadcast, beyond that every row gets its features first.
    """

    def make():
        return lambda ids, texts: ((i, h, np.array(features(t), float).tobytes()) for i, h, t in zip(ids, (None if t is None else zlib.crc32(t.encode()) for t in texts), texts, strict=True))

    known = cut(labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label")))
    given, few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), known.count() <= small
    rows = map_rows(given.join(F.broadcast(known), "doc_id", "left_semi") if few else given, make, "doc_id long, h long, x binary")
    rows = rows.join(F.broadcast(known) if few else known.hint("merge"), "doc_id")
    one = F.min_by("x", F.when(F.col("h").isNotNull(), F.struct("h", "x")))
    return rows.groupBy("doc_id", "label").agg(F.coalesce(one, F.min("x")).alias("x")).select("doc_id", "label", F.xxhash64("doc_id").alias("key"), "x")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ranker:
    """Train on every labelled document."""
    rows = cut(training_rows(docs, labels, label))
    ranker = rank(rows)
    forget(rows)
    return ranker


def score_quality(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of every row."""

    def make():
        def f(ids: list, texts: list) -> Iterable[tuple]:
            scores = ranker.score(np.array([features(t) for t in texts]))
            return ((i, s, int(s >= 0.5)) for i, s in zip(ids, scores.tolist(), strict=True))

        return f

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of docs, all columns, that are not predicted bad."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(ranker.score(np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)))

    return docs.where(score(F.col("text")) >= 0.5)
