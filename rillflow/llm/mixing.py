"""Mixing domains to target weights with soft membership.

A multinomial naive Bayes classifier is learned from documents whose domain is labelled: how often each of their
words stands in each domain. It gives every document a posterior over the domains. Documents then get rates, how often
each is to be used, such that the expected tokens of each domain (tokens times posterior times rate) meet the
targets: least squares with a pull towards rate 1 that is small beside the rarest domain's share, solved to a stated
tolerance. Documents whose posteriors round to the same steps of 1 / steps form a cell and share a rate; all sums are of the
posteriors as they are, so rounding moves no domain's total. A cell's rate depends on its mean posterior and one number for
each domain alone (see fit_rates); each step is one distributed sum over the cells. Everything runs in DataFrame operations.

Defined results: a null text counts as empty, has no tokens and the prior as its posterior; labelled rows without
a domain do not train; without any labelled row all posteriors are even; domains without a target get target 0. Repeated rows
are documents like any others: each has its rate, and they have the same.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, join_spread


@dataclass(frozen=True)
class Classifier:
    """Per domain the log prior; words: every word of the sample (w) with its log share in each domain (l0, l1, ...)."""

    domains: list[str]
    prior: list[float]
    words: DataFrame | None


def tokens(text: Column) -> Column:
    """Lower-case words between white space; some may be empty, which count nowhere."""
    return F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), "\n\t\r\f\v", "     "), " ")


def spread(sizes: list[int], rows: int) -> list[int]:
    """How many of each size to take, `rows` in all: the same of each, and of those that have fewer, all."""
    left, out = rows, {}
    for k, i in enumerate(sorted(range(len(sizes)), key=sizes.__getitem__)):
        out[i] = min(sizes[i], max(1, left // (len(sizes) - k)))
        left -= out[i]
    return [out[i] for i in range(len(sizes))]


def learn(docs: DataFrame, labelled: DataFrame, domain: str, rows: int = 5_000, blend: float = 0.1) -> Classifier:
    """From at most `rows` labelled documents, drawn for each domain (so rare ones have their share): how often each word stands in each domain.

    All words of the sample count. A word's share in a domain is `blend` parts its mean share over the domains, so no
    word alone decides and rare domains are not favoured by words that they lack. The prior comes from all labelled ones.
    labelled: doc_id and domain of the documents that may train; their texts come from docs. Only these two columns are
    shuffled and sorted to choose by a hash; what was chosen, `rows` at most (one for each domain at least), is sent to
    the texts. Repeated ids all train.
    """
    named = cut(labelled.select("doc_id", F.col(domain).cast("string").alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL").distinct())
    sizes = {r["domain"]: r["n"] for r in named.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy("domain").collect()}
    if not sizes:
        return Classifier([], [], None)
    domains, n = list(sizes), sum(sizes.values())
    quota = named.sparkSession.createDataFrame([(d, q, min(1.0, (1.2 * q + 50) / sizes[d])) for d, q in zip(domains, spread(list(sizes.values()), rows), strict=True)], "domain string, quota long, near double")
    # the hash leaves few more rows than wanted before any are ranked
    close = named.withColumn("h", F.xxhash64("doc_id")).join(F.broadcast(quota), "domain").where(F.pmod("h", F.lit(1 << 30)) < F.col("near") * float(1 << 30))
    chosen = close.withColumn("k", F.row_number().over(W.partitionBy("domain").orderBy("h", "doc_id"))).where("k <= quota").select("doc_id", "domain")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("domain", F.explode(tokens(F.col("text"))).alias("w")).where("w <> ''")
    counts = cut(sample.groupBy("w").pivot("domain", domains).count().fillna(0).toDF("w", *(f"c{i}" for i in range(len(domains)))))
    totals = [max(1, x or 0) for x in counts.agg(*(F.sum(f"c{i}") for i in range(len(domains)))).first()]
    own = [F.col(f"c{i}") / x for i, x in enumerate(totals)]
    mean = sum(own, F.lit(0.0)) / len(domains)
    logs = (F.log((1 - blend) * x + blend * mean).alias(f"l{i}") for i, x in enumerate(own))
    return Classifier(domains, [math.log(sizes[d] / n) for d in domains], cut(counts.select("w", *logs)))


def posteriors(docs: DataFrame, by: Classifier, temper: float = 0.25) -> DataFrame:
    """docs' columns but the text, __n (tokens) and __p (posterior over the domains), one row for each of docs.

    Every word of the whole text counts that the sample holds; others say nothing. Evidence counts `temper` times, in texts of
    any length, as words of a text are not independent. No column of docs but the text should be large: they are shuffled.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    k = range(len(by.domains))
    said = F.col("w") != ""
    if by.words is not None:
        rows = docs.withColumn("__row", F.monotonically_increasing_id()).select("__row", *kept, F.explode(tokens(F.col("text"))).alias("w")).join(F.broadcast(by.words), "w", "left")
        out = rows.groupBy("__row", *kept).agg(F.count_if(said).cast("double").alias("__n"), *(F.coalesce(F.sum(f"l{d}"), F.lit(0.0)).alias(f"l{d}") for d in k))
    else:
        out = docs.withColumns({"__n": F.size(F.filter(tokens(F.col("text")), lambda w: w != "")).cast("double")} | {f"l{d}": F.lit(0.0) for d in k})
    out = out.withColumns({f"__l{d}": F.lit(by.prior[d]) + temper * F.col(f"l{d}") for d in k})
    most = F.greatest(*(F.col(f"__l{d}") for d in k)) if len(k) > 1 else F.col("__l0")
    out = out.withColumns({f"__e{d}": F.exp(F.col(f"__l{d}") - most) for d in k})
    total = sum((F.col(f"__e{d}") for d in k), F.lit(0.0))
    return out.select(*kept, "__n", F.array(*(F.col(f"__e{d}") / total for d in k)).alias("__p"))


def rate(push: list[float], least: float = 0.0) -> Column:
    """A cell's rate from what fit_rates() found."""
    return F.greatest(F.lit(least), F.lit(1.0) + sum((F.col("__p")[d] * F.lit(x) for d, x in enumerate(push)), F.lit(0.0)))


def fit_rates(known: DataFrame, targets: list[float], total: float, pull: float, least: float = 0.0, tolerance: float = 1e-6, most: int = 200) -> list[float]:
    """The push of each domain, from which rate() gives every cell's rate. known: __n, __p; targets: wanted shares of `total` tokens.

    Sought are rates r >= least with the least sum of e_d^2 / 2 over the domains' errors (shares of total) plus pull / 2 times
    the token-weighted mean of (r - 1)^2. There r = max(least, 1 + p . u) with u = -e / pull, so only u, a number for each
    domain, is to be found: the minimum of the convex function whose gradient is e + pull * u. Newton's method with halved
    steps; each step is a sum over the cells. It ends when no part of the gradient exceeds `tolerance` times its
    domain's target (the smallest one, where a domain has none).
    """
    k = len(targets)
    wanted = np.array(targets, float)
    close = tolerance * np.where(wanted > 0, wanted, min((w for w in targets if w > 0), default=1.0))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    p = [F.col("__p")[d] for d in range(k)]

    def at(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The function, its gradient and its second derivatives."""
        s = sum((x * F.lit(float(v)) for x, v in zip(p, u, strict=True)), F.lit(0.0))
        rows = known.select("__p", "__n", s.alias("__s")).withColumn("__free", F.col("__s") > least - 1)
        height = F.when(F.col("__free"), F.col("__s") + F.col("__s") * F.col("__s") / 2).otherwise(F.col("__s") * least - (least - 1) ** 2 / 2)
        sums = rows.agg(
            F.sum(F.col("__n") * height), *(F.sum(F.col("__n") * x * F.greatest(F.lit(least), 1 + F.col("__s"))) for x in p),
            *(F.sum(F.when(F.col("__free"), F.col("__n") * p[i] * p[j]).otherwise(0.0)) for i, j in pairs),
        ).first()
        v = np.array([x or 0.0 for x in sums]) / total
        second = pull * np.eye(k)
        for (i, j), x in zip(pairs, v[1 + k :], strict=True):
            second[i, j] += x
            second[j, i] = second[i, j]
        return v[0] + pull * u @ u / 2 - wanted @ u, v[1 : 1 + k] - wanted + pull * u, second

    u = np.zeros(k)
    value, slope, second = at(u)
    for _ in range(most):
        if (np.abs(slope) <= close).all():
            break
        scale = 1 / np.sqrt(np.diag(second))  # rare domains count as much as common ones
        step = -scale * np.linalg.solve(second * np.outer(scale, scale), scale * slope)
        fall, part = float(-slope @ step), 1.0
        while True:
            new = at(u + part * step)
            flat = fall < 1e-10 and np.abs(new[1] / close).max() < np.abs(slope / close).max()
            if new[0] <= value - 1e-4 * part * fall or flat or part < 1e-9:
                break
            part /= 2
        u, (value, slope, second) = u + part * step, new
    else:
        warnings.warn(f"rates: after {most} steps the largest error is {np.abs(slope / close).max():.3g} times the tolerance", stacklevel=2)
    return u.tolist()


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None, domain: str = "lang", flatten: float = 0.7, keep_all: bool = False, steps: int = 100) -> DataFrame:
    """doc_id and __hash of the text of every row of docs with __n, __p, __rate, __copies and __domains, the classifier's domains in the order of __p.

    weights: target share of each domain; None stands for the corpus's own expected shares to the power `flatten`.
    keep_all: rates of at least 1, for a total that makes this possible; else the total stays that of the corpus.
    steps: documents whose posteriors round to the same multiples of 1 / steps share a rate.
    """
    by = learn(docs, labelled, domain)
    if not by.domains:
        names = sorted(weights or {"all": 1.0})
        by = Classifier(names, [0.0] * len(names), None)
    scored = cut(posteriors(docs.select("doc_id", "text", text_hash().alias("__hash")), by)).withColumn("__cell", F.transform("__p", lambda p: F.round(p * steps).cast("int")))
    k = range(len(by.domains))
    sums = [F.sum(F.col("__n") * F.col("__p")[d]) for d in k]
    even = [F.avg(F.col("__p")[d]) for d in k]  # of a cell without tokens
    mean = F.array(*(F.when(F.sum("__n") > 0, x / F.sum("__n")).otherwise(y) for x, y in zip(sums, even, strict=True)))
    known = cut(scored.groupBy("__cell").agg(F.sum("__n").alias("__n"), mean.alias("__p"), F.count(F.lit(1)).alias("n")))
    first = known.agg(*(F.sum(F.col("__n") * F.col("__p")[d]).alias(f"d{d}") for d in k)).first()
    sums = [x or 0.0 for x in first]
    tokens = max(1.0, sum(sums))
    shares = [x / tokens for x in sums]
    wanted = [(weights or {}).get(d, 0.0) for d in by.domains] if weights else [s**flatten for s in shares]
    whole = sum(wanted) or 1.0
    wanted = [w / whole for w in wanted]
    total = tokens * (max([1.0, *(s / w for s, w in zip(shares, wanted, strict=True) if w > 0)]) if keep_all else 1.0)
    least = 1.0 if keep_all else 0.0
    # a domain reaches its target to about one part in 10,000, whatever its share
    pull = 1e-4 * min([x for x, w in zip(shares, wanted, strict=True) if x > 0 and w > 0], default=1.0)
    rates = rate(fit_rates(known, wanted, total, pull, least), least)
    rated = cut(known.select("__cell", "n", F.round(rates, 9).alias("__rate")))
    out = join_spread(scored, rated.select("__cell", "__rate"), ["__cell"], rated, ["doc_id", "__hash"])
    chance = F.pmod(F.xxhash64("doc_id", "__hash"), F.lit(1 << 20)) / float(1 << 20)
    return out.withColumn("__copies", F.floor(F.col("__rate") + chance).cast("int")).withColumn("__domains", F.array(*map(F.lit, by.domains)))


def text_hash(text: str = "text") -> Column:
    """128 bits of a text; null has its own."""
    return F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("null"))


def mixture(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None, **how) -> DataFrame:
    """doc_id, n_tokens, domain (likeliest; the first of equals), posterior (in the order of domains), rate, copies of every row."""
    out = mix(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labelled, weights, **how)
    best = F.element_at("__domains", F.array_position("__p", F.array_max("__p")).cast("int"))
    return out.select("doc_id", F.col("__n").cast("long").alias("n_tokens"), best.alias("domain"), F.col("__domains").alias("domains"), F.col("__p").alias("posterior"), F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, **how) -> DataFrame:
    """The rows of docs, all columns, each as often as its copies say."""
    # rows of the same id and text have the same copies; stored, so that the rates are worked out once
    copies = cut(mix(docs, labelled, weights, **how).select(F.col("doc_id").alias("__id"), "__hash", "__copies").dropDuplicates(["__id", "__hash"]).where("__copies > 0"))
    # the rows of docs travel as one column, so none of their names clashes
    own = docs.select(F.struct("*").alias("row")).withColumn("__h", text_hash("row.text"))
    out = own.join(copies, F.col("row.doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("row.*")
