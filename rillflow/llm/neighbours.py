"""Approximate nearest neighbours by stable random projections and a kd-tree.

Largest inner product is nearest neighbour search once every vector gets one more component that brings all to
one norm. Vectors are projected to a few dimensions with a Gaussian (2-stable) matrix: a squared projected
distance over the squared true distance follows a chi-square law. A kd-tree over the projections of a bounded
sample cuts the space into cells; every vector is put into its cell. A query first searches its own cell; its
k-th distance then gives the projected radius beyond which, by the chi-square test, a better neighbour is missed
with a probability of at most 1 - confidence. What the radius reaches is searched next, in the order of projected
distance, verified on the true vectors until the test holds.

Further cells are searched a branch of the tree at a time, as large as fits a task (about 16 MB of vectors), so that a query's
vector travels once to a branch and not to each of its cells. Branches and their queries are split by hash where they grow
beyond that, so common vectors spread.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another length than
most, take no part; neither do null ids. Ties go to the smaller id. Rows that repeat an id count once; if their vectors
differ, with the largest in the order of their components.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def chi_square_quantile(p: float, even: int) -> float:
    """Inverse of the chi-square distribution function for an even number of degrees."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, even // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


@dataclass(frozen=True)
class Index:
    """Projection matrix, the common norm, and the tree: node i has children 2i+1 and 2i+2, leaves are the cells."""

    matrix: np.ndarray
    norm: float
    axis: np.ndarray
    value: np.ndarray
    depth: int

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return x @ self.matrix[:-1] + more[:, None] * self.matrix[-1]

    def cell(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] > self.value[node])
        return node - (2**self.depth - 1)

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        m = self.matrix.shape[1]
        low, high = np.full((1, m), -np.inf), np.full((1, m), np.inf)
        for level in range(self.depth):
            nodes = np.arange(2**level - 1, 2 ** (level + 1) - 1)
            low, high = np.repeat(low, 2, 0), np.repeat(high, 2, 0)
            high[0::2][np.arange(len(nodes)), self.axis[nodes]] = self.value[nodes]
            low[1::2][np.arange(len(nodes)), self.axis[nodes]] = self.value[nodes]
        return low, high

    def distances(self, p: np.ndarray) -> np.ndarray:
        """Squared projected distance of each row to each cell."""
        low, high = self.boxes()
        return sum((np.maximum(np.maximum(low[:, a] - p[:, a, None], p[:, a, None] - high[:, a]), 0)) ** 2 for a in range(p.shape[1]))


def build(sample: np.ndarray, norm: float, depth: int, dimensions: int, seed: int) -> Index:
    matrix = np.random.default_rng(seed).standard_normal((sample.shape[1] + 1, dimensions))
    index = Index(matrix, norm, np.zeros(2**depth, np.int64), np.zeros(2**depth), depth)
    p = index.project(sample, False)
    groups = [np.arange(len(p))]
    for level in range(depth):
        new = []
        for k, rows in enumerate(groups):
            part = p[rows] if len(rows) else p[:1]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            value = float(np.median(part[:, axis]))
            index.axis[2**level - 1 + k], index.value[2**level - 1 + k] = axis, value
            new += [rows[p[rows, axis] <= value], rows[p[rows, axis] > value]]
        groups = new
    return index


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~odd & F.exists("v", lambda x: x != 0))


def one_of_each(rows: DataFrame) -> DataFrame:
    """rows (vec_id, v) with one vector for each id. Only ids are counted; vectors are shuffled only where ids repeat."""
    repeated = cut(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    if repeated.isEmpty():
        return rows
    merged = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.max("v").alias("v"))
    return rows.join(repeated, "vec_id", "left_anti").unionByName(merged)


def top(found: DataFrame, k: int) -> DataFrame:
    """query_id with its k best as lists, best first. Each searched unit has already cut its own rows to k."""
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k)
    return found.groupBy("query_id").agg(best.alias("best"))


def verified(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, near: np.ndarray, bound: float, norm: float, k: int, chi: float, skip: np.ndarray | bool = False) -> np.ndarray:
    """Rows of x: the k best of those verified. near: squared projected distances; bound: squared distance to beat; skip: rows that take no part.

    Rows are verified in blocks by rising projected distance, each four times the size of the one before; the k-th
    best of a block tightens the bound, and what then fails the chi-square test is never verified.
    """
    base, best, score, size = norm**2 + q @ q, np.zeros(0, np.int64), np.zeros(0), 256
    whole = None
    left = np.flatnonzero((near <= chi * bound * (1 + 1e-9) + 1e-9) & (ids != own) & ~np.asarray(skip, bool))
    while len(left):
        if len(left) > size:
            parted = left[np.argpartition(near[left], size)]
            block, left = parted[:size], parted[size:]
        else:
            block, left = left, left[:0]
        # Reading all rows in turn costs less than picking many out; both give a row the same sum.
        if whole is None and 4 * len(block) > len(x):
            whole = np.einsum("ij,j->i", x, q)
        new = np.einsum("ij,j->i", x[block], q) if whole is None else whole[block]
        if len(best) == k:
            better = new >= score[-1]
            block, new = block[better], new[better]
        best, score = np.append(best, block), np.append(score, new)
        first = np.lexsort((ids[best], -score))[:k]
        best, score = best[first], score[first]
        if len(first) == k and len(left):
            bound = min(bound, max(0.0, base - 2 * score[-1]))
            left = left[near[left] <= chi * bound * (1 + 1e-9) + 1e-9]
        size *= 4
    return best


def search(visits: DataFrame, held: DataFrame, index: Index, k: int, confidence: float) -> DataFrame:
    """(query_id, vec_id, score): up to k for each query and searched unit. visits: unit, query_id, v, bound (squared distance or null), seen (a cell left out); held: unit, vec_id, v, cell."""
    chi = chi_square_quantile(confidence, index.matrix.shape[1])

    def look(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        x, q, ids, cells = np.stack(held["v"].to_numpy()), np.stack(asked["v"].to_numpy()), held["vec_id"].to_numpy(), held["cell"].to_numpy()
        names, bounds, seen = asked["query_id"].to_numpy(), asked["bound"].fillna(np.inf).to_numpy(float), asked["seen"].to_numpy()
        px, pq = index.project(x, False), index.project(q, True)
        x2, out = (px * px).sum(1), []
        for at in range(0, len(q), 64):
            part = slice(at, at + 64)
            near = x2 - 2 * pq[part] @ px.T + (pq[part] ** 2).sum(1)[:, None]
            for i, row in enumerate(near, at):
                rows = verified(x, ids, q[i], names[i], row, bounds[i], index.norm, k, chi, cells == seen[i])
                out.append((np.full(len(rows), names[i]), ids[rows], (x[rows] * q[i]).sum(1)))
        return pd.DataFrame({n: np.concatenate([o[c] for o in out]) for c, n in enumerate(("query_id", "vec_id", "score"))})

    return visits.groupBy("unit").cogroup(held.groupBy("unit")).applyInPandas(look, "query_id long, vec_id long, score double")


def units(visits: DataFrame, placed: DataFrame, shift: int, sizes: dict[int, int], rows: int, asks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with `unit`: a part of a branch (cells that are equal but for their last `shift` bits; at most `rows` rows or so) times a part of its queries (`asks`). visits: branch, ...; sizes: rows of each branch."""
    asked = {r["branch"]: r["count"] for r in visits.groupBy("branch").count().collect()}  # as many rows as branches
    spark = visits.sparkSession
    least = -(-spark.sparkContext.defaultParallelism // max(1, len(asked)))  # few branches: their queries are dealt out more, 128 to a task at least
    plan = spark.createDataFrame([(c, -(-sizes.get(c, 1) // rows), max(1, min(least, n // 128), -(-n // asks))) for c, n in asked.items()], "branch long, parts long, turns long")
    v = visits.join(F.broadcast(plan), "branch").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    v = v.withColumn("unit", F.concat_ws(":", "branch", "part", F.pmod(F.xxhash64("query_id"), "turns")))
    c = placed.withColumn("branch", F.shiftright("cell", shift)).join(F.broadcast(plan), "branch").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    c = c.withColumn("unit", F.concat_ws(":", "branch", F.pmod(F.xxhash64("vec_id"), "parts"), "turn"))
    return v.select("unit", "query_id", "v", "bound", "seen"), c.select("unit", "vec_id", "v", "cell")


def nearest(vectors: DataFrame, k: int = 20, is_query: str = "vec_id % 20 = 0", key: str = "vec_id", vector: str = "embedding", confidence: float = 0.97, dimensions: int = 8, cell: int = 2048, sample_rows: int = 20_000, unit_bytes: int = 16 << 20, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest by inner product. The tree is fit on at most sample_rows vectors; all are indexed."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = valid(vectors, key, vector)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], schema)
    rows = one_of_each(rows.where(F.size("v") == common["n"]))
    norm = math.sqrt(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]) * (1 + 1e-12)
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").collect()])
    depth = max(0, min(int(math.log2(max(1, common["count"] / cell))), int(math.log2(max(1, len(sample) / 16)))))
    index = build(sample, norm, depth, dimensions, seed)
    chi = chi_square_quantile(confidence, dimensions)
    unit_rows = max(256, unit_bytes // (8 * common["n"]))
    shift = max(0, depth - math.ceil(math.log2(max(1.0, 2 * common["count"] / unit_rows))))

    def place(frames):  # noqa: ANN001, ANN202
        for f in frames:
            if len(f):
                yield f.assign(cell=index.cell(index.project(np.array(f["v"].tolist()), False)))

    placed = cut(rows.mapInPandas(place, "vec_id long, v array<double>, cell long"))
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    branches: dict[int, int] = defaultdict(int)
    for c, n in sizes.items():
        branches[c >> shift] += n
    queries = placed.where(is_query.replace(key, "vec_id")).select(F.col("vec_id").alias("query_id"), "v")

    def home(frames):  # noqa: ANN001, ANN202
        full = np.array([sizes.get(c, 0) > 0 for c in range(2**depth)])
        for f in frames:
            if len(f):
                near = index.distances(index.project(np.array(f["v"].tolist()), True))
                yield f.assign(branch=np.argmin(np.where(full, near, np.inf), 1), bound=np.nan, seen=-1)

    start = cut(queries.mapInPandas(home, "query_id long, v array<double>, branch long, bound double, seen long"))
    first = cut(search(*units(start, placed, 0, sizes, 2 * cell, 2 * cell), index, k, confidence))
    bound = top(first, k).select("query_id", F.when(F.size("best") == k, -F.element_at("best", -1)["less"]).alias("kth"))
    asked = start.select("query_id", "v", F.col("branch").alias("seen")).join(bound, "query_id", "left")

    def reach(frames):  # noqa: ANN001, ANN202
        for f in frames:
            if not len(f):
                continue
            q = np.array(f["v"].tolist())
            limit = np.maximum(norm**2 + (q * q).sum(1) - 2 * f["kth"].fillna(-np.inf).to_numpy(), 0)
            near = index.distances(index.project(q, True)) <= (chi * limit * (1 + 1e-9) + 1e-9)[:, None]
            near[np.arange(len(q)), f["seen"].to_numpy()] = False
            i, c = np.nonzero(near.reshape(len(q), -1, 1 << shift).any(2))
            yield pd.DataFrame({"query_id": f["query_id"].to_numpy()[i], "v": f["v"].to_numpy()[i], "branch": c, "bound": limit[i], "seen": f["seen"].to_numpy()[i]})

    others = cut(asked.mapInPandas(reach, "query_id long, v array<double>, branch long, bound double, seen long").replace(float("inf"), None, ["bound"]))
    second = search(*units(others, placed, shift, branches, unit_rows, unit_rows), index, k, confidence)
    best = top(first.unionByName(second), k).select("query_id", F.posexplode("best").alias("at", "b"))
    return best.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.less")).alias("score"))
