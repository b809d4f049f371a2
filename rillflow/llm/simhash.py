"""Near-duplicates by SimHash, compared exactly in tiles.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of a text's word shingles. Equal
fingerprints are one node from then on, so copies never multiply. Two nodes within `radius` bits agree in at
least one of radius + 1 bands of the 64 bits (nothing else can lie within the radius), so comparison stays within
bands' values. Such a bucket is cut into tiles by population count; a tile meets itself and those whose count
differs by at most `radius`, all others are skipped. A pair of tiles is compared with numpy's exclusive-or and
bit counts and gives a spanning forest of its links, never all pairs. Tiles beyond `tile` nodes are split by a
hash, so one bucket spreads over many tasks. Joins deal out the rows of common keys (a bucket, the root of a large group,
the fingerprint of very many copies).

Defined results: a null text counts as empty; texts without words have fingerprint 0 and are linked like any
other; null ids take part, a group's id is its smallest id that is not null (null if there is none).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, forget, join_spread, map_rows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    found = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = [digest(b" ".join(found), seed)]
    else:
        hashes = [digest(b" ".join(s), seed) for s in zip(*(found[k:] for k in range(words)), strict=False)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.array(hashes[at : at + 8192], ">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def make():
        return lambda ids, texts: ((i, signed(fingerprint(t, words))) for i, t in zip(ids, texts, strict=True))

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, fp long")


def bands(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of radius + 1 bands that cover 64 bits."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def forest(values: np.ndarray, left: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join whatever lies within the radius, between values[left] and all values: at most one for each value."""
    n = len(values)
    label, bits = np.arange(n), values.view(np.uint64)  # numpy counts the bits of a negative number's absolute value
    rows = np.flatnonzero(left)
    for at in range(0, len(rows), 512):
        part = rows[at : at + 512]
        near = np.bitwise_count(bits[part, None] ^ bits[None, :]) <= radius
        for i, links in zip(part, near, strict=True):
            found = np.unique(label[links])
            if len(found) > 1 or found[0] != label[i]:
                label[np.isin(label, np.append(found, label[i]))] = min(found[0], label[i])
    return [(int(values[i]), int(values[k])) for i, k in enumerate(label) if i != k]


def links(nodes: DataFrame, radius: int = 2, tile: int = 2048) -> DataFrame:
    """(a, b) pairs of fingerprints whose connected components are those of all pairs within the radius. nodes: distinct fp."""
    banded = F.explode(F.array(*(F.struct(F.lit(k).alias("band"), F.expr(f"shiftrightunsigned(shiftleft(fp, {64 - a - n}), {64 - n})").alias("value")) for k, (a, n) in enumerate(bands(radius)))))
    rows = nodes.select("fp", F.expr("bit_count(fp)").alias("ones"), banded.alias("b")).select("fp", "ones", "b.*")
    bucket = ["band", "value"]
    counts = rows.groupBy(*bucket, "ones").agg(F.count(F.lit(1)).alias("n"))
    # at most 65 population counts in a bucket
    sizes = counts.groupBy(*bucket).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).cast("int")))).alias("cuts")).where("total > 1")
    sizes = cut(sizes)
    rows = join_spread(rows, sizes, bucket, sizes.select(*bucket, F.col("total").alias("n")), ["fp"])
    small = rows.where(F.col("total") <= tile).select(*bucket, F.lit(0).alias("tile_a"), F.lit(0).alias("tile_b"), F.lit(True).alias("left"), "fp")
    # Tile number: population count * 2^20 + part. Of a pair of tiles the one with the smaller number is on the left.
    large = rows.where(F.col("total") > tile)
    own = F.col("ones") * F.lit(1 << 20) + F.pmod(F.xxhash64("fp"), F.element_at("cuts", F.col("ones"))).cast("int")
    others = F.flatten(
        F.transform(
            F.sequence(F.col("ones") - radius, F.col("ones") + radius),
            lambda o: F.when(F.map_contains_key("cuts", o), F.transform(F.sequence(F.lit(0), F.element_at("cuts", o) - 1), lambda p: o * F.lit(1 << 20) + p)).otherwise(F.array().cast("array<int>")),
        )
    )
    large = large.withColumn("own", own).withColumn("other", F.explode(others))
    large = large.select(*bucket, F.least("own", "other").alias("tile_a"), F.greatest("own", "other").alias("tile_b"), (F.col("own") <= F.col("other")).alias("left"), "fp")
    key = [*bucket, "tile_a", "tile_b"]
    work = small.unionByName(large).repartition(*key).sortWithinPartitions(*key)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(units: list[tuple]) -> pa.RecordBatch:
            out = [x for values, left in units for x in forest(values, left, radius)]
            return pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        def unit(parts: list[tuple]) -> tuple:
            return np.concatenate([v for _, v, _ in parts]), np.concatenate([x for *_, x in parts])

        for batch in batches:
            keys = [batch[k].to_numpy() for k in key]
            values, left = batch["fp"].to_numpy(), batch["left"].to_numpy(zero_copy_only=False)
            edge = np.ones(batch.num_rows, bool)
            edge[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            starts, units = np.flatnonzero(edge), []
            for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                k = tuple(int(x[s]) for x in keys)
                if held and held[0][0] != k:
                    units.append(unit(held))
                    held = []
                held.append((k, values[s:e], left[s:e]))
            if units:
                yield done(units)
        if held:
            yield done([unit(held)])

    return work.select(*key, "left", "fp").mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps (joining each node's neighbours to the smallest one) until nothing
    changes; each round is stored, the rounds grow with the logarithm of the longest chain.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n")))
        met = join_spread(both, least.select("a", "m"), ["a"], least.select("a", "n"), ["b"])  # a large group's smallest node has very many neighbours
        if large:
            return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(edges)
    while before[0]:
        old, middle = edges, cut(star(edges, True))
        edges = cut(star(middle, False))
        forget(old, middle)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def least_of_groups(nodes: DataFrame, radius: int = 2, tile: int = 2048) -> DataFrame:
    """nodes (fp, least; one row for each fp, stored) with the smallest `least` of the group instead: fp, least."""
    roots = components(links(nodes.select("fp"), radius, tile)).withColumnRenamed("node", "fp")
    linked = nodes.join(roots, "fp")
    groups = cut(linked.groupBy("root").agg(F.min("least").alias("best"), F.count(F.lit(1)).alias("n")))
    named = join_spread(linked.select("fp", "root"), groups.select("root", "best"), ["root"], groups.select("root", "n"), ["fp"]).select("fp", "best")
    return nodes.join(named, "fp", "left").select("fp", F.when(F.col("best").isNull(), F.col("least")).otherwise(F.col("best")).alias("least"))


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, tile: int = 2048) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    rows = cut(fingerprints(docs, words))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    groups = cut(least_of_groups(nodes.select("fp", "least"), radius, tile))
    # a fingerprint of very many copies is dealt out
    return join_spread(rows, groups, ["fp"], nodes.select("fp", "n"), ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, radius: int = 2, words: int = 3, tile: int = 2048) -> DataFrame:
    """The rows of docs, all columns, one of each group: that with the smallest doc_id (rows without one come last, by a hash of the text)."""

    def make():
        return lambda ids, hashes, texts: ((i, h, signed(fingerprint(t, words))) for i, h, t in zip(ids, hashes, texts, strict=True))

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = map_rows(keyed, make, "doc_id long, text_hash long, fp long")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    nodes = cut(rows.groupBy("fp").agg(F.min(key).alias("least")))
    kept = cut(least_of_groups(nodes, radius, tile).select("least.doc_id", "least.text_hash").distinct())
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    # the rows of docs travel as one column, so none of their names clashes
    own = docs.select(F.struct("*").alias("row")).withColumn("__own", F.xxhash64("row.text"))
    met = own.join(kept, F.col("row.doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")))
    first = W.partitionBy("__id", "__hash").orderBy("__hash")  # repeated rows of one document
    return met.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("row.*")
