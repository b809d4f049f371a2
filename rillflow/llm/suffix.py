"""Exact removal of repeated byte strings with suffix arrays over shards.

A window is a string of `length` bytes; with two lengths the shorter one, and what is said of windows holds for strings of
the longer one that start where a window does. Suffix arrays over a whole corpus cannot be merged shard by shard in
reasonable time, so the work is divided by content first, without losing a match. Each window is filed under its
smallest hash among those of its strings of a third of its length (equal windows are filed alike), and a run is a
stretch of window starts filed under one key, with the bytes that its strings cover as its context. Runs whose key occurs
nowhere else hold no repeated window. Runs of one key with equal contexts repeat as a whole and need no further
look, so thousands of copies count as one. What is left (the ends of repeated passages) forms shards by key:
each shard's suffix array is made by Larsson-Sadakane refinement, its common prefixes by Kasai's argument, and a
window is repeated if a neighbour in the array shares `length` bytes. A key with more than `most` different
contexts is cut into several shards; these exchange digests of their distinct windows, sorted, and find matches
in each other by binary search. Joins by key deal out the rows of common keys, so that no passage, however common,
has all its rows in one task.

Defined results: a null text counts as empty. Texts shorter than `length` keep everything. Repeated rows are
texts like any others, so they remove each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, arrow_schema, cut, forget, join_spread, map_rows

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 17), base, np.uint64)
        x[0] = 1
        _POWERS[int(base)] = have = np.multiply.accumulate(x)
        if n > 1 << 22:
            del _POWERS[int(base)]
    return have[:n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k bytes that depends on those bytes alone."""
    n = len(data)
    value = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    value ^= value >> np.uint64(29)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value * powers(_BASE, n), out=total[1:])
    h = (total[k:] - total[:-k]) * powers(_BASE_INVERSE, n - k + 1)
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours."""
    n, low, span = len(h) - w + 1, h, 1
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[:n], low[w - span : w - span + n])


def runs(data: bytes, near: int, far: int, longest: int = 4096) -> tuple[np.ndarray, ...] | None:
    """Of each run of windows of `near` bytes: key, context hash, first start, starts, bytes of the context, key occurs twice in this text.

    A context reaches `far` bytes from the last start, or to the text's end.
    """
    if len(data) < near:
        return None
    k = max(1, near // 3)
    h = gram_hashes(np.frombuffer(data, np.uint8), k)
    key = window_minima(h, near - k + 1)
    edge = np.flatnonzero(key[1:] != key[:-1]) + 1
    starts = np.concatenate([[0], edge])
    ends = np.append(edge, len(key))
    if (ends - starts).max() > longest:
        parts = [np.arange(s, e, longest) for s, e in zip(starts, ends, strict=True)]
        starts = np.concatenate(parts)
        ends = np.append(starts[1:], len(key))
    keys = key[starts]
    # Occurrences of the keys among all hashes, looked for through a small table first.
    table = np.zeros(1 << 16, bool)
    table[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    found = h[table[(h & np.uint64(0xFFFF)).astype(np.int64)]]
    value, times = np.unique(found, return_counts=True)
    twice = times[np.searchsorted(value, keys)] > 1
    digest = xxhash.xxh3_64_intdigest
    stops = np.minimum(ends - 1 + far, len(data))
    contexts = np.array([digest(data[s:e]) for s, e in zip(starts.tolist(), stops.tolist(), strict=True)], np.uint64)
    contexts += (ends - starts).astype(np.uint64) * _MIX  # at a text's end equal bytes may hold unequal numbers of starts
    return keys.view(np.int64), contexts.view(np.int64), starts, ends - starts, stops - starts, twice


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each): Larsson and Sadakane's doubling, in which only groups not yet told apart are sorted again.

    No two suffixes of codes may be equal up to the end of the shorter one: separators have codes of their own.
    """
    n, bits = len(codes), int(codes.max()).bit_length() if len(codes) else 1
    h = max(1, 62 // bits)  # so many letters are told apart by the first sort
    start = codes.copy()
    for k in range(1, h):
        start <<= bits
        start[: max(0, n - k)] |= codes[k:]
    order = np.argsort(start)
    start = start[order]
    first = np.concatenate([[True], start[1:] != start[:-1]])[:n]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    place = np.arange(n)
    while True:
        alone = first & np.append(first[1:], True)[:n]
        place, order, first = place[~alone], order[~alone], first[~alone]
        if not len(order):
            break
        value = rank[order] * (n + 1) + rank[np.minimum(order + h, n - 1)]
        again = np.argsort(value)
        order, value = order[again], value[again]
        first = np.concatenate([[True], value[1:] != value[:-1]])
        rank[order] = place[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        h *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, rank


def common_prefixes(codes: np.ndarray, suffixes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Length of what each suffix shares with the one before it in order.

    By Kasai's argument the suffix one to the right shares at least one less, and exactly one less if the letters to
    the left of both are equal; only the others are compared, all at once, a block at a time.
    """
    n = len(codes)
    before = np.full(n, -1, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    own = np.arange(n)
    known = before >= 0
    fresh = known.copy()
    fresh[1:] &= ~((before[1:] > 0) & (codes[:-1] == codes[np.maximum(before[1:], 1) - 1]))
    at = own[fresh]
    shared = np.zeros(n, np.int64)
    padded = np.concatenate([codes, -1 - np.arange(16)])
    block = np.arange(16)
    active, done = at, np.zeros(len(at), np.int64)
    index = np.arange(len(at))
    while len(active):
        left = padded[np.minimum(active + done[index], n)[:, None] + block]
        right = padded[np.minimum(before[active] + done[index], n)[:, None] + block]
        same = np.logical_and.accumulate(left == right, axis=1).sum(1)
        done[index] += same
        more = same == 16
        active, index = active[more], index[more]
    shared[at] = done
    base = np.maximum.accumulate(np.where(fresh | ~known, own, 0))
    plcp = np.where(known, np.maximum(shared[base] - (own - base), 0), 0)
    return plcp[suffixes]


def repeated_windows(contexts: list[bytes], starts: list[int], lengths: tuple[int, ...]) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """For each length: of each context, which of its first starts[i] windows occur twice or more in the shard; and one place (context, start) of each distinct window."""
    sizes = [len(c) for c in contexts]
    codes = np.empty(sum(sizes) + len(contexts), np.int64)
    owner, offset = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
    at = 0
    for i, c in enumerate(contexts):
        n = len(c)
        codes[at : at + n] = np.frombuffer(c, np.uint8)
        codes[at : at + n] += len(contexts)
        codes[at + n] = i
        owner[at : at + n + 1] = i
        offset[at : at + n + 1] = np.arange(n + 1)
        at += n + 1
    suffixes, rank = suffix_array(codes)
    shared, out = common_prefixes(codes, suffixes, rank), []
    of, at = owner[suffixes], offset[suffixes]
    own = at < np.array(starts)[of]
    long_enough = np.array(sizes)[of] - at
    for length in lengths:
        same = shared >= length
        window = own & (long_enough >= length)
        group = np.cumsum(~same)  # suffixes that share `length` bytes; only windows count, as contexts of one text overlap beyond them
        found = suffixes[window & (np.bincount(group[window], minlength=len(codes) + 1)[group] > 1)]
        marks = [np.zeros(n, bool) for n in starts]
        for i, o in zip(owner[found].tolist(), offset[found].tolist(), strict=True):
            marks[i][o] = True
        _, first = np.unique(group[window], return_index=True)
        one = suffixes[window][first]
        out.append((marks, np.stack([owner[one], offset[one]], 1)))
    return out


def stretches(marks: np.ndarray) -> Iterable[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


SHARD_SCHEMA = "key long, ctx long, level int, lo long, hi long, digest binary, shard long"


def search_shards(shards: DataFrame, lengths: tuple[int, ...], batch_bytes: int = 1 << 20) -> DataFrame:
    """Rows (key, ctx, shard, split, starts, context), together by key and shard -> for each length (level) the stretches [lo, hi) of repeated starts; for split keys also the digest of one place of each distinct window."""
    schema = arrow_schema(SHARD_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def solve(rows: list[dict]) -> pa.RecordBatch:
            out = []
            found = repeated_windows([r["context"] for r in rows], [r["starts"] for r in rows], lengths)
            for level, (marks, places) in enumerate(found):
                for r, m in zip(rows, marks, strict=True):
                    out += [(r["key"], r["ctx"], level, a, b, None, r["shard"]) for a, b in stretches(m)]
                for i, o in places.tolist():
                    r = rows[i]
                    if r["split"]:
                        d = hashlib.blake2b(r["context"][o : o + lengths[level]], digest_size=16).digest()
                        out.append((r["key"], r["ctx"], level, o, o + 1, d, r["shard"]))
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                # a shard's rows stay together; short ones share an array
                if held and size >= batch_bytes and (r["key"], r["shard"]) != (held[-1]["key"], held[-1]["shard"]):
                    yield solve(held)
                    held, size = [], 0
                held.append(r)
                size += len(r["context"]) + 1
        if held:
            yield solve(held)

    return shards.select("key", "ctx", "shard", "split", "starts", "context").mapInArrow(run, SHARD_SCHEMA)


def merge_shards(found: DataFrame) -> DataFrame:
    """Windows of split keys that occur in several shards: key, ctx, level, lo, hi."""
    names = ["key", "ctx", "level", "lo", "hi"]

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        every = np.sort(np.array([bytes(d) for d in rows["digest"]], "S16"))
        keep = []
        for _, own in rows.groupby("shard"):
            d = np.array([bytes(x) for x in own["digest"]], "S16")
            keep.append(own[np.searchsorted(every, d, "right") - np.searchsorted(every, d, "left") > 1])
        return pd.concat(keep)[names] if keep else rows[names]

    part = F.pmod(F.xxhash64("key", "digest"), F.lit(1024)).alias("part")
    return found.where("digest is not null").groupBy("key", "level", part).applyInPandas(merge, "key long, ctx long, level int, lo long, hi long")


RUN_SCHEMA = "key long, ctx long, doc_id long, text_hash long, start int, n int, size int, twice boolean"


def file_runs(texts: DataFrame, near: int, far: int) -> DataFrame:
    """A row for each run of each text (doc_id, text_hash, text)."""
    schema = arrow_schema(RUN_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            rows = 0
            for i in range(batch.num_rows):
                found = runs(batch["text"][i].as_py().encode("utf-8", "surrogatepass"), near, far)
                if found:
                    key, ctx, start, n, size, twice = found
                    none = batch["doc_id"][i].as_py() is None
                    held.append((key, ctx, np.full(len(key), 0 if none else batch["doc_id"][i].as_py()), np.full(len(key), batch["text_hash"][i].as_py()), start, n, size, twice, np.full(len(key), none)))
                    rows += len(key)
                if held and (rows > 50_000 or i + 1 == batch.num_rows):
                    *cols, none = (np.concatenate(c) for c in zip(*held, strict=True))
                    yield pa.record_batch([pa.array(c, f.type, mask=none if f.name == "doc_id" else None) for c, f in zip(cols, schema, strict=True)], schema=schema)
                    held, rows = [], 0

    return texts.select("doc_id", "text_hash", "text").mapInArrow(run, RUN_SCHEMA)


def spans(docs: DataFrame, lengths: tuple[int, ...] = (400,), most: int = 2048) -> DataFrame:
    """(doc_id, text_hash, spans): for rows of docs by id and xxhash64 of the text, the set of (level, lo, hi): stretches of bytes covered by a window that also starts anywhere else. Level k is for windows of lengths[k] bytes, one or two lengths, rising.

    Stretches of one row may meet or overlap. Rows in which nothing repeats are left out.
    """
    near, far = lengths[0], lengths[-1]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    long_enough = own.where(F.octet_length("text") >= near)
    filed = Stored(file_runs(long_enough, near, far))
    count = F.count(F.lit(1)).alias("n")
    shared = cut(filed.read().groupBy("key").agg(count, F.max("twice").alias("any")).where((F.col("n") > 1) | F.col("any")).select("key", "n"))
    rows = Stored(join_spread(filed.read().drop("twice").withColumnRenamed("n", "starts"), shared.select("key"), ["key"], shared, ["doc_id", "text_hash", "start"]))
    place = F.min(F.struct("doc_id", "text_hash", "start", "starts", "size")).alias("place")
    contexts = cut(rows.read().groupBy("key", "ctx").agg(count, place))
    filed.drop()
    forget(shared)
    # what is equal as a whole: the windows of each length that the context holds
    fits = [F.least(F.col("place.starts"), F.col("place.size") - (length - 1)).cast("long") for length in lengths]
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.lit(0).cast("long").alias("lo"), x.alias("hi")) for k, x in enumerate(fits))))
    whole = contexts.where("n > 1").select("key", "ctx", levels.alias("w")).select("key", "ctx", "w.*").where("hi > 0")
    kinds = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("rarest"))
    # a key with one context of one run is here because it occurs twice within that run
    unsure = cut(kinds.where("rarest = 1").select("key", F.col("kinds").alias("n"), F.ceil(F.col("kinds") / most).cast("int").alias("shards")))
    asked = join_spread(contexts.select("key", "ctx", "place.*"), unsure.select("key", "shards"), ["key"], unsure, ["ctx"])
    asked = asked.withColumns({"shard": F.pmod("ctx", "shards").cast("long"), "split": F.col("shards") > 1})
    shards = with_contexts(asked, long_enough, far).repartition("key", "shard").sortWithinPartitions("key", "shard")
    found = cut(search_shards(shards, lengths))
    forget(unsure)
    repeated = whole.unionByName(found.where("digest is null").select("key", "ctx", "level", "lo", "hi")).unionByName(merge_shards(found))
    met = join_spread(rows.read().drop("starts", "size"), repeated, ["key", "ctx"], contexts.select("key", "ctx", "n"), ["doc_id", "text_hash", "start"])
    widths = F.element_at(F.array(*(F.lit(x) for x in lengths)), F.col("level") + 1)
    met = met.select("doc_id", "text_hash", F.struct("level", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") - 1 + widths).alias("hi")).alias("span"))
    out = cut(met.groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans")))
    forget(contexts, found)
    rows.drop()
    return out


def same_text(ids: Column, hashes: Column, other_ids: Column, other_hashes: Column) -> Column:
    return ids.eqNullSafe(other_ids) & (hashes == other_hashes)


def with_contexts(asked: DataFrame, texts: DataFrame, far: int) -> DataFrame:
    """asked rows with the bytes of their contexts; a text's rows travel to it together."""
    wanted = asked.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("key", "ctx", "shard", "split", "start", "starts", "size")).alias("asked"))
    met = wanted.alias("w").join(texts.alias("t"), same_text(F.col("w.doc_id"), F.col("w.text_hash"), F.col("t.doc_id"), F.col("t.text_hash")))
    kinds = {"key": pa.int64(), "ctx": pa.int64(), "shard": pa.int64(), "split": pa.bool_(), "starts": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, rows = batch["text"][k].as_py().encode("utf-8", "surrogatepass"), batch["asked"][k].as_py()
                cols = [pa.array([r[c] for r in rows], t) for c, t in kinds.items()]
                yield pa.record_batch([*cols, pa.array([text[r["start"] : r["start"] + r["size"]] for r in rows], pa.binary())], names=[*kinds, "context"])

    out = met.select("asked", "text").mapInArrow(run, "key long, ctx long, shard long, split boolean, starts long, context binary")
    return out.dropDuplicates(["key", "ctx"])  # repeated rows bring the same context twice


def merged(cuts: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(cuts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def whole_words(data: bytes, lo: int, hi: int) -> int:
    """Words between white space that lie wholly in data[lo:hi]."""
    inside = data[lo:hi]
    n = len(inside.split())
    if n and lo and not data[lo - 1 : lo].isspace() and not inside[:1].isspace():
        n -= 1
    if n and hi < len(data) and not data[hi : hi + 1].isspace() and not inside[-1:].isspace():
        n -= 1
    return n


def kept_bytes(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for c in cuts for x in c), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """row (docs' columns as one, so that none of their names clashes) and cuts, a list of (level, lo, hi), null where nothing repeats."""
    listed = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("cuts"))
    own = docs.select(F.struct("*").alias("row")).withColumn("__own", F.xxhash64("row.text"))
    return own.join(listed, same_text(F.col("row.doc_id").cast("long"), own["__own"], listed["__id"], listed["__hash"]), "left").select("row", "cuts")


def report(docs: DataFrame, length: int = 400, passage: int = 200, words: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row by strings of `length` bytes; n_passages and passage_bytes by passages.

    A passage is a stretch covered by strings of `passage` bytes (less than `length`) that also start anywhere else, of over `words` whole words.
    """
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def make():
        def f(ids: list, texts: list, cuts: list) -> Iterable[tuple]:
            for i, t, c in zip(ids, texts, cuts, strict=True):
                data = t.encode("utf-8", "surrogatepass")
                near, found = (merged((x["lo"], x["hi"]) for x in c or () if x["level"] == k) for k in (0, 1))
                near = [(a, b) for a, b in near if not words or whole_words(data, a, b) > words]
                sizes = [sum(b - a for a, b in x) for x in (found, near)]
                yield i, len(data), sizes[0], len(found), hashlib.sha256(kept_bytes(data, found)).hexdigest(), len(near), sizes[1]

        return f

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long"
    return map_rows(with_spans(small, spans(small, (passage, length))).select("row.doc_id", "row.text", "cuts"), make, schema)


def remove_repeated(docs: DataFrame, length: int = 400, words: int = 0) -> DataFrame:
    """docs, all columns, without the stretches covered by strings of `length` bytes that also start anywhere else, where they hold over `words` whole words (0: all of them); n_chars follows where there is one.

    Characters that lose some of their bytes go; texts in which nothing repeats stay as they are, null included.
    """

    def left(t: str, cuts: Iterable) -> str:
        data = t.encode("utf-8", "surrogatepass")
        found = [(a, b) for a, b in merged((x["lo"], x["hi"]) for x in cuts) if not words or whole_words(data, a, b) > words]
        return kept_bytes(data, found).decode("utf-8", "ignore") if found else t

    @F.pandas_udf("string")
    def kept(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or c is None else left(t, c) for t, c in zip(texts, cuts, strict=True)], dtype=object)

    out = with_spans(docs, spans(docs, (length,)))
    row, text = F.col("row"), F.col("row.text")
    row = row.withField("text", F.when(F.col("cuts").isNotNull(), kept(text, F.col("cuts"))).otherwise(text))
    out = out.select(row.alias("row"), "cuts")
    if "n_chars" in docs.columns:
        n = F.when(F.col("cuts").isNotNull(), F.length("row.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        out = out.select(F.col("row").withField("n_chars", n).alias("row"))
    return out.select("row.*")
