"""Packing documents into fixed-length token sequences.

Documents are cut into pieces of at most `size` tokens (the first takes what full pieces leave over). The
histogram of piece lengths, at most `size` rows, decides everything else: patterns of up to three lengths that
fill a sequence are enumerated, non-negative least squares fits how often to use each so that the histogram is
met, counts are rounded, and what is left over goes best-fit into sequences, longest first, worked out on
counts rather than on documents. Full pieces are sequences of their own; the others find their place by length and rank
within the length. A length's pieces are ranked in groups of about `group` rows, as many as its count asks for, and
counts by group give each its offset, so no length, however frequent, has to meet in one task.

Defined results: a null or empty text is one piece of one token (the end mark). Repeated rows are packed each
on its own.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, map_rows

END = 2
#: Fixed value: the byte-level vocabulary's pre-tokens, but for white space.
CUT = r"'(?:s|t|re|ve|m|ll|d)| ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)"
DOUBLED = re.compile(r"\s\s")
LONG = re.compile(r"\s{1000}")


def byte_characters() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands: printable ones for themselves, those from 256 on for the others."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Token ids of texts by a byte-level tokenizer's file, as little-endian unsigned 32-bit bytes.

    `tokenizers` reads the file and encodes texts that hold a special token's string, and those with very long runs of
    white space, on which the other one's look-ahead fails. For the rest its vocabulary is
    handed to `tiktoken`, which merges by the same ranks several times faster (tests hold both to the same ids).
    The pre-token pattern's look-ahead only matters where white space follows white space; texts without that are
    cut by the pattern without it, which is twice as fast.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        as_byte = byte_characters()
        ranks = {bytes(as_byte[c] for c in t): i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in as_byte for c in t)}
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        for t in self.special:
            ranks.pop(t.encode(), None)
        self.full, self.quick = (tiktoken.Encoding(p, pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (CUT + r"|\s+(?!\S)|\s+", CUT + r"|\s+"))
        self.whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        doubled = DOUBLED.search(text)
        if any(s in text for s in self.special) or (doubled and LONG.search(text)):
            ids = self.whole(text)
        else:
            ids = (self.full if doubled else self.quick)(text)
        return array("I", ids).tobytes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One for each worker process and tokenizer file, kept between tasks."""
    key = path or ""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path or default_tokenizer())
    return _ENCODERS[key]


def cut_pieces(docs: DataFrame, size: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    end = array("I", [END]).tobytes()

    def make():
        encode = encoder(tokenizer).encode

        def f(ids: list, texts: list) -> Iterable[tuple]:
            for i, text in zip(ids, texts, strict=True):
                data = encode(text or "") + end
                n = len(data) // 4
                at = n % size or size
                bounds = [0, *range(at, n + 1, size)] if n > size else [0, n]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    yield i, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])

        return f

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(size: int) -> np.ndarray:
    """Every way to fill a sequence with two or three lengths, longest first; 0 stands for no third."""
    two = np.arange(1, size // 2 + 1)
    rows = [np.stack([size - two, two, np.zeros_like(two)], 1)]
    for c in range(1, size // 3 + 1):
        b = np.arange(c, (size - c) // 2 + 1)
        rows.append(np.stack([size - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate(rows)


def fit_counts(shapes: np.ndarray, histogram: np.ndarray, steps: int = 250) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: how often each pattern, so that lengths come out as in the histogram."""
    size = len(histogram) - 1
    weight = 1 / np.maximum(1.0, np.sqrt(histogram))  # a frequent length may miss by more
    weight[0] = 0  # stands for no third length
    open_ = (histogram[shapes] > 0) | (shapes == 0)
    chosen = np.flatnonzero(open_.all(1))
    x = np.zeros(len(shapes))
    if not len(chosen):
        return x
    columns = [np.ascontiguousarray(shapes[chosen, k]) for k in range(3)]

    def forward(y: np.ndarray) -> np.ndarray:
        return sum(np.bincount(c, y, size + 1) for c in columns)

    def back(r: np.ndarray) -> np.ndarray:
        return r[columns[0]] + r[columns[1]] + r[columns[2]]

    probe = np.random.default_rng(1).random(len(chosen))
    for _ in range(12):  # the largest eigenvalue, for the step
        probe = back(weight**2 * forward(probe))
        top = np.linalg.norm(probe)
        probe /= top
    y = best = np.zeros(len(chosen))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(weight**2 * (forward(y) - histogram)) / (1.05 * top))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, best = new + (old - 1) / t * (new - best), new
    x[chosen] = best
    return x


def plan(histogram: dict[int, int], size: int = 1024) -> list[tuple[tuple[int, ...], int]]:
    """Sequences to make: (lengths in each, longest first; how many), together exactly the histogram.

    The work depends on `size`, not on the counts.
    """
    left = np.zeros(size + 1, np.int64)
    for n, c in histogram.items():
        left[n] += c
    made: dict[tuple[int, ...], int] = defaultdict(int)
    if left[size]:
        made[(size,)] = int(left[size])
        left[size] = 0
    shapes = patterns(size)
    counts = fit_counts(shapes, left.astype(float))
    for k in np.argsort(-counts, kind="stable"):
        if counts[k] < 0.5:
            break
        shape = tuple(int(n) for n in shapes[k] if n)
        need = {n: shape.count(n) for n in shape}
        take = min(int(round(counts[k])), *(int(left[n]) // c for n, c in need.items()))
        if take > 0:
            made[shape] += take
            for n, c in need.items():
                left[n] -= c * take
    # What is left: best fit, longest first, over counts of equal sequences. open_[room] = {lengths: how many}.
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    rooms = np.zeros(size + 1, np.int64)
    for n in range(size - 1, 0, -1):
        todo = int(left[n])
        while todo:
            fits = np.flatnonzero(rooms[n:])
            if not len(fits):
                per = size // n
                full, rest = divmod(todo, per)
                for many, times in ((per, full), (rest, 1)):
                    if many and times:
                        room = size - n * many
                        open_[room][(n,) * many] = open_[room].get((n,) * many, 0) + times
                        rooms[room] += times
                todo = 0
                break
            room = int(fits[0]) + n
            shape, have = next(iter(open_[room].items()))
            take = min(have, todo)
            open_[room][shape] -= take
            if not open_[room][shape]:
                del open_[room][shape]
            rooms[room] -= take
            new = (*shape, n)
            open_[room - n][new] = open_[room - n].get(new, 0) + take
            rooms[room - n] += take
            todo -= take
    for shapes_ in open_.values():
        for shape, c in shapes_.items():
            made[shape] += c
    return sorted(made.items(), reverse=True)


def slots(made: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """length -> (first rank, first sequence, offset), by first rank: where the pieces of a length go. As many entries as plan() has lengths."""
    rank: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for shape, count in made:
        offset = 0
        for n in shape:
            out[n].append((rank[n], sequence, offset))
            rank[n] += count
            offset += n
        sequence += count
    return out


def blocks(found: list[tuple[int, int, int]], total: int) -> tuple[int, list[tuple[int, list[tuple[int, int, int]]]]]:
    """Ranks to a block, and of each block of ranks the slots that reach into it. There are as many blocks as slots."""
    width = -(-total // len(found))
    ends = [x[0] for x in found[1:]] + [total]
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for slot, end in zip(found, ends, strict=True):
        for b in range(slot[0] // width, (end - 1) // width + 1):
            out[b].append(slot)
    return width, list(out.items())


def pack(pieces: DataFrame, size: int = 1024, group: int = 1 << 10, groups: int = 1 << 17) -> DataFrame:
    """pieces with sequence_id and offset. pieces is read several times and its rows are numbered as they stand: hand in stored rows.

    At most groups + size groups are made, larger ones beyond, so what is broadcast (their offsets, and the slots, which
    depend on size) doesn't grow with the pieces.
    """
    spark = pieces.sparkSession
    names = list(pieces.columns)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most size rows
    full = histogram.pop(size, 0)
    made = plan(histogram, size)
    sequences = sum(c for _, c in made)
    whole = pieces.where(F.col("length") == size).select(*names, (F.lit(sequences) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not histogram:
        return whole
    group = max(group, -(-sum(histogram.values()) // groups))
    widths, table = [], []
    for n, found in slots(made).items():
        width, listed = blocks(found, histogram[n])
        widths.append((n, -(-histogram[n] // group), width))
        table += [(n, b, x) for b, x in listed]
    known = spark.createDataFrame(widths, "length long, __groups long, __width long")
    places = spark.createDataFrame(table, "length long, __block long, __slots array<struct<first: long, sequence: long, offset: long>>")
    rows = pieces.where(F.col("length") < size).withColumn("__id", F.monotonically_increasing_id()).join(F.broadcast(known), "length").withColumn("__group", F.pmod(F.xxhash64("__id"), "__groups"))
    counts = cut(rows.groupBy("length", "__group").agg(F.count(F.lit(1)).alias("n")))
    before = W.partitionBy("length").orderBy("__group").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("length", "__group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    own = W.partitionBy("length", "__group").orderBy("__id")
    ranked = rows.withColumn("__rank", F.row_number().over(own) - 1).join(F.broadcast(offsets), ["length", "__group"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before")).withColumn("__block", F.floor(F.col("__rank") / F.col("__width")))
    placed = ranked.join(F.broadcast(places), ["length", "__block"])
    # the last slot whose first rank is not above this one's
    slot = F.element_at(F.filter("__slots", lambda x: x["first"] <= F.col("__rank")), -1)
    placed = placed.withColumn("__slot", slot).withColumns({"sequence_id": F.col("__slot.sequence") + F.col("__rank") - F.col("__slot.first"), "offset": F.col("__slot.offset")})
    out = placed.select(*names, "sequence_id", "offset")
    return out.unionByName(whole) if full else out


def pack_documents(docs: DataFrame, size: int = 1024, tokenizer: str | None = None) -> DataFrame:
    return pack(cut(cut_pieces(docs, size, tokenizer)), size)
