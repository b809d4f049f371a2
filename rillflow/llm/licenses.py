"""License scan: exact set-similarity join of text blocks against license templates.

A block is a run of words, whatever lines it stands on, of at most SPAN times the template's words; its tokens are the
distinct words of the run. A block matches a template when it holds at least `threshold` of the template's distinct
tokens (containment). The join is exact and never compares all pairs: tokens are ordered by how many lines of the whole
corpus hold them, rarest first (counted by Spark); a text can only match if it holds one of the first len - need + 1
tokens of a template (prefix filter), has at least `need` tokens (length filter), and after the first shared token at
position p at most len - p tokens can still be shared (positional filter). In texts that share enough, the window of
words is moved over the places of the template's tokens and what it holds is counted as they enter and leave.

Base places are exact: positions where a phrase's words stand consecutively.

Defined results: a null text counts as empty and gives 0 words, no places, empty labels and score 0.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Base phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wordings by label.
TEMPLATES = {
    "agpl": "licensed under the gnu affero general public license",
    "apache-2.0": "licensed under the apache license version 2.0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-4.0": "licensed under cc by 4.0",
    "cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "cc-by-nc-sa": "licensed under cc by nc sa 4.0",
    "cc-by-sa": "licensed under cc by sa 4.0",
    "cc0": "released to the public domain under cc0 1.0",
    "gpl-2.0": "this work is licensed under the gnu general public license version 2",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "lgpl": "licensed under the gnu lesser general public license",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "all-rights-reserved": "all rights reserved",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: A notice may have other words among its own (names, dates): its run is at most so many times as long as the template.
SPAN = 2
#: Word characters are digits, letters and everything beyond ASCII; the rest separates. Upper case A-Z becomes lower.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else 32 for b in range(256))


def plain(text: str | None) -> bytes:
    """Lower-cased words between spaces; line ends stay."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS)


class Templates:
    """Templates as token sets with an index of their prefixes in a given token order."""

    def __init__(self, templates: dict[str, str], threshold: float, order: dict[bytes, int] | None = None):
        self.sets = {k: frozenset(plain(v).split()) for k, v in templates.items()}
        self.sets = {k: v for k, v in self.sets.items() if v}
        self.width = {k: SPAN * len(plain(templates[k]).split()) for k in self.sets}
        self.vocabulary = frozenset().union(*self.sets.values())
        self.need = {k: max(1, math.ceil(threshold * len(v) - 1e-9)) for k, v in self.sets.items()}
        rank = {t: (order.get(t, 0) if order else 0, t) for t in self.vocabulary}
        self.ordered = {k: sorted(v, key=rank.__getitem__) for k, v in self.sets.items()}
        self.prefix: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        for k, tokens in self.ordered.items():
            for p, t in enumerate(tokens[: len(tokens) - self.need[k] + 1]):
                self.prefix[t].append((k, p))
        self.heads = frozenset(self.prefix)

    def matches(self, tokens: set[bytes]) -> list[tuple[str, float]]:
        """Templates of which the block holds enough, each with its containment."""
        first: dict[str, int] = {}
        for t in tokens & self.heads:
            for k, p in self.prefix[t]:
                first[k] = min(p, first.get(k, p))
        found = []
        for k, p in first.items():
            size, need = len(self.sets[k]), self.need[k]
            if len(tokens) >= need and size - p >= need and (shared := len(self.sets[k] & tokens)) >= need:
                found.append((k, shared / size))
        return sorted(found)


    def runs(self, words: list[bytes]) -> list[tuple[int, str, float]]:
        """Matching runs that don't overlap, for each template: place of the first word, template, largest containment of any run of the text."""
        known = self.matches(set(words))
        if not known:
            return []
        wanted = frozenset().union(*(self.sets[k] for k, _ in known))
        met = [(i, w) for i, w in enumerate(words) if w in wanted]
        found = []
        for k, _ in known:
            hits = [h for h in met if h[1] in self.sets[k]]
            starts, most = blocks_of(hits, self.width[k], self.need[k])
            found += [(at, k, most / len(self.sets[k])) for at in starts]
        return sorted(found)


def blocks_of(hits: list[tuple[int, bytes]], width: int, need: int) -> tuple[list[int], int]:
    """hits: place and token, in order. The starts of windows of `width` words with `need` distinct tokens, the next one after the last's end, and the most tokens of any window."""
    count: dict[bytes, int] = defaultdict(int)
    left = held = most = 0
    free = -1  # windows for starts begin after this hit
    starts: list[int] = []
    inside: dict[bytes, int] = {}  # the last hit of each token since the last start's end
    for n, (at, token) in enumerate(hits):
        held += not count[token]
        count[token] += 1
        while at - hits[left][0] >= width:
            count[hits[left][1]] -= 1
            held -= not count[hits[left][1]]
            left += 1
        most = max(most, held)
        if starts and n <= free:
            continue
        inside[token] = n
        if held >= need and sum(at - hits[m][0] < width for m in inside.values()) >= need:
            first = min(m for m in inside.values() if at - hits[m][0] < width)
            starts.append(hits[first][0])
            # the rest of the same notice belongs to it: hits up to the window's end that bring tokens it lacked
            has, free = {hits[m][1] for m in inside.values() if m >= first}, n
            while free + 1 < len(hits) and hits[free + 1][0] - hits[first][0] < width and hits[free + 1][1] not in has:
                free += 1
                has.add(hits[free][1])
            inside = {}
    return starts, most


def token_order(docs: DataFrame, templates: dict[str, str]) -> dict[bytes, int]:
    """How many lines of all documents hold each template token; as many rows as the templates have tokens."""

    def make():
        vocabulary = Templates(templates, 1).vocabulary

        def f(texts: list) -> Iterable[tuple]:
            counts: dict[bytes, int] = defaultdict(int)
            for text in texts:
                data = plain(text)
                if vocabulary.isdisjoint(data.split()):
                    continue
                for line in data.split(b"\n"):
                    for t in vocabulary.intersection(line.split()):
                        counts[t] += 1
            return ((t.decode(), n) for t, n in counts.items())

        return f

    rows = map_rows(docs.select("text"), make, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"].encode(): r["n"] for r in rows}


def places(words: bytes, phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """(start, label) of every place in single-spaced words where a phrase stands."""
    text, found = b" " + words + b" ", []
    for phrase, label in phrases.items():
        at = text.find(b" " + phrase + b" ")
        while at >= 0:
            found.append((text.count(b" ", 0, at), label))
            at = text.find(b" " + phrase + b" ", at + 1)
    return found


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """One row for each of docs: word and place counts, base labels, all labels, best containment, and the matching blocks.

    blocks lists "line:template" of every matching block, by the line of its first word; score is 1 where a base phrase stands, else the best containment.
    """
    templates = templates or TEMPLATES
    order = token_order(docs, templates)

    def make():
        known = Templates(templates, threshold, order)
        phrases = {k.encode(): v for k, v in PHRASES.items()}
        heads = [k for k in phrases]

        def f(ids: list, texts: list) -> Iterable[tuple]:
            for i, text in zip(ids, texts, strict=True):
                data = plain(text)
                words = data.split()
                base: list[tuple[int, str]] = []
                joined = b" ".join(words)
                if any(k in joined for k in heads):
                    base = places(joined, phrases)
                labels, blocks, best = {x for _, x in base}, [], 1.0 if base else 0.0
                if not known.heads.isdisjoint(words):
                    runs = known.runs(words)
                    ends = list(accumulate(len(line.split()) for line in data.split(b"\n"))) if runs else []
                    for at, k, share in runs:
                        labels.add(k)
                        blocks.append(f"{bisect_right(ends, at)}:{k}")
                        best = max(best, share)
                starts = [s for s, _ in base]
                yield (
                    i, len(words), len(base), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), best, blocks,
                )

        return f

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<string>"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)
