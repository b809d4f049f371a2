"""The pipeline's stages on a small table, each against a brute-force version on its own input."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillflow.llm import packing, quality, simhash, suffix

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(31)
    names = {d: ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(300)] for d, letters in (("en", "abcdefgh"), ("de", "mnopqrst"))}
    prose = lambda d, n: ". ".join(" ".join(r.choice(names[d]) for _ in range(12)).capitalize() for _ in range(n // 12)) + "."
    junk = lambda: " ".join("#$%" * r.randint(1, 3) for _ in range(50))
    shared, texts = prose("en", 72), []
    for i in range(120):
        d = "de" if i % 6 == 0 else "en"
        texts.append((i, junk() if i % 5 == 4 else prose(d, r.choice([36, 120, 300])) + (" " + shared + " " + prose(d, 36) if i % 11 == 1 else ""), d))
    texts += [(200 + i, texts[i][1], texts[i][2]) for i in (0, 1, 3, 6)]  # copies
    texts += [(300, texts[2][1].rsplit(" ", 1)[0], "en"), (301, "", "en"), (302, None, None), (None, prose("en", 60), "en"), (303, "word " * 30_000, "en")]
    docs = spark.createDataFrame([(i, t, d, "s", len(t or "")) for i, t, d in texts], COLUMNS).withColumns({"label": F.lit(7), "fp": F.lit("own"), "__n": F.lit(1), "n": F.lit(2)})
    labels = spark.createDataFrame([(i, int(i % 5 != 4), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def key(rows):
    return Counter((x.doc_id, x.text) for x in rows)


def test_stages_equal_brute_force(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "simhash", "suffix", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    def stage(name, docs):
        out = stages[name](spark, docs, folder)
        assert name == "packing" or out.columns == columns
        stored = packing.cut(out)
        return stored, stored.collect()

    given = docs.collect()
    ranker = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    docs, good = stage("quality", docs)
    assert key(good) == key(x for x in given if ranker.score(np.array([quality.features(x.text)]))[0] >= 0.5)
    assert all(x.doc_id is None or x.doc_id > 119 or x.doc_id % 5 != 4 for x in good) and len({x.doc_id for x in good if x.doc_id is not None and x.doc_id < 120}) == 96

    docs, one = stage("simhash", docs)
    prints = [simhash.fingerprint(x.text) for x in good]
    group = list(range(len(good)))
    for _ in good:
        for a in range(len(good)):
            for b in range(len(good)):
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    members = {}
    for x, g in zip(good, group):
        members.setdefault(g, []).append(x)
    assert key(one) == key(min(m, key=lambda x: (x.doc_id is None, x.doc_id or 0)) for m in members.values()) and len(one) < len(good)

    docs, left = stage("suffix", docs)
    windows = Counter(b[k : k + 200] for x in one if (b := (x.text or "").encode()) for k in range(len(b) - 199))
    want = []
    for x in one:
        b = (x.text or "").encode()
        cuts = suffix.merged((k, k + 200) for k in range(len(b) - 199) if windows[b[k : k + 200]] > 1)
        cuts = [(lo, hi) for lo, hi in cuts if suffix.whole_words(b, lo, hi) > 50]
        want.append((x.doc_id, suffix.kept_bytes(b, cuts).decode() if x.text is not None else None))
    assert key(left) == Counter(want) and sum(n for k, n in (key(one) - key(left)).items()) > 3
    assert all(x.n_chars == len(x.text or "") for x in left)

    docs, mixed = stage("mixing", docs)
    assert set(key(mixed)) == set(key(left))  # all stay, some more than once
    tokens = lambda rows, d: sum(len((x.text or "").split()) for x in rows if x.lang == d)
    share = lambda rows: tokens(rows, "de") / (tokens(rows, "de") + tokens(rows, "en"))
    before = share(left)
    aim = before**0.7 / (before**0.7 + (1 - before) ** 0.7)
    assert before < share(mixed) and abs(share(mixed) - aim) < 0.06

    _, pieces = stage("packing", docs)
    whole = packing.Encoder(packing.default_tokenizer()).whole
    sizes = Counter()
    for x in mixed:
        n = len(whole(x.text or "")) + 1
        sizes.update([1024] * (n // 1024) + [n % 1024] * (n % 1024 > 0))
    assert Counter(x.length for x in pieces) == sizes
    rooms = {}
    for x in pieces:
        rooms.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in rooms.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(rooms) == sum(c for _, c in packing.plan(dict(sizes)))


def test_run_puts_the_stages_together(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = packing.cut(stage(spark, docs, folder))
    fixed = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).select(*fixed).collect())) == Counter(map(tuple, docs.select(*fixed).collect()))
