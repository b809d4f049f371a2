"""The training-data operators on small fixtures: brute force, round trips, and rows that ask for trouble."""

import hashlib
import random
import re
import zlib
from html import unescape

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rillflow.llm import html, licenses, media, mixing, neighbours, packing, quality, simhash, suffix, toxicity

ODD = [
    (1, "", "en"), (2, None, "en"), (None, "a word here", None), (3, "a b c d e f g " * 400, "en"), (3, "a b c d e f g " * 400, "en"), (4, "x", "de"),
    (5, "Licensed under CC BY-NC 4.0.\nÜber alles. All rights reserved", "de"), (6, "z" * 5000, "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return docs.withColumns({"label": F.lit(9), "score": F.lit("own"), "fp": F.lit(1), "rank": F.lit(2), "n": F.lit(3)})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def test_media_round_trip(odd, empty):
    rows = media.read_back(media.text_to_media(odd)).collect()
    assert len(rows) == len(ODD) and media.read_back(media.text_to_media(empty)).count() == 0
    want = sorted((len(t := (x or "").encode()), hashlib.sha256(t + bytes(-len(t) % 64 or (0 if t else 64))).hexdigest()) for _, x, _ in ODD)
    assert sorted((r.n_bytes, r.payload_sha256) for r in rows) == want


def test_media_carving(spark):
    gz = zlib.compressobj(wbits=31)
    packed = gz.compress(b"inside") + gz.flush()
    wav = media.as_wav(packed + b"BM GIF89a")
    found = media.sniff(b"text" + wav + b"PK\x03\x04", media.automaton())
    assert [(s, k) for s, _, k in found] == [(4, "audio/wav"), (48, "application/gzip")]
    df = spark.createDataFrame([(bytearray(wav), "image/png"), (None, None)], "data binary, declared string")
    rows = media.sniff_media(df, declared="declared").orderBy("declared").collect()
    assert rows[0].media_type == media.UNKNOWN and rows[1].media_type == "audio/wav" and not rows[1].type_is_right
    assert bytes(rows[1].parts[0]["bytes"]) == packed


def flac_frame(number, samples):
    head = bytes([0xFF, 0xF8, 0x69, 0x08, number, samples - 1])
    body = head + bytes([media.crc(head, 8, 7)]) + b"\x00\x55" * 5
    return body + media.crc(body, 16, 0x8005).to_bytes(2, "big")


def test_media_ends():
    assert media.crc(b"123456789", 8, 7) == 0xF4 and media.crc(b"123456789", 16, 0x8005) == 0xFEE8
    info = bytes([0, 16, 0, 16]) + bytes(6) + (44100 << 44 | 15 << 36 | 40).to_bytes(8, "big") + bytes(16)
    flac = b"fLaC\x80\x00\x00\x22" + info + flac_frame(0, 20) + flac_frame(1, 20)
    pdf = b"%PDF-1.4 a startxref\n12\n%%EOF\nmore startxref 99 %%EOF"
    gz = zlib.compressobj(wbits=31)
    packed = gz.compress(b"inside" * 100_000) + gz.flush()
    find = media.automaton()
    for data, kind in ((flac, "audio/flac"), (pdf, "application/pdf"), (packed, "application/gzip")):
        assert (2, len(data), kind) in media.sniff(b"xx" + data + b" what follows" * 2000, find)
    assert media.sniff(flac[:-30], find) == [] and media.sniff(b"%PDF-1 %%EOF", find) == [] and media.sniff(b"\x1f\x8b\x08 x" * 50_000, find) == []


def test_html(spark):
    page = "<html><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div><article><h1>T &amp; U</h1><p>One\n two<br>three<p>Four<aside>side</aside><script>x</script></article><div id=comments>bad</div><footer>f</footer>"
    assert html.main_text(page) == "T & U\nOne two three\nFour"
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x") == ""
    assert html.main_text("<![x <p>plain text") != ""
    rows = html.extract_text(spark.createDataFrame([(1, "u", page), (None, None, None)], "page_id long, url string, html string")).collect()
    assert sorted(r.n_chars for r in rows) == [0, 24]


def test_html_end_tags_left_out():
    assert html.main_text("<html><head><title>x</title><body><p>text") == "text"
    assert html.main_text("<title>x</title><meta charset=utf-8><p>text") == "text"
    pick = "<p>before<select><option>one<option selected>two<optgroup label=g><option>three</select> it<datalist><option>four</datalist><p>after"
    assert html.main_text(pick) == "before it\nafter"


@pytest.mark.parametrize("part", ["<ul>{}</ul>", "<table>{}</table>", "{}"])
def test_html_keeps_short_lines_without_article(part):
    long, short = "many words that make up a long paragraph of text " * 6, "".join(f"<li><b>i{k}</b>" for k in range(9))
    page = f"<body><nav><a>menu</a></nav><div><h1>T</h1><p>s{part.format(short)}<p>{long}{part.format(short)}<p>{long}{part.format(short)}</div><div class=sidebar>bad</div>"
    items = [f"i{k}" for k in range(9)]
    first = ["T", "s", *items]
    assert html.main_text(page).split("\n") == [*first, long.strip(), *items, long.strip(), *items]
    quote = f"<div><p>said<blockquote><p>{long}</blockquote><p>end</div>"
    assert html.main_text(quote) == f"said\n{long.strip()}\nend"


def test_html_clusters_choose_the_region():
    long = "many words that make up a long paragraph of text " * 6
    links = "".join(f"<li><a href=/{k}><b>go</b> <i>{k}</i></a>" for k in range(30))
    teasers = f"<article><ul>{links}</ul></article>"
    # an article of links loses to a division of text, and one of text is taken beside it
    assert html.main_text(f"<body>{teasers}<div><p>{long}<p>{long}</div>") == f"{long.strip()}\n{long.strip()}"
    assert html.main_text(f"<body>{teasers}<article><p>{long}</article>") == long.strip()
    # without any element or class that says so, the text goes before the menu
    assert html.main_text(f"<body><div><ul>{links}</ul></div><div><p>{long}<p>{long}</div>") == f"{long.strip()}\n{long.strip()}"
    # two articles of text; long text that stands outside, but isn't most of the page, settles nothing
    assert html.main_text(f"<body><p>{long}<article><p>a{long}</article><article><p>b{long}</article>") == f"a{long.strip()}\nb{long.strip()}"
    # text of several divisions without an article
    assert html.main_text(f"<body><nav><ul>{links}</ul></nav><div><p>a{long}</div><div><p>b{long}</div>") == f"a{long.strip()}\nb{long.strip()}"


def test_html_headers_and_equal_pages(spark):
    page = "<body><header><h2>Site</h2></header><article><header class=post-header><h1>Title</h1><p>by someone</header><p>Text of it.</article>"
    assert html.main_text(page) == "Title\nText of it."
    rows = spark.createDataFrame([(1, "u", page, 5), (1, "u", page, 5), (2, None, None, 5)], "page_id long, url string, html string, text int")
    got = [tuple(x) for x in html.extract_text(rows).collect()]
    assert sorted(got, key=str) == [(1, "u", "Title\nText of it.", 17), (1, "u", "Title\nText of it.", 17), (2, None, "", 0)]
    assert html.extract_text(rows.where("false")).count() == 0
    assert len(html.main_text("<article>" + "<p>x y" * 200_000)) == 4 * 200_000 - 1


def test_html_pages_equal_brute_force(spark):
    """The given pages are all made alike: whatever their one article holds, read with regular expressions."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {(r.page_id, r.text) for r in html.extract_text(pages).collect()}
    want = set()
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:h1|p|ul|li|div)>", inside.replace("<br>", " ")))
        want.add((r.page_id, "\n".join(t for b in blocks if (t := re.sub(r"\s+", " ", unescape(b)).strip()))))
    assert got == want and len(got) == 50


def test_licenses(odd, empty):
    rows = {(r.doc_id, r.n_words): r for r in licenses.scan_licenses(odd).collect()}
    r = rows[(5, 12)] if (5, 12) in rows else next(v for k, v in rows.items() if k[0] == 5)
    assert r.base_labels == "cc-by,reserved" and "cc-by-nc-4.0" in r.labels and r.score == 1.0 and r.n_base == 2
    assert rows[(2, 0)].labels == "" and rows[(2, 0)].first_word is None and licenses.scan_licenses(empty).count() == 0


def test_license_places_equal_brute_force(spark):
    r = random.Random(14)
    parts = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x", "é", "Ccé"]
    texts = ["".join(r.choice(parts) + r.choice([" ", "\n", "-", ", ", "_"]) for _ in range(r.randint(0, 40))) for _ in range(300)]
    want = {}
    for i, t in enumerate(texts):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode()))
        met = [(k, label) for k in range(len(words)) for phrase, label in licenses.PHRASES.items() if words[k : k + len(phrase.split())] == phrase.encode().split()]
        want[i] = (len(words), len(met), min((k for k, _ in met), default=None), max((k for k, _ in met), default=None), ",".join(sorted({x for _, x in met})))
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {g.doc_id: (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got} == want and sum(w[1] for w in want.values()) > 50


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_license_filters_lose_nothing(threshold):
    r = random.Random(5)
    names = [f"t{k}" for k in range(12)]
    sets = {f"k{i}": " ".join(r.sample(names, r.randint(1, 8))) for i in range(10)}
    known = licenses.Templates(sets, threshold, {n.encode(): r.randint(0, 9) for n in names})
    for _ in range(300):
        block = {n.encode() for n in r.sample(names, r.randint(0, 12))}
        want = sorted(k for k, v in known.sets.items() if len(v & block) / len(v) >= threshold - 1e-12)
        assert [k for k, _ in known.matches(block)] == want


def test_licenses_wrapped_notices_and_long_lines(spark):
    bsd = "# Redistribution and use in source and binary forms,\n# with or without modification,\n# are permitted"
    grant = "x\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy\nof this software"
    spread = " ".join(w + " filler" * 500 for w in licenses.TEMPLATES["mit-grant"].split())
    twice = "Licensed under the Apache\nLicense, Version 2.0\n" * 2
    docs = spark.createDataFrame(list(enumerate([bsd, grant, spread, twice, spread + "\n" + grant])), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.blocks, r.score) for r in licenses.scan_licenses(docs).collect()}
    assert got[0] == ("bsd", ["0:bsd"], 1.0) and got[1] == ("mit-grant", ["2:mit-grant"], 1.0) and got[2] == ("", [], 0.0)
    assert got[3] == ("apache-2.0", ["0:apache-2.0", "2:apache-2.0"], 1.0) and got[4][0] == "mit-grant" and got[4][2] == 1.0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_license_runs_equal_brute_force(threshold):
    r = random.Random(6)
    names = [f"t{k}" for k in range(9)]
    sets = {f"k{i}": " ".join(r.sample(names, r.randint(1, 7))) for i in range(8)}
    known = licenses.Templates(sets, threshold, {n.encode(): r.randint(0, 9) for n in names})
    for _ in range(200):
        words = [r.choice([*names, *["z"] * 12]).encode() for _ in range(r.randint(0, 90))]
        most = {k: max((len(v & set(words[i : i + known.width[k]])) for i in range(len(words))), default=0) for k, v in known.sets.items()}
        got = known.runs(words)
        assert {k: share for _, k, share in got} == {k: n / len(known.sets[k]) for k, n in most.items() if n >= known.need[k]}
        assert all(len(known.sets[k] & set(words[at : at + known.width[k]])) >= known.need[k] for at, k, _ in got)


def test_packing(odd, empty):
    rows = packing.pack_documents(odd, 64).collect()
    encode = packing.Encoder(packing.default_tokenizer()).encode
    total = {i: 0 for i, *_ in ODD}
    for i, t, _ in ODD:
        total[i] += len(encode(t or "")) // 4 + 1
    got: dict = {}
    spans: dict = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.piece == 0 or r.length == 64
    assert got == total and packing.pack_documents(empty, 64).count() == 0
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(spans) <= -(-sum(total.values()) // 64) + 1


def test_encoder_equals_tokenizer():
    e, r = packing.Encoder(packing.default_tokenizer()), random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "a", "Bc", "don't", "12", ",", "***", "é", "漢", "😀", "<|endoftext|>", " x"]
    for _ in range(3000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert list(np.frombuffer(e.encode(s), "<u4")) == e.whole(s)


def test_encoder_takes_long_white_space():
    e = packing.Encoder(packing.default_tokenizer())
    for s in (" " * 3_000_000, "\n" * 1_500_000, "x" + " \t" * 400_000 + "y", "a" * 1_000_000):
        assert list(np.frombuffer(e.encode(s), "<u4")) == e.whole(s)


def test_pack_equals_brute_force(spark):
    """Every piece of each length gets its own place, and together they are the plan's sequences."""
    r = random.Random(12)
    rows = [(r.choice([None, 7, i]), r.randint(0, 2), 0, r.choice([64, 64, 1, 5, 20, 20, 33, 50, 63]), 9) for i in range(3000)]
    pieces = packing.cut(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"))
    counts: dict = {}
    for x in rows:
        counts[x[3]] = counts.get(x[3], 0) + 1
    for group in (10, 1 << 16):
        got = packing.pack(pieces, 64, group).collect()
        assert sorted((x.doc_id, x.piece, x.length) for x in got if x.doc_id) == sorted((x[0], x[1], x[3]) for x in rows if x[0]) and len(got) == len(rows)
        shapes: dict = {}
        for x in got:
            shapes.setdefault(x.sequence_id, []).append((x.offset, x.length))
        made: dict = {}
        for parts in shapes.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
            shape = tuple(n for _, n in parts)
            made[shape] = made.get(shape, 0) + 1
        assert sorted(made.items(), reverse=True) == packing.plan(counts, 64)


def test_pieces_equal_brute_force(spark, odd):
    """start, length and ids_crc32 of every piece against the tokenizer's own ids."""
    whole = packing.Encoder(packing.default_tokenizer()).whole
    want = []
    for i, t, _ in ODD:
        ids = [*whole(t or ""), packing.END]
        first = len(ids) % 64 or 64 if len(ids) > 64 else len(ids)
        bounds = [0, *range(first, len(ids) + 1, 64)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    got = [(x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in packing.pack_documents(odd, 64).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_plan_uses_the_histogram():
    r = random.Random(2)
    counts = {n: r.randint(1, 50) for n in r.sample(range(1, 129), 60)}
    made = packing.plan(counts, 128)
    used: dict = {}
    for shape, c in made:
        assert sum(shape) <= 128 and c > 0
        for n in shape:
            used[n] = used.get(n, 0) + c
    assert used == counts and packing.plan({}, 128) == []


def brute_repeats(rows, length):
    windows: dict = {}
    for _, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            windows[b[k : k + length]] = windows.get(b[k : k + length], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cut = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if windows[b[k : k + length]] > 1:
                cut[k : k + length] = True
        out.append((i, int(cut.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cut])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("near,length,most", [(3, 8, 2048), (3, 8, 2), (8, 20, 2), (20, 21, 2)])
def test_suffix_equals_brute_force(spark, monkeypatch, near, length, most):
    r = random.Random(3)
    texts = ["ab" * 100, "abc" * 30, "", None, "x", "q" * 57, "abcabd" * 9 + "zz", "ab" * 100] + ["".join(r.choice("ab") for _ in range(60)) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "zzzzzzzzyyyyyyabab"), (3, "ababababababa")]
    spans = suffix.spans
    monkeypatch.setattr(suffix, "spans", lambda d, n: spans(d, n, most))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix.report(docs, length, near, 0).collect()
    assert sorted(((g.doc_id, g.n_removed, g.kept_sha256) for g in got), key=str) == brute_repeats(rows, length)
    assert sorted(((g.doc_id, g.passage_bytes) for g in got), key=str) == [x[:2] for x in brute_repeats(rows, near)]
    left = suffix.remove_repeated(docs, near).collect()
    assert sorted(((g.doc_id, hashlib.sha256((g.text or "").encode()).hexdigest()) for g in left), key=str) == sorted(((i, h) for i, _, h in brute_repeats(rows, near)), key=str)


def test_passages_hold_over_so_many_whole_words(spark):
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))
    shared, less = words(51), words(50)
    texts = [f"{words(90)} {shared} {words(80)}", f"{words(70)} {shared}", f"{words(60)} {less} {words(60)}", f"{words(9)} {less} {words(20)}", words(300), f"x{shared}y {words(30)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {g.doc_id: g.n_passages for g in suffix.report(docs).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0}
    left = {x.doc_id: x.text for x in suffix.remove_repeated(docs, 200, 50).collect()}
    assert [i for i, t in enumerate(texts) if left[i] != t] == [0, 1] and not any(shared[3:-3] in left[i] for i in (0, 1))
    assert suffix.whole_words(b"ab cd ef", 1, 7) == 1 and suffix.whole_words(b"ab cd ef", 3, 8) == 2 and suffix.whole_words(b"abc", 1, 2) == 0


def test_suffix_deals_out_common_keys(spark, monkeypatch):
    """Thousands of copies, and a passage that hundreds of texts share, with keys dealt out from two rows on."""
    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))
    copy, shared = words(40), words(12)
    rows = [(i, copy) for i in range(600)] + [(1000 + i, f"{words(3)} {shared} {words(3)}") for i in range(300)] + [(None, copy), (5, copy)]
    join = suffix.join_spread
    monkeypatch.setattr(suffix, "join_spread", lambda *a: join(*a, least=2))
    got = suffix.report(spark.createDataFrame(rows, "doc_id long, text string"), 60, 20, 0).collect()
    assert sorted(((g.doc_id, g.n_removed, g.kept_sha256) for g in got), key=str) == brute_repeats(rows, 60)
    assert sorted(((g.doc_id, g.passage_bytes) for g in got), key=str) == [x[:2] for x in brute_repeats(rows, 20)]


def test_remove_repeated_keeps_columns(odd, empty):
    out = suffix.remove_repeated(odd, 50)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert {r.text for r in out.where("doc_id = 3").collect()} == {""} and out.where("doc_id = 2").first().text is None
    assert suffix.report(empty).count() == 0


def test_fingerprints_equal_brute_force(spark):
    r = random.Random(15)
    texts = ["", None, " \n", "One", "one two", "É é"] + ["".join(r.choice("aBcÉé") + r.choice([" ", "  ", "\n", "\x0b", "", "\xa0"]) for _ in range(r.randint(1, 60))) for _ in range(100)]
    got = {g.doc_id: g.fingerprint for g in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", lower) if w]
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
        assert got[i] == f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"


def test_simhash_deals_out_common_keys(spark, monkeypatch):
    """One fingerprint of very many copies and a large group around it, with keys dealt out from two rows on."""
    join = simhash.join_spread
    monkeypatch.setattr(simhash, "join_spread", lambda *a: join(*a, least=2))
    values = [0, *(1 << k for k in range(40)), *(7 << 60 | 1 << k for k in range(30)), 1 << 63 | 0xFFFF]
    nodes = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    got = {x.node: x.root for x in simhash.components(simhash.links(nodes, 2, 4)).collect()}
    low, high = min(values[:41]), min(simhash.signed(v) for v in values[41:71])
    assert got == {v: low for v in values[:41]} | {simhash.signed(v): high for v in values[41:71]}
    rows = spark.createDataFrame([(i, "same words in each") for i in range(50)] + [(50, "others")], "doc_id long, text string")
    assert sorted((x.doc_id, x.component_id) for x in simhash.near_duplicates(rows).collect()) == [(i, 0) for i in range(50)] + [(50, 50)]


def test_simhash_equals_brute_force(spark, odd, empty):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(40)]
    values = list({simhash.signed(b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 3)))) for b in base for _ in range(8)})
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = {v: find(v) for v in values}
    for tile in (2, 2048):
        got = {v: v for v in values} | {x.node: x.root for x in simhash.components(simhash.links(nodes, 2, tile)).collect()}
        assert got == want
    rows = simhash.near_duplicates(odd).collect()
    assert {x.fingerprint for x in rows if x.doc_id in (1, 2)} == {"0" * 16} and {x.component_id for x in rows if x.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 1 and kept.where("doc_id = 2").count() == 0


def test_quality_and_toxicity(spark, odd, empty):
    r = random.Random(6)
    words = ["the", "rain", "falls", "on", "stone", "and", "grass", "while", "birds", "sing"]
    text = lambda: " ".join(r.choice(words) for _ in range(60)).capitalize() + "."
    rows = [(i, text() if i % 3 else text().replace(" ", "*** ") , int(i % 3 > 0)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    ranker = quality.fit(docs.select("doc_id", "text").where("doc_id < 160"), docs.select("doc_id", "quality"))
    held = quality.score_quality(docs, ranker).join(docs, "doc_id").where("doc_id >= 160")
    assert held.where("predicted = quality").count() / held.count() > 0.95
    assert quality.keep_good(odd, ranker).columns == odd.columns and quality.score_quality(empty, ranker).count() == 0
    rows_, marks = np.array([quality.features(x.text) for x in docs.where("doc_id < 160").orderBy("doc_id").collect()]), np.array([x[2] for x in rows[:160]])
    z = np.clip((rows_ - rows_.mean(0)) / np.maximum(rows_.std(0), 1e-6), -8, 8)
    with_all = lambda w: np.logaddexp(0, -(z[marks == 1][:, None] - z[marks == 0][None]) @ w).mean() + 5e-5 * w @ w  # noqa: E731  every pair
    best = with_all(ranker.weights)
    assert best < with_all(ranker.weights * 0) and all(best < with_all(ranker.weights + 0.5 * e) + 1e-3 for e in np.eye(len(ranker.weights)))
    assert abs(float((ranker.score(rows_) < 0.5).mean()) - (marks == 0).mean()) < 0.02
    none = quality.fit(docs, docs.select("doc_id", "quality").where("false"))
    assert {x.score for x in quality.score_quality(odd, none).collect()} == {0.5}

    bad = [(i, text() + (" You Muckface fool. " if i % 4 == 0 else " ") + text(), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(bad, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.where("doc_id < 300"), docs.select("doc_id", "toxic"))
    held = toxicity.score_toxicity(docs, model).join(docs, "doc_id").where("doc_id >= 300")
    assert held.where("predicted = toxic").count() / held.count() > 0.95
    assert all("Muckface" in x.sentence for x in toxicity.offending_sentences(docs, model).collect())
    known = toxicity.Vocabulary(model.names)
    for x in toxicity.score_toxicity(docs.limit(20), model).collect():  # noisy-or, sentence by sentence
        text, left = bad[x.doc_id][1], 1 - model.leak
        for sentence in re.split("[.!?\n]+", text):
            found = {i for w in re.findall(r"[^\W\d_]+", sentence.lower()) for i in known[w]}
            left *= 1 - 1 / (1 + np.exp(-(model.bias + sum(model.weights[i] for i in found)))) if found else 1
        assert abs(x.score - (1 - left)) < 1e-9
    twice = docs.unionByName(docs.where("doc_id < 5")).withColumn("label", F.lit("other"))
    assert sorted(toxicity.fit(twice.where("doc_id < 300"), docs.select("doc_id", "toxic")).names) == sorted(model.names)  # repeated rows train once
    assert len(toxicity.score_toxicity(odd, model).collect()) == len(ODD) and toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.score_toxicity(odd, toxicity.fit(docs, docs.select("doc_id", "toxic").where("false"))).where("predicted = 1").count() == 0


def test_quality_trains_on_every_labelled_row(spark):
    """More labelled rows than a sample of 20,000 would take, each in the mean and in the threshold; few rows meet in all pairs."""
    n = 21_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('word ', repeat('ab ', int(id % 97)), if(id % 3 = 0, '#### 1234', 'fine.')) AS text")
    ranker = quality.fit(docs, docs.selectExpr("doc_id", "int(doc_id % 3 > 0) AS quality"))
    x = np.array([quality.features(r.text) for r in docs.collect()])
    assert np.allclose(ranker.centre, x.mean(0), rtol=1e-9) and np.allclose(ranker.scale, np.maximum(x.std(0), 1e-6), rtol=1e-6)
    scores = np.clip((x - ranker.centre) / ranker.scale, -8, 8) @ ranker.weights
    assert abs(ranker.threshold - np.quantile(scores, 1 / 3)) < 1e-9
    few = spark.range(7).selectExpr("id * 1.5D AS s").unionByName(spark.range(3).selectExpr("3.0D AS s"))
    assert abs(quality.quantile(few, 10, 0.7) - np.quantile([0, 1.5, 3, 4.5, 6, 7.5, 9, 3, 3, 3], 0.7)) < 1e-12


def test_mixing(spark, odd, empty):
    r = random.Random(7)
    words = {"en": ["the", "of", "and", "rain"], "de": ["der", "und", "die", "regen"]}
    rows = [(i, " ".join(r.choice(words[d]) for _ in range(40)), d) for i in range(300) for d in (["de"] if i % 4 == 0 else ["en"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = mixing.mixture(docs, docs.where("doc_id % 2 = 0"), {"en": 0.5, "de": 0.5}).collect()
    assert all(o.domain == rows[o.doc_id][2] for o in out)
    tokens = {d: sum(o.rate * o.n_tokens for o in out if o.domain == d) for d in ("en", "de")}
    assert abs(tokens["en"] / sum(tokens.values()) - 0.5) < 0.02 and min(o.rate for o in out) >= 0
    more = mixing.mixed(docs, docs, keep_all=True)
    assert more.columns == docs.columns and more.select("doc_id").distinct().count() == 300
    assert mixing.mixture(odd, docs, {"en": 1.0}).count() == len(ODD)
    assert mixing.mixture(empty, docs, {"en": 1.0}).count() == 0 and mixing.mixture(odd, empty, {"en": 1.0}).count() == len(ODD)


@pytest.mark.parametrize("share", [0.01, 0.001])
def test_mixing_meets_targets_of_rare_domains(spark, share):
    known = spark.createDataFrame([([1.0, 0.0], 1e6 * (1 - share)), ([0.0, 1.0], 1e6 * share)], "__p array<double>, __n double")
    pull = 1e-4 * share
    push = mixing.fit_rates(known, [0.8, 0.2], 1e6, pull)
    got = {r["__p"][1]: r["r"] for r in known.select("__p", mixing.rate(push).alias("r")).collect()}
    assert abs(got[1.0] / ((0.2 + pull) / (share + pull)) - 1) < 1e-5 and abs(got[1.0] * share - 0.2) < 1e-4
    assert abs(got[0.0] / ((0.8 + pull) / (1 - share + pull)) - 1) < 1e-5


def test_mixing_tells_rare_domains_apart_by_rare_words(spark):
    r = random.Random(3)
    words = {d: [f"{d}{i}" for i in range(n)] for d, n in (("en", 400), ("de", 60), ("fr", 60))}  # each word in few documents
    kinds = ["de"] * 4 + ["fr"] * 3 + ["en"] * 300
    rows = [(i, " ".join(r.choice(words[d] + ["x", "y"]) for _ in range(40)), d) for i, d in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = mixing.mixture(docs, docs, {"en": 0.4, "de": 0.3, "fr": 0.3}).collect()
    assert [o.doc_id for o in got if o.domain != rows[o.doc_id][2]] == []
    for d, w in (("en", 0.4), ("de", 0.3), ("fr", 0.3)):
        assert abs(sum(o.rate * o.n_tokens for o in got if o.domain == d) / sum(o.n_tokens for o in got) - w) < 0.01
    assert mixing.spread([10, 9000, 3], 1000) == [10, 987, 3]


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_mixing_rates_are_least_squares(spark, least):
    r = np.random.default_rng(5)
    p, n = r.dirichlet([0.3, 0.2, 0.01], 80), r.integers(1, 900, 80).astype(float)
    known = spark.createDataFrame([(x.tolist(), float(k)) for x, k in zip(p, n, strict=True)], "__p array<double>, __n double")
    w, total, pull = np.array([0.1, 0.3, 0.6]), n.sum() * (1.5 if least else 1), 1e-4
    push = mixing.fit_rates(known, w.tolist(), float(total), pull, least)
    rows = known.select("__p", "__n", mixing.rate(push, least).alias("r")).collect()
    p, n, x = (np.array([q[i] for q in rows]) for i in range(3))
    slope = p @ ((n * x) @ p / total - w) + pull * (x - 1)  # zero where the rate is free, at least zero where it is bound
    assert np.abs(slope[x > least]).max() < 1e-5 and slope[x <= least].min(initial=0) > -1e-5


def test_mixing_equals_brute_force(spark):
    """Posteriors word by word, and rates by projected gradient over the cells, in numpy."""
    r = random.Random(8)
    words = {"en": ["the", "of", "and", "rain", "x"], "de": ["der", "und", "die", "regen", "x"], "fr": ["le", "la", "pluie", "x", "et"]}
    rows = []
    for i in range(120):
        d, e = r.choice(["en", "en", "en", "de", "fr"]), r.choice(["en", "de", "fr"])
        rows.append((i, "".join(r.choice(words[d if r.random() < 0.8 else e]) + r.choice([" ", "  ", "\n", "\r", " \t"]) for _ in range(r.randint(0, 9))), d))
    rows += [(500, None, None), (501, "the THE the cat", "en"), (501, "the THE the cat", "en"), (None, "der der", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"w": F.lit(1), "n": F.lit("n"), "label": F.lit(2)})
    labelled = docs.where("doc_id % 3 <> 1")
    got = mixing.mixture(docs, labelled, {"en": 0.2, "de": 0.3, "fr": 0.5}, steps=10).collect()
    names = ["de", "en", "fr"]
    known = {(i, d) for i, _, d in rows if i is not None and i % 3 != 1 and d}
    count = {d: {} for d in names}
    for i, t, _ in rows:
        for j, d in known:
            if i == j:
                for w in (t or "").lower().split():
                    count[d][w] = count[d].get(w, 0) + 1
    vocabulary = {w for c in count.values() for w in c}
    own = {d: {w: count[d].get(w, 0) / max(1, sum(count[d].values())) for w in vocabulary} for d in names}
    share = {d: {w: 0.9 * own[d][w] + 0.1 * sum(own[e][w] for e in names) / 3 for w in vocabulary} for d in names}
    prior = np.array([sum(x == d for _, x in known) / len(known) for d in names])
    want = {}
    for i, t, _ in rows:
        found = (t or "").lower().split()
        z = np.log(prior) + 0.25 * np.array([sum(np.log(share[d][w]) for w in found if w in vocabulary) for d in names])
        p = np.exp(z - z.max())
        want[i] = len(found), p / p.sum()
    assert len(got) == len(rows)
    for g in got:
        n, p = want[g.doc_id]
        assert g.n_tokens == n and np.abs(np.array(g.posterior) - p).max() < 1e-9
    # the rates: nonnegative, equal within a cell, least squares on the exact posteriors
    p, n = np.array([g.posterior for g in got]), np.array([float(g.n_tokens) for g in got])
    _, cell = np.unique(np.floor(p * 10 + 0.5).astype(int), axis=0, return_inverse=True)
    cell = cell.ravel()
    mass, goal = np.stack([np.bincount(cell, n * p[:, d]) for d in range(3)], 1) / n.sum(), np.array([0.3, 0.2, 0.5])
    size, pull = np.bincount(cell, n) / n.sum(), 1e-4 * ((n @ p) / n.sum()).min()
    x = np.ones(len(size))
    for _ in range(200_000):
        x = np.maximum(0, x - 0.4 * (mass @ (x @ mass - goal) + pull * size * (x - 1)) / size.max())
    rates = np.array([g.rate for g in got])
    assert np.abs((rates * n) @ p / n.sum() - goal).max() < 2e-3 and np.abs((x @ mass) - (rates * n) @ p / n.sum()).max() < 2e-3
    assert all(len({round(v, 9) for v in rates[cell == c]}) == 1 for c in set(cell)) and rates.min() >= 0


@pytest.mark.parametrize("n", [0, 5, 256, 257, 1500, 6000])
def test_verified_blocks_equal_brute_force(n):
    r = np.random.default_rng(n)
    x, q, ids = r.standard_normal((n, 9)), r.standard_normal(9), r.permutation(n)
    x[n // 2 :] = x[: n - n // 2]  # every row twice: ties
    near, score = r.random(n), (x * q).sum(1)
    norm = float(np.sqrt((x * x).sum(1).max())) if n else 1.0
    rows = neighbours.verified(x, ids, q, 3, near, np.inf, norm, 20, 1e9)
    want = [i for i in np.lexsort((ids, -score)) if ids[i] != 3][:20]
    assert list(ids[rows]) == list(ids[want])
    few = neighbours.verified(x, ids, q, 3, near, 0.5, norm, 20, 1.0)  # a bound: what is beyond it never counts
    assert (near[few] <= 0.5 + 1e-8).all()


def test_neighbours(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((600, 16))
    x[50:150] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for n in neighbours.nearest(df, 10, cell=64).collect():
        got.setdefault(n.query_id, []).append((n.rank, n.vec_id, n.score))
    assert set(got) == set(range(0, 600, 20))
    hit = 0
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:10]
        hit += len(set(want) & {v for _, v, _ in found})
        assert [k for k, *_ in sorted(found)] == list(range(1, 11)) and all(abs(s[v] - sc) < 1e-12 for _, v, sc in found)
    assert hit >= 0.9 * 10 * len(got) and sorted(got[0])[0][1] == 50
    assert neighbours.nearest(df.where("false")).count() == 0
    assert neighbours.nearest(df.where("vec_id < 3")).count() == 2


def test_neighbours_of_repeated_rows_and_in_branches(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    other = [-9.0] * 6  # smaller in the order of components, so it doesn't count
    df = spark.createDataFrame(rows + rows[:30] + rows[:5] + [(40, other), (41, other)], "vec_id long, embedding array<double>")
    for bytes_ in (1 << 10, 1 << 24):  # many small branches and one
        got: dict = {}
        for n in neighbours.nearest(df, 20, cell=32, unit_bytes=bytes_, confidence=1 - 1e-12).collect():
            got.setdefault(n.query_id, []).append((n.rank, n.vec_id, n.score))
        assert set(got) == set(range(0, 400, 20))
        for q, found in got.items():
            s = (x * x[q]).sum(1)
            want = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
            assert [v for *_, v, _ in sorted(found)] == want
