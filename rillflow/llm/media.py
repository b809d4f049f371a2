"""Media columns: find, check and carve media by their signatures.

An Aho-Corasick automaton finds magic bytes anywhere in a value. A validator for each format then walks the
structure from there and confirms it together with its length, so a chance hit in text is rejected.

Defined results: null bytes count as empty, an empty value has no type ("application/octet-stream" is
returned) and no parts; a declared type that is null counts as not matching. Texts of any length are stored whole; equal
texts give equal values.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

UNKNOWN = "application/octet-stream"
#: Magic bytes, the offset at which they stand in their format, and the type.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"WAVEfmt ", 8, "audio/wav"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"%PDF-", 0, "application/pdf"),
    (b"fLaC", 0, "audio/flac"),
    (b"BM", 0, "image/bmp"),
]


def _wav(d: bytes, at: int) -> tuple[int, int, int] | None:
    """End of the file and the range of its samples."""
    if d[at : at + 4] != b"RIFF" or len(d) < at + 12:
        return None
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    if end > len(d):
        return None
    p, known = at + 12, False
    while p + 8 <= end:
        kind, n = d[p : p + 4], struct.unpack_from("<I", d, p + 4)[0]
        if p + 8 + n > end:
            return None
        known = known or (kind == b"fmt " and n >= 16)
        if kind == b"data":
            return (end, p + 8, p + 8 + n) if known else None
        p += 8 + n + (n & 1)
    return None


def _png(d: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(d):
        n = int.from_bytes(d[p : p + 4], "big")
        kind, end = d[p + 4 : p + 8], p + 12 + n
        if end > len(d) or (kind == b"IHDR") != first:
            return None
        if zlib.crc32(d[p + 4 : end - 4]) != int.from_bytes(d[end - 4 : end], "big"):
            return None
        if kind == b"IEND":
            return end
        p, first = end, False
    return None


def _gif(d: bytes, at: int) -> int | None:
    def blocks(p: int) -> int:
        while p < len(d) and d[p]:
            p += 1 + d[p]
        return p + 1

    if len(d) < at + 13:
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    p = at + 13 + table(d[at + 10])
    while p < len(d):
        if d[p] == 0x3B:
            return p + 1
        if d[p] == 0x21:
            p = blocks(p + 2)
        elif d[p] == 0x2C and p + 10 < len(d):
            p = blocks(p + 11 + table(d[p + 9]))
        else:
            return None
    return None


def _jpeg(d: bytes, at: int) -> int | None:
    p = at + 2
    while p + 4 <= len(d) and d[p] == 0xFF:
        if d[p + 1] == 0xDA:
            end = d.find(b"\xff\xd9", p)
            return end + 2 if end >= 0 else None
        n = int.from_bytes(d[p + 2 : p + 4], "big")
        if n < 2:
            return None
        p += 2 + n
    return None


def _gzip(d: bytes, at: int) -> int | None:
    z, p = zlib.decompressobj(31), at
    try:
        while p < len(d) and not z.eof:
            piece = d[p : p + (1 << 14)]  # a chance hit ends in the first piece or soon after
            p += len(piece)
            while piece and not z.eof:
                z.decompress(piece, 1 << 20)
                piece = z.unconsumed_tail
    except zlib.error:
        return None
    return p - len(z.unused_data) if z.eof else None


def _zip(d: bytes, at: int) -> int | None:
    end = d.find(b"PK\x05\x06", at)
    while end >= 0 and end + 22 <= len(d):
        n, start, note = struct.unpack_from("<IIH", d, end + 12)
        if at + start + n == end and end + 22 + note <= len(d):
            return end + 22 + note
        end = d.find(b"PK\x05\x06", end + 4)
    return None


def _pdf(d: bytes, at: int) -> int | None:
    """To the last end mark that follows a cross-reference's place, before the next PDF starts: updates are appended with end marks of their own."""
    stop = d.find(b"%PDF-", at + 5)
    stop, found, end = len(d) if stop < 0 else stop, None, at
    while (end := d.find(b"%%EOF", end, stop)) >= 0:
        mark = d.rfind(b"startxref", at, end)
        if mark >= 0 and d[mark + 9 : end].strip().isdigit():
            found = end + 5
        end += 5
    return found


def _flac_header(d: bytes, p: int) -> tuple[int, int] | None:
    """A frame's block size and the end of its header, which has a check sum of 8 bits."""
    if p + 6 > len(d) or d[p] != 0xFF or d[p + 1] & 0xFE != 0xF8 or d[p + 2] >> 4 == 0 or d[p + 2] & 15 == 15 or d[p + 3] >> 4 > 10 or d[p + 3] & 1:
        return None
    lead = d[p + 4]
    more = 0 if lead < 0x80 else next((n for n in range(1, 7) if lead >> (6 - n) == (1 << (n + 1)) - 2), -1)
    if more < 0 or (lead >= 0x80 and lead < 0xC0):
        return None
    q, size = p + 5 + more, d[p + 2] >> 4
    block = 192 if size == 1 else 144 << size if size < 6 else 1 << size
    if size in (6, 7):
        block = int.from_bytes(d[q : q + size - 5], "big") + 1
        q += size - 5
    q += {12: 1, 13: 2, 14: 2}.get(d[p + 2] & 15, 0)
    return (block, q + 1) if q < len(d) and crc(d[p:q], 8, 0x07) == d[q] else None


def crc_table(bits: int, polynomial: int) -> list[int]:
    out = []
    for b in range(256):
        x = b << (bits - 8)
        for _ in range(8):
            x = (x << 1 ^ polynomial if x >> (bits - 1) else x << 1) & ((1 << bits) - 1)
        out.append(x)
    return out


_TABLES: dict[int, list[int]] = {}


def crc(data: bytes, bits: int, polynomial: int, x: int = 0) -> int:
    """Check sum of so many bits, highest first, from 0."""
    if bits not in _TABLES:
        _TABLES[bits] = crc_table(bits, polynomial)
    table, mask = _TABLES[bits], (1 << bits) - 1
    for b in data:
        x = (x << 8 & mask) ^ table[(x >> (bits - 8)) ^ b]
    return x


def _flac(d: bytes, at: int) -> int | None:
    """To the end of the last frame: frames follow each other, each ends with a check sum of 16 bits, and together they hold the samples that the file states."""
    p, first, total = at + 4, True, 0
    while True:
        if p + 4 > len(d):
            return None
        kind, n = d[p] & 0x7F, int.from_bytes(d[p + 1 : p + 4], "big")
        if first and (kind, n) != (0, 34) or kind == 127 or p + 4 + n > len(d):
            return None
        if first:
            total = int.from_bytes(d[p + 17 : p + 22], "big") & ((1 << 36) - 1)
        last, p, first = d[p] & 0x80, p + 4 + n, False
        if last:
            break
    done, end = 0, None
    while (header := _flac_header(d, p)) and not (total and done >= total):
        done, sum_, q = done + header[0], crc(d[p : header[1]], 16, 0x8005), header[1]
        while q + 2 <= len(d):
            after = q + 2
            # the end is where the check sum fits and another frame starts, or no more samples are due
            if sum_ == d[q] << 8 | d[q + 1] and ((total and done >= total) or _flac_header(d, after) or (not total and after == len(d))):
                end = p = after
                break
            sum_, q = crc(d[q : q + 1], 16, 0x8005, sum_), q + 1
        else:
            break
    return end if end and (not total or done >= total) else None


def _bmp(d: bytes, at: int) -> int | None:
    if len(d) < at + 30:
        return None
    size, kept, start, header = struct.unpack_from("<IIII", d, at + 2)
    planes, bits = struct.unpack_from("<HH", d, at + 26)
    fine = kept == 0 and header in (12, 40, 52, 56, 108, 124) and start >= 14 + header and size >= start and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return at + size if fine and at + size <= len(d) else None


END = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "application/gzip": _gzip, "application/zip": _zip,
    "application/pdf": _pdf, "audio/flac": _flac, "image/bmp": _bmp, "audio/wav": lambda d, at: (x := _wav(d, at)) and x[0],
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, offset, kind in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic), offset, kind))
    found.make_automaton()
    return found


def sniff(data: bytes, find: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Confirmed media as (start, length, type), by start; those inside another one come after it."""
    found = []
    for last, (n, offset, kind) in find.iter(data.decode("latin-1")):
        start = last + 1 - n - offset
        if start >= 0 and (end := END[kind](data, start)):
            found.append((start, end - start, kind))
    return sorted(found, key=lambda x: (x[0], -x[1]))


def sniff_media(df: DataFrame, data: str = "data", declared: str | None = None) -> DataFrame:
    """Add media_type (that of media starting at byte 0), type_is_right and parts (start, length, type, bytes) carved from inside.

    Other columns stay, whatever their names; a column of one of those three names is replaced.
    """

    @F.pandas_udf("kind string, parts array<struct<start:long,length:long,type:string,bytes:binary>>")
    def carve(values: pd.Series) -> pd.DataFrame:
        find, rows = automaton(), []
        for value in values:
            d = b"" if value is None else bytes(value)
            found = sniff(d, find)
            own = next((x for x in found if x[0] == 0), None)
            rows.append((own[2] if own else UNKNOWN, [{"start": s, "length": n, "type": k, "bytes": d[s : s + n]} for s, n, k in found if (s, n, k) != own]))
        return pd.DataFrame(rows, columns=["kind", "parts"])

    said = F.col(declared) if declared else F.lit(None).cast("string")
    own = {"media_type": F.col("carved.kind"), "parts": F.col("carved.parts"), "type_is_right": F.coalesce(F.col("said") == F.col("carved.kind"), F.lit(False))}
    rows = df.select(F.struct("*").alias("row"), carve(F.col(data)).alias("carved"), said.alias("said"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in df.columns if c not in own), *(v.alias(k) for k, v in own.items()))


def as_wav(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as one channel of 8-bit samples."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload


def text_to_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text (null: empty) as UTF-8, zero-padded to a positive multiple of 64 and stored as an 8-bit WAV: key, n_bytes, media."""

    def make():
        def f(keys: list, texts: list) -> Iterable[tuple]:
            for k, t in zip(keys, texts, strict=True):
                d = (t or "").encode()
                yield k, len(d), as_wav(d + bytes(-len(d) % 64 or (0 if d else 64)))

        return f

    return map_rows(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text)), make, "doc_id long, n_bytes long, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """Find the samples in each stored value by its structure and describe them."""

    def make():
        find = automaton()

        def f(keys: list, sizes: list, values: list) -> Iterable[tuple]:
            for k, n, d in zip(keys, sizes, values, strict=True):
                found = sniff(d, find)
                own = next(x for x in found if x[0] == 0 and x[2] == "audio/wav")
                _, start, end = _wav(d, 0)
                payload = d[start:end]
                samples = np.frombuffer(payload, np.uint8)
                mean = float(samples.mean())
                power = math.sqrt(float(np.square(samples, dtype=np.uint16).sum(dtype=np.int64)) / len(samples))
                feature = f"{own[2]};samples={len(samples)};mean={mean:.6f};rms={power:.6f};embedded={len(found) - 1}"
                yield k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(d), hashlib.sha256(d).hexdigest(), feature

        return f

    return map_rows(media, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
