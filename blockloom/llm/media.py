"""Media columns: signature sniffing with Aho-Corasick, format validators, carving."""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import text_batches

#: Where a format's magic bytes stand, by name.
MAGIC = {
    "wav": (b"RIFF", 0),
    "png": (b"\x89PNG\r\n\x1a\n", 0),
    "jpeg": (b"\xff\xd8\xff", 0),
    "gif": (b"GIF8", 0),
    "bmp": (b"BM", 0),
    "flac": (b"fLaC", 0),
    "pdf": (b"%PDF-", 0),
    "mp4": (b"ftyp", 4),
    "ogg": (b"OggS", 0),
}


@lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for name, (magic, back) in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (name, back, len(magic)))
    a.make_automaton()
    return a


def _wav(b: bytes, i: int) -> int:
    if b[i + 8 : i + 12] != b"WAVE" or len(b) < i + 12:
        return 0
    end = i + 8 + struct.unpack_from("<I", b, i + 4)[0]
    at, seen = i + 12, set()
    while at + 8 <= min(end, len(b)):
        kind, n = b[at : at + 4], struct.unpack_from("<I", b, at + 4)[0]
        seen.add(kind)
        at += 8 + n + n % 2
    return end - i if end <= len(b) and at >= end and {b"fmt ", b"data"} <= seen else 0


def _png(b: bytes, i: int) -> int:
    at = i + 8
    while at + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        if at + 12 + n > len(b) or zlib.crc32(b[at + 4 : at + 8 + n]) != struct.unpack_from(">I", b, at + 8 + n)[0]:
            return 0
        at += 12 + n
        if kind == b"IEND":
            return at - i
    return 0


def _jpeg(b: bytes, i: int) -> int:
    at = i + 2
    while at + 4 <= len(b) and b[at] == 0xFF and (at == i + 2 or b[at + 1] not in (0xD8, 0xD9)):
        marker, n = b[at + 1], struct.unpack_from(">H", b, at + 2)[0]
        if n < 2:
            return 0
        at += 2 + n
        if marker == 0xDA:  # entropy-coded data up to the end marker
            end = b.find(b"\xff\xd9", at)
            return end + 2 - i if end >= 0 else 0
    return 0


def _gif(b: bytes, i: int) -> int:
    if b[i : i + 6] not in (b"GIF87a", b"GIF89a") or len(b) < i + 13:
        return 0
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    at = i + 13 + table(b[i + 10])
    while at < len(b):
        if b[at] == 0x3B:
            return at + 1 - i
        if b[at] == 0x21:
            at += 2
        elif b[at] == 0x2C and at + 10 < len(b):
            at += 11 + table(b[at + 9])
        else:
            return 0
        while at < len(b) and b[at]:
            at += b[at] + 1
        at += 1
    return 0


def _bmp(b: bytes, i: int) -> int:
    if len(b) < i + 30:
        return 0
    n, zero, at, head = struct.unpack_from("<IIII", b, i + 2)
    planes, bits = struct.unpack_from("<HH", b, i + 26)
    ok = zero == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= at <= n <= len(b) - i and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return n if ok else 0


def _mp4(b: bytes, i: int) -> int:
    at = i
    while at + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        if n < 8 or at + n > len(b) or not kind.isalnum():
            break
        at += n
    return at - i if at > i + 8 else 0


def _pdf(b: bytes, i: int) -> int:
    end = b.find(b"%%EOF", i)
    return end + 5 - i if end >= 0 and b[i + 5 : i + 6].isdigit() else 0


def _ogg(b: bytes, i: int) -> int:
    at = i
    while b[at : at + 5] == b"OggS\x00" and at + 27 <= len(b):
        n = b[at + 26]
        end = at + 27 + n + sum(b[at + 27 : at + 27 + n])
        if end > len(b):
            break
        at = end
    return at - i


def _flac(b: bytes, i: int) -> int:
    """The metadata blocks must chain; frames have no length, so the rest belongs to it."""
    at = i + 4
    while at + 4 <= len(b):
        last, n = b[at] & 0x80, int.from_bytes(b[at + 1 : at + 4], "big")
        if (b[at] & 0x7F) > 6 or at + 4 + n > len(b) or (at == i + 4 and (b[at] & 0x7F or n != 34)):
            return 0
        at += 4 + n
        if last:
            return len(b) - i
    return 0


VALID = {"wav": _wav, "png": _png, "jpeg": _jpeg, "gif": _gif, "bmp": _bmp, "mp4": _mp4, "pdf": _pdf, "ogg": _ogg, "flac": _flac}


def carve(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of every valid medium; one inside the span of another type is listed too.

    A start inside an accepted span of its own type is part of that medium (a page of a stream, a picture's thumbnail).
    Where the end of a type is sought and missing, later starts of that type cannot have it either.
    """
    found, until, hopeless = [], {}, set()
    for end, (name, back, n) in _automaton().iter(data.decode("latin-1")):
        start = end + 1 - n - back
        if start < until.get(name, 0) or name in hopeless:
            continue
        if length := VALID[name](data, start):
            found.append((name, start, length))
            until[name] = start + length
        elif name in _END and data.find(_END[name], start) < 0:
            hopeless.add(name)
    return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


#: What a medium of the type must hold behind its start.
_END = {"jpeg": b"\xff\xd9", "pdf": b"%%EOF", "png": b"IEND"}


def to_wav(samples: bytes, rate: int = 8000) -> bytes:
    """8-bit mono samples as a RIFF/WAVE file. Data of odd length get the pad byte."""
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + samples + b"\0" * (n % 2)


def wav_samples(media: bytes) -> bytes:
    """The data chunk of a RIFF/WAVE file, found by walking its chunks."""
    at = 12
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    return b""


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + b"\0" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def sniff(df: DataFrame, media: str = "media", declared: str | None = None) -> DataFrame:
    """Adds sniffed (string), corrected (boolean) and carved (array of type, start, length).

    sniffed is the type of the valid medium at byte 0, else unknown; corrected tells that a
    declared type (or MIME type ending in it) differs from a known sniffed one. carved lists
    every valid medium anywhere. Null media: unknown, not corrected, nothing carved.
    Columns of these names in df are replaced.
    """
    names = [c for c in df.columns if c not in ("sniffed", "corrected", "carved")]
    df = text_batches(df).select(*names)

    def run(batches):
        for batch in batches:
            kinds, fixed, spans_ = [], [], []
            said = batch.column(names.index(declared)).to_pylist() if declared else [None] * batch.num_rows
            for b, was in zip(batch.column(names.index(media)).to_pylist(), said, strict=True):
                spans_.append(found := carve(b or b""))
                kinds.append(next((k for k, s, _ in found if s == 0), "unknown"))
                fixed.append(was is not None and kinds[-1] != "unknown" and was.rsplit("/")[-1].lower() != kinds[-1])
            carved = pa.array([[{"type": t, "start": s, "length": n} for t, s, n in x] for x in spans_], pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), pa.array(fixed, pa.bool_()), carved], names=[*names, "sniffed", "corrected", "carved"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, sniffed string, corrected boolean, carved array<struct<type:string,start:bigint,length:bigint>>")


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): texts as WAV files of their zero-padded UTF-8 bytes."""

    def run(batches):
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([to_wav(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    d = text_batches(docs).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def digest(media: DataFrame) -> DataFrame:
    """Reads media back, from what the sniffer found in them, and digests the payload.

    feature: type, samples, mean and variance of the samples, their zero crossings about
    128 and the number of carved media besides the whole.
    """
    media = sniff(media.withColumn("declared", F.lit("application/octet-stream")), "media", "declared")
    names = media.columns
    i = {n: names.index(n) for n in names}

    def run(batches):
        for batch in batches:
            rows = []
            for key, n, m, kind, fixed, found in zip(*(batch.column(i[c]).to_pylist() for c in ("doc_id", "n_bytes", "media", "sniffed", "corrected", "carved")), strict=True):
                payload = wav_samples(m) if kind == "wav" else b""
                s = np.frombuffer(payload, np.uint8)
                high = s >= 128
                k, total, squares = len(s), int(s.sum(dtype=np.int64)), int((s.astype(np.int64) ** 2).sum())
                mean, variance = (total / k, (k * squares - total * total) / (k * k)) if k else (0.0, 0.0)
                feature = f"{kind}:{k}:{mean:.6f}:{variance:.6f}:{int((high[1:] != high[:-1]).sum())}:{len(found) - 1}"
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature, kind, fixed))
            cols = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [batch.schema.field(i["doc_id"]).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "sniffed", "corrected"])

    return media.mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, sniffed string, corrected boolean")
