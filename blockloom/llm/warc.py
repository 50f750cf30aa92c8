"""WARC derivatives: response records to linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html as _html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import text_batches

VERSION = b"WARC/1.1"
#: Stands for an unknown fetch time, so that records are the same on every run.
DATE = "1970-01-01T00:00:00Z"
#: Fixed value: the profile of names made from URLs (RFC 4122).
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|section|article|header|footer|nav|aside|main|form|blockquote|pre|title|body|head|html)\b[^>]*>", re.I)
_CELL = re.compile(r"</?(?:td|th|option)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
_TITLE = re.compile(r"<title[^>]*>(.*?)(?:</title|\Z)", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
_CHARSET = re.compile(r"<meta\b[^>]*?\bcharset\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=", re.I)


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def sha1(b: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def _clean(value: str) -> str:
    """One header line: no control characters."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def record(kind: str, rid: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record: version, headers, empty line, block, two line ends."""
    named = [("WARC-Type", kind), ("WARC-Record-ID", rid), *headers, ("WARC-Block-Digest", sha1(block)), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + b"".join(f"{k}: {_clean(v)}\r\n".encode() for k, v in named) + b"\r\n" + block + b"\r\n\r\n"


def members(data: bytes) -> bytes:
    """The plain records of a file of gzip members, one after the other; other bytes as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at = [], 0
    while data[at : at + 2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        while not d.eof:
            piece = data[at : at + (1 << 16)]
            if not piece:
                raise ValueError(f"cut-off member at {at}")
            try:
                out.append(d.decompress(piece))
            except zlib.error as e:
                raise ValueError(f"bad member at {at}: {e}") from None
            at += len(piece) - len(d.unused_data)
    if at < len(data):
        raise ValueError(f"no member at {at}")
    return b"".join(out)


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record; ValueError where one is malformed or its digest fails.

    A digest by another function than SHA-1 is not checked.
    """
    out, at = [], 0
    data = members(data)
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = headers.get("content-length", "")
        n = int(length) if length.isascii() and length.isdigit() and len(length) < 19 else -1
        block = data[end + 4 : end + 4 + n] if n >= 0 else b""
        if n < 0 or len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"bad length at {at}")
        said = headers.get("warc-block-digest", "")
        if said.lower().startswith("sha1:") and said[5:].upper() != sha1(block)[5:]:
            raise ValueError(f"bad digest at {at}")
        out.append((headers, block))
        at = end + 8 + n
    return out


def _unchunked(body: bytes) -> bytes:
    """A chunked body put together; as it is where its sizes don't hold."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return body
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            return body
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def page_of(fields: dict[str, str], payload: bytes) -> str:
    """The page of an HTTP payload: transfer and content codings undone, decoded by its charset (its own, the page's, UTF-8)."""
    if "chunked" in fields.get("transfer-encoding", "").lower():
        payload = _unchunked(payload)
    coding = fields.get("content-encoding", "").lower()
    if coding in ("gzip", "x-gzip", "deflate"):
        for window in (47, -15):
            try:
                payload = zlib.decompressobj(window).decompress(payload)
                break
            except zlib.error:
                continue
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", fields.get("content-type", ""), re.I) or _CHARSET.search(payload[:4096].decode("latin-1"))
    try:
        return payload.decode(m.group(1) if m else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def response(key: str, url: str, body: str, date: str = DATE) -> bytes:
    """A response record that holds an HTTP message with the page."""
    payload = body.encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    rid = record_id("response", key, url, hashlib.sha1(payload).hexdigest())
    return record("response", rid, [("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", sha1(payload)), ("Content-Type", "application/http; msgtype=response")], http + payload)


def plain_text(page: str) -> str:
    """All visible text: a line per block, white space inside made one space; table cells and list options stand apart."""
    page = _TAG.sub("", _CELL.sub(" ", _BREAK.sub("\n", _DROP.sub(" ", page))))
    lines = (" ".join(x.split()) for x in _html.unescape(page).replace("\r", "\n").split("\n"))
    return "\n".join(x for x in lines if x)


def derive(data: bytes) -> bytes:
    """For each response among the records: a metadata and a conversion record that refer to it.

    Both carry the response's id in WARC-Refers-To, its target and its date; the conversion
    also the digest of the payload it was made from. The HTTP headers and what the page says
    about itself are fields of the metadata record. Other records are left out. ValueError
    where a record is malformed or a response has no id.
    """
    out = []
    for headers, block in parse(data):
        if headers.get("warc-type") != "response":
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        rid, uri = headers.get("warc-record-id", ""), headers.get("warc-target-uri", "")
        if not rid:
            raise ValueError("response without an id")
        common = [("WARC-Refers-To", rid), ("WARC-Target-URI", uri), ("WARC-Date", headers.get("warc-date", DATE))]
        source = [(k, v) for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])]
        source = [(k.strip(), v.strip()) for k, v in source]
        page = page_of({k.strip().lower(): v for k, v in source}, payload)
        found = [("title", _TITLE), ("language", _LANG), ("charset", _CHARSET)]
        fields = [(f"http-{k.lower()}", v) for k, v in source] + [("payload-digest", sha1(payload))]
        fields += [(name, " ".join(_html.unescape(m.group(1)).split())) for name, rx in found if (m := rx.search(page))]
        fields.append(("outlinks", str(len(_LINK.findall(page)))))
        text = plain_text(page).encode()
        conversion = record_id("conversion", rid)
        out.append(record("metadata", record_id("metadata", rid), [*common, ("WARC-Concurrent-To", conversion), ("Content-Type", "application/warc-fields")], b"".join(f"{k}: {_clean(v)}\r\n".encode() for k, v in fields)))
        out.append(record("conversion", conversion, [*common, ("WARC-Source-Payload-Digest", sha1(payload)), ("Content-Type", "text/plain; charset=utf-8")], text))
    return b"".join(out)


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, warc): a response record of each page. Null html is an empty body, a null URL an empty target."""

    def run(batches):
        for batch in batches:
            out = [response(str(k), u or "", h or "") for k, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["page_id", "url", "warc"])

    d = text_batches(pages).select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return d.mapInArrow(run, f"page_id {d.schema['page_id'].dataType.simpleString()}, url string, warc binary")


def derivatives(warcs: DataFrame, warc: str = "warc", name: str = "derived", error: str = "error") -> DataFrame:
    """Adds the derived records of each row's response records, and why there are none: null where they could be read.

    Null gives none. Bytes that are not whole records give null and their error; no row stops the job.
    Columns of these names are replaced. Records may be gzip members, bodies chunked, compressed or in any charset.
    """
    keep = [c for c in warcs.columns if c not in (name, error)]
    d = warcs.select(*keep)
    i = keep.index(warc)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)

    def run(batches):
        for batch in batches:
            out, why = [], []
            for x in batch.column(i).to_pylist():
                try:
                    out.append(derive(x or b""))
                    why.append(None)
                except ValueError as e:
                    out.append(None)
                    why.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()), pa.array(why, pa.string())], names=[*keep, name, error])

    return d.mapInArrow(run, f"{schema}, `{name}` binary, `{error}` string")


_DIGEST = [("page_id", None), ("url", pa.string()), ("response_id", pa.string()), ("metadata_id", pa.string()), ("conversion_id", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("text_digest", pa.string()), ("text_chars", pa.int64()), ("outlinks", pa.int64()), ("title", pa.string()), ("language", pa.string()), ("warc_bytes", pa.int64()), ("warc_crc32", pa.int64()), ("linked", pa.bool_())]


def digest(derived: DataFrame) -> DataFrame:
    """Reads response and derived records back and gives a row of their ids, links and digests per page."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, url, warc, made in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ((r, _),) = parse(warc)
                (m, fields), (c, text) = parse(made)
                f = dict(x.split(": ", 1) for x in fields.decode().split("\r\n") if ": " in x)
                linked = m["warc-refers-to"] == c["warc-refers-to"] == r["warc-record-id"] and m["warc-concurrent-to"] == c["warc-record-id"] and c["warc-source-payload-digest"] == r["warc-payload-digest"] == f["payload-digest"]
                rows.append((key, url, r["warc-record-id"], m["warc-record-id"], c["warc-record-id"], c["warc-refers-to"], r["warc-payload-digest"], c["warc-block-digest"], len(text.decode()), int(f["outlinks"]), f.get("title"), f.get("language"), len(made), zlib.crc32(made), linked))
            columns = list(zip(*rows, strict=True)) or [()] * len(_DIGEST)
            yield pa.RecordBatch.from_arrays([pa.array(x, t or batch.schema.field(0).type) for x, (_, t) in zip(columns, _DIGEST, strict=True)], names=[n for n, _ in _DIGEST])

    kinds = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", None: derived.schema["page_id"].dataType.simpleString()}
    return derived.select("page_id", "url", "warc", "derived").mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in _DIGEST))
