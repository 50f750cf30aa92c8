"""Token ids as length-delimited binary records with masked checksums and an offset index.

A file is a run of records in ascending key order:

    u64 length | u32 masked crc32(length bytes) | payload | u32 masked crc32(payload)

all little-endian, the payload being the sequence's ids in units of 2 bytes (or 4 where the
vocabulary needs it). mask(c) = rotate_right(c, 15) + 0xA282EAD8 mod 2^32, so that the
checksum of data that hold checksums stays useful. Beside NAME.rec stands NAME.idx, one
(u64 offset, u64 ids before it in the file) per record and the file's size at the end: any
record can be read alone, in any order.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockloom.llm.common import new_path, spans, stage, text_batches
from blockloom.llm.wordbpe import word_encoder

HEAD = struct.Struct("<QI")
#: Text bytes to a file, about; a file is written by one task in the order of its keys.
FILE_TEXT_BYTES = 24 << 20
SEPARATOR = 1


def mask(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return n + struct.pack("<I", mask(zlib.crc32(n))) + payload + struct.pack("<I", mask(zlib.crc32(payload)))


def unframe(data, at: int) -> tuple[bytes, int]:
    """(payload, offset of the next record); ValueError if lengths or checksums don't hold."""
    if at + 12 > len(data):
        raise ValueError(f"truncated record at {at}")
    n, crc = HEAD.unpack_from(data, at)
    if mask(zlib.crc32(data[at : at + 8])) != crc:
        raise ValueError(f"length checksum mismatch at {at}")
    if at + 16 + n > len(data):
        raise ValueError(f"truncated record at {at}")
    payload = bytes(data[at + 12 : at + 12 + n])
    if mask(zlib.crc32(payload)) != struct.unpack_from("<I", data, at + 12 + n)[0]:
        raise ValueError(f"payload checksum mismatch at {at}")
    return payload, at + 16 + n


def ragged(ids: np.ndarray, counts: np.ndarray, unit: int, separator: int | None) -> pa.Array:
    """A binary column: of all ids in a row, each text's own and the separator after them."""
    kind = np.dtype(f"<u{unit}")
    if separator is not None:
        flat = np.full(len(ids) + len(counts), separator, kind)
        flat[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
        counts = counts + 1
    else:
        flat = ids.astype(kind)
    offsets = np.concatenate([[0], np.cumsum(counts * unit)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", separator: int | None = SEPARATOR, unit: int = 2, files: Files | None = None) -> DataFrame:
    """(doc_id, ids binary, bucket, deal): each text's ids and the separator, in little-endian units of 2 or 4 bytes.

    bucket is the file that the key belongs to, deal a value that Spark's hash partitioning
    sends to the bucket's own partition.
    """
    files = files or Files([], [0])

    def run(batches):
        words = word_encoder(tokenizer)
        for batch in batches:
            ids, counts = words.encode(*spans(batch.column(1)))
            bucket = files.bucket(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), ragged(ids, counts, unit, separator), pa.array(bucket, pa.int32()), pa.array(np.array(files.deals, np.int32)[bucket])], names=["doc_id", "ids", "bucket", "deal"])

    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return text_batches(d).mapInArrow(run, "doc_id long, ids binary, bucket int, deal int")


class Files(NamedTuple):
    """Upper bounds of the keys of all files but the last, and a value per file that hashes to a partition of its own."""

    bounds: list[int]
    deals: list[int]

    def bucket(self, keys: pa.Array) -> np.ndarray:
        """Null keys are in the first file."""
        low = self.bounds[0] if self.bounds else 0
        return np.searchsorted(np.array(self.bounds, np.int64), keys.fill_null(low).to_numpy(zero_copy_only=False)).astype(np.int32)


def plan_files(docs: DataFrame, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_TEXT_BYTES) -> Files:
    """Files of about file_bytes of text each, parted by quantiles of the keys: a few numbers per file."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0]
    n = max(1, -(-(total or 0) // file_bytes))
    found = docs.agg(F.percentile_approx(F.col(key).cast("long"), [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    bounds = sorted(set(found or []))
    n = len(bounds) + 1
    values = spark.range(64 * n + 1024).select(F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("to")).groupBy("to").agg(F.min("id").alias("id"))
    by = {r["to"]: r["id"] for r in values.collect()}
    return Files(bounds, [by.get(i, i) for i in range(n)])


def _write_file(rows: Iterator[tuple], folder: str, bucket: int, unit: int) -> tuple:
    """One file and its index under a name of its own: a retried task leaves a file that no manifest names."""
    files, path = pafs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    name = f"{path}/part-{bucket:06d}-{uuid.uuid4().hex}"
    at = ids = n = 0
    index = bytearray()
    keys = bytearray()
    with files.open_output_stream(f"{name}.rec") as out:
        for key, payload in rows:
            index += struct.pack("<QQ", at, ids)
            keys += struct.pack("<?q", key is not None, key or 0)
            out.write(b := frame(payload))
            at, ids, n = at + len(b), ids + len(payload) // unit, n + 1
    with files.open_output_stream(f"{name}.idx") as out:
        out.write(bytes(index + struct.pack("<QQ", at, ids) + keys))
    return bucket, f"{folder}/{os.path.basename(name)}", n, ids, at


def write(encoded: DataFrame, folder: str, n_files: int, unit: int = 2) -> DataFrame:
    """Writes encode()'s rows as record files in ascending doc_id order (null first, ties by ids).

    Rows stream from the sort into the file, so no task holds one. Returns the manifest
    (bucket, path, n_docs, n_ids, n_bytes, start): one row per file.
    """
    dealt = encoded.repartition(n_files, "deal").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        it = rows()
        row = next(it, None)
        while row is not None:
            now = row[2]

            def same():
                nonlocal row
                while row is not None and row[2] == now:  # noqa: B023
                    yield row[0], row[1]
                    row = next(it, None)

            done = _write_file(same(), folder, now, unit)
            yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "path", "n_docs", "n_ids", "n_bytes"), done, strict=True))], schema=pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    made = stage(dealt.select("doc_id", "ids", "bucket").mapInArrow(run, "bucket int, path string, n_docs long, n_ids long, n_bytes long"), "records-manifest")
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_record(path: str, i: int, unit: int = 2) -> np.ndarray:
    """The i-th record of a file alone, by its index: what a shuffled reader does."""
    files, p = pafs.FileSystem.from_uri(path)
    with files.open_input_file(f"{p}.idx") as f:
        a, _, b, _ = struct.unpack("<QQQQ", f.read_at(32, 16 * i))
    with files.open_input_file(f"{p}.rec") as f:
        return np.frombuffer(unframe(f.read_at(b - a, a), 0)[0], f"<u{unit}")


def read(manifest: DataFrame, unit: int = 2) -> DataFrame:
    """(doc_id, start, ids): every record of the files, checked; ids are little-endian u32."""

    def run(batches):
        for batch in batches:
            for path, n, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                files, p = pafs.FileSystem.from_uri(path)
                with files.open_input_file(f"{p}.idx") as f:
                    raw = f.read()
                index = np.frombuffer(raw, "<u8", 2 * (n + 1)).reshape(-1, 2)
                keys = [k if ok else None for ok, k in struct.iter_unpack("<?q", raw[16 * (n + 1) :])]
                with files.open_input_file(f"{p}.rec") as f:
                    for a in range(0, n, 512):
                        b = min(n, a + 512)
                        lo = int(index[a, 0])
                        data = f.read_at(int(index[b, 0]) - lo, lo)
                        ids = []
                        for at in index[a:b, 0]:
                            payload, _ = unframe(data, int(at) - lo)
                            ids.append(np.frombuffer(payload, f"<u{unit}").astype("<u4").tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(start + index[a:b, 1].astype(np.int64)), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    # One file to a task: a number given by the caller is not coalesced.
    files_ = manifest.select("path", "n_docs", "start").repartition(max(1, manifest.count()))
    return files_.mapInArrow(run, "doc_id long, start long, ids binary")


def encode_and_store(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", folder: str | None = None, separator: int | None = SEPARATOR, unit: int = 2) -> DataFrame:
    """Encodes, writes and returns the manifest; see encode and write.

    Null texts are empty and get only the separator; null keys come first; rows of one key
    are ordered by their ids. An empty table has no file. The folder is a new one below the
    shared folder unless named.
    """
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    files = plan_files(d)
    return write(encode(d, tokenizer, "doc_id", "text", separator, unit, files), folder or new_path(docs.sparkSession, "records"), len(files.deals), unit)
