"""Helpers shared by the operators: the shared folder, staged tables, packing, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators.shared import BATCH_BYTES, LOCAL_SHARED, drop_staged, new_path, shared_dir, stage, text_batches  # noqa: F401


def held_out(key: str, mod: int) -> F.Column:
    """crc32 of the id as text leaves 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % mod == 2, F.lit(False))


def pack(a: np.ndarray) -> bytes:
    """Byte planes through zstd: small values leave planes of zeros."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else a
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    k = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(k, -1).T).view(dtype).ravel()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, shift, xor)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def spans(batch_col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; nulls have no bytes."""
    col = batch_col.combine_chunks() if isinstance(batch_col, pa.ChunkedArray) else batch_col
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of a bounded list of links."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(before, root):
            break
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def local_forest(batches):
    """mapInArrow: thins links (a, b) batch by batch to one per node that they join."""
    for batch in batches:
        a, b = _forest(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): smallest id reachable over links (a, b) of long ids.

    Alternates large and small stars until nothing changes, which takes O(log^2 n) rounds
    on any graph, long chains included. Minima are partial aggregates and the joins may be
    split by AQE, so a hub does not land in one task. Every round is a staged table.
    """
    edges = stage(links.select("a", "b").where("a <> b").mapInArrow(local_forest, "a long, b long").distinct(), name)
    last = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), name)  # a table, so that AQE may split the join at a hub
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = stage(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))).alias("e"))
            return ends.select("e.node", "e.component").groupBy("node").agg(F.min("component").alias("component"))
        last = now
