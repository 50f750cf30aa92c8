"""Files of any size as rows of chunks: no value and no task's memory grows with a file.

Chunks are (file_id, chunk, data) of a fixed size; a stream's also hold the first BEHIND bytes of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockloom.functions import bits, codec
from blockloom.functions import expressions as E
from blockloom.operators import streams as S
from blockloom.operators.columns import per_file
from blockloom.operators.shared import stage, text_batches

#: Bytes of a stream's chunk, and of the next one that it holds too: a magic, a checksum and a header.
CHUNK, BEHIND = 1 << 18, 16


def joined(rows: DataFrame, file: str, order: str, text: str, size: int) -> DataFrame:
    """Chunks of files that are the texts of rows in order with a line feed between; equal places by text, null ones last."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    w = W.partitionBy("file_id").orderBy(F.col(order).asc_nulls_last(), "data")
    before = F.sum(F.octet_length("data").cast("bigint") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)) - 1
    at = text_batches(rows).select(F.col(file).alias("file_id"), order, data.alias("data")).withColumn("before", before)
    piece = F.when(F.col("before").isNull(), F.col("data")).otherwise(F.concat(F.lit(b"\n"), "data"))
    return chunked(at.select("file_id", F.coalesce("before", F.lit(0)).alias("off"), piece.alias("data")), size)


def chunked(pieces: DataFrame, size: int, behind: int = 0) -> DataFrame:
    """Chunks of files whose bytes are pieces (file_id, off, data), in any order and without gaps."""
    n, off, c = F.octet_length("data"), F.col("off"), F.col("chunk")
    first = F.greatest(F.floor((off - behind) / size), F.lit(0))
    each = pieces.withColumn("chunk", F.explode(F.sequence(first, F.greatest(F.floor((off + n - 1) / size), first))))
    lo, hi = F.greatest(c * size - off, F.lit(0)), F.least((c + 1) * size + behind - off, n.cast("bigint"))
    cut = each.select("file_id", "chunk", (off + lo).alias("off"), F.substring("data", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("data"))
    return _together(cut.where((F.octet_length("data") > 0) | (F.col("off") == 0)), ["file_id", "chunk"], "off", "data")


def _together(pieces: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    return pieces.groupBy(*keys).agg(F.expr(f"listagg(data) WITHIN GROUP (ORDER BY {order})").alias(name))


def encode(chunks: DataFrame, level: int) -> DataFrame:
    """(file_id, major, minor, bits, n_bits, crc) of chunks of level * 100000 bytes; an empty file has a row of no bits and no crc."""

    def make(data: bytes):
        coded = [x[3:] for _, _, a, b in codec.split_parallel(data, level) for x in codec.encode_chunk(data[a:b])]
        yield from ((i, *x) for i, x in enumerate(coded or [(b"", 0, None)]))

    out = per_file(chunks.select(F.struct("file_id", "chunk").alias("file_id"), F.col("data").alias("content")), "minor int, bits binary, n_bits bigint, crc bigint", make, 8)
    return out.select("file_id.file_id", F.col("file_id.chunk").alias("major"), "minor", "bits", "n_bits", "crc")


def stream(blocks: DataFrame, level: int) -> DataFrame:
    """Chunks of the streams of encode()'s blocks, at any alignment, each written where its bits fall.

    A block's last byte is filled with the first bits of the magic behind it, which are known, so blocks never meet.
    """
    w = W.partitionBy("file_id")
    o = w.orderBy("major", "minor")
    at = F.coalesce(F.sum("n_bits").over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 32
    placed = blocks.withColumns({"at": at, "place": F.row_number().over(o) - 1, "n": F.count("*").over(w)})
    placed = placed.withColumn("all", F.coalesce(E.combined_crc(F.col("crc"), F.col("place"), F.col("n")).over(w), F.lit(0)))
    header = int.from_bytes(b"BZh%d" % level, "big")

    def make(k, data: bytes):
        at, n = k["at"], k["n_bits"]
        value = int.from_bytes(data, "big") >> (8 * len(data) - n)
        if not k["place"]:
            value, at, n = header << n | value, 0, n + 32
        if k["place"] == k["n"] - 1:
            value, n, magic = value << 80 | bits.END_MAGIC << 32 | k["all"], n + 80, 0
        else:
            magic = bits.BLOCK_MAGIC
        pad, skip = -(at + n) % 8, -at % 8
        value, n = value << pad | magic >> (48 - pad), n + pad - skip
        yield (at + 7) // 8, (value & ((1 << n) - 1)).to_bytes(n // 8, "big")

    key = F.struct("file_id", "at", "place", "n", "n_bits", "all").alias("key")
    out = S._keyed(placed.select(key, F.col("bits").alias("content")), "off bigint, data binary", make)
    return chunked(out.select("key.file_id", "off", "data"), CHUNK, BEHIND)


def plan(chunks: DataFrame) -> DataFrame:
    """As streams.plan_blocks, of a stream's chunks."""

    def find(data: bytes):
        level = data[3] - 48 if data[:3] == b"BZh" and b"1" <= data[3:4] <= b"9" else 0
        yield -1, False, min(len(data), CHUNK), level
        yield from ((m.bit_off, m.is_end, m.stored, m.next_level) for m in codec.marks(data, CHUNK))

    found = per_file(chunks.select(F.struct("file_id", "chunk").alias("file_id"), F.col("data").alias("content")), "bit_off bigint, is_end boolean, stored bigint, next_level int", find)
    at = F.when(F.col("bit_off") >= 0, F.col("bit_off") + F.col("file_id.chunk") * (8 * CHUNK)).otherwise(-1 - F.col("file_id.chunk"))
    found = found.select("file_id.file_id", at.alias("bit_off"), "is_end", "stored", "next_level")

    def walk(table):
        t = table.sort_by("bit_off").to_pylist()
        sizes = [r for r in t if r["bit_off"] < 0]  # of the chunks, the first one last
        found = [codec.Mark(r["bit_off"], r["is_end"], r["stored"], r["next_level"]) for r in t[len(sizes) :]]
        return S._plan_table(table, sizes[-1]["next_level"], found, 8 * sum(r["stored"] for r in sizes))

    return found.groupBy("file_id").applyInArrow(walk, S._plan_schema(chunks))


def _cut_blocks(chunks: DataFrame, planned: DataFrame) -> DataFrame:
    """(key, content) of the planned blocks, as streams._cut_blocks."""
    key = F.struct("file_id", "block_no", "bit_off", "stop", "level", "stream_no", "no").alias("key")
    first, last = F.floor(F.col("bit_off") / 8), F.ceil(F.col("stop") / 8)
    spans = planned.where("block_no >= 0").select("file_id", key, first.alias("first"), last.alias("last"), F.explode(F.sequence(F.floor(first / CHUNK), F.floor((last - 1) / CHUNK))).alias("chunk"))
    base = F.col("chunk") * CHUNK
    lo, hi = F.greatest(F.col("first") - base, F.lit(0)), F.least(F.col("last") - base, F.lit(CHUNK))
    cut = spans.join(chunks, ["file_id", "chunk"]).select("key", "chunk", F.substring("data", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("data"))
    return _together(cut, ["key"], "chunk", "content")


def _whole(chunks: DataFrame, bad: DataFrame) -> DataFrame:
    """Files whose chain does not hold, as one value each, 2 GB at most, to be read from their start."""
    some = chunks.join(bad.select("file_id"), "file_id", "left_semi")
    return _together(some.select("file_id", "chunk", F.substring("data", 1, CHUNK).alias("data")), ["file_id"], "chunk", "content")


def _settled(chunks: DataFrame, planned: DataFrame, each: DataFrame, again) -> DataFrame:
    """Rows `each` of the files that are sound; again() of the others read whole. Both have a status."""
    per = stage(each.join(planned.groupBy("file_id").agg(F.max("n_streams").alias("n_streams"), F.min(F.coalesce("block_no", F.lit(0))).alias("least")), "file_id", "right"), "large-files")
    fine = (F.col("least") >= 0) & (F.coalesce("status", F.lit(0)) == 0)
    bad = per.where(~fine)
    good = per.where(fine).drop("least")
    return good.unionByName(again(_whole(chunks, bad))) if bad.head(1) else good


def verify(chunks: DataFrame) -> DataFrame:
    """(file_id, n_streams, n_blocks, plain_bytes, status) of streams in chunks, block by block. They are staged, as they are read twice."""
    chunks = stage(chunks, "large-chunks")
    planned = stage(plan(chunks), "large-plan")

    def one(key, data: bytes):
        b = S._decode_planned(key, data)
        yield len(b.data), b.status

    each = S._keyed(_cut_blocks(chunks, planned), "plain bigint, status int", one).groupBy("key.file_id").agg(F.count("*").cast("int").alias("n_blocks"), F.sum("plain").alias("plain_bytes"), F.max("status").alias("status"))
    out = _settled(chunks, planned, each, lambda whole: S.verify(whole, False).drop("name", "message"))
    return out.select("file_id", "n_streams", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_blocks", "plain_bytes", "status")))


def digests(chunks: DataFrame) -> DataFrame:
    """(file_id, plain_bytes, digest, status) of what streams in chunks decode to, block by block; md5 runs over the parts in order."""
    chunks = stage(chunks, "large-chunks")
    planned = stage(plan(chunks), "large-plan")

    def make(key, data: bytes):
        b = S._decode_planned(key, data)
        for i, lo in enumerate(range(0, max(1, len(b.data)), S.PART)):
            yield key["block_no"] * S.PARTS + i, b.data[lo : lo + S.PART] if not b.status else None, b.status

    parts = S._keyed(_cut_blocks(chunks, planned), "part int, data binary, status int", make).select("key.file_id", "part", "data", "status")
    empty = planned.where("block_no is null").select("file_id", F.lit(0).alias("part"), F.lit(b"").alias("data"), F.lit(0).alias("status"))
    out = _settled(chunks, planned, digest_parts(parts.union(empty)), lambda whole: digest_parts(S.decompress_whole(whole)).withColumn("n_streams", F.lit(None).cast("int")))
    return out.drop("n_streams")


def digest_parts(parts: DataFrame) -> DataFrame:
    """(file_id, plain_bytes, digest, status): parts of a file pass through one task in order, one at a time."""
    kind = parts.schema["file_id"].dataType.simpleString()

    def run(batches):
        import hashlib

        import pyarrow as pa

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key], batch.column(0).type), pa.array([n], pa.int64()), pa.array([md5.hexdigest()]), pa.array([status], pa.int32())], names=["file_id", "plain_bytes", "digest", "status"])

        md5 = None
        for batch in batches:
            for i in range(batch.num_rows):
                now = batch.column(0)[i].as_py()
                if md5 is None or now != key:
                    if md5 is not None:
                        yield row()
                    key, n, md5, status = now, 0, hashlib.md5(usedforsecurity=False), 0
                data = batch.column(2)[i].as_py() or b""
                md5.update(data)
                n, status = n + len(data), max(status, batch.column(3)[i].as_py())
        if md5 is not None:
            yield row()

    ordered = parts.select("file_id", "part", "data", "status").repartition("file_id").sortWithinPartitions("file_id", "part")
    return ordered.mapInArrow(run, f"file_id {kind}, plain_bytes bigint, digest string, status int")
