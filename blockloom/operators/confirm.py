"""Relational side of block discovery: speculative candidates against the parsed chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockloom.functions import expressions as E
from blockloom.schema import CODE, error_codes

AT = ["file_id", "bit_off"]


def confirmed(parsed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Parsed blocks whose speculative work can be used."""
    return parsed.join(candidates, AT, "inner")


def rejected(parsed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that the chain does not pass: false positives."""
    return candidates.join(parsed.select(*AT), AT, "left_anti")


def missing(parsed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Parsed blocks that no scan found, to be decoded from their known start."""
    return parsed.join(candidates.select(*AT), AT, "left_anti")


def reordered(headers: DataFrame, decoded: DataFrame) -> DataFrame:
    """Decoded parts of confirmed blocks in output order, numbered within a file."""
    both = headers.select(*AT).join(decoded, AT)
    return both.withColumn("out_no", F.row_number().over(W.partitionBy("file_id").orderBy("bit_off", "part")) - 1)


def chained(spans: DataFrame) -> DataFrame:
    """(file_id, bit_off, end_bit, follows): whether a span begins where the one before it ends."""
    return spans.withColumn("follows", F.coalesce(F.col("bit_off") == F.lag("end_bit").over(W.partitionBy("file_id").orderBy("bit_off")), F.lit(False)))


def reachable(spans: DataFrame) -> DataFrame:
    """(file_id, bit_off, end_bit, step): spans reached from each file's first one by end = start, over any number of steps.

    A task walks the spans of a file, 16 bytes each, so the number of steps costs no rounds of joins. Of spans
    that start at one bit the one of least end is taken; a span that ends where it starts ends the walk.
    """

    def walk(table):
        import pyarrow as pa

        starts, ends = table["bit_off"].to_pylist(), table["end_bit"].to_pylist()
        to: dict[int, int] = {}
        for a, b in zip(starts, ends, strict=True):
            if a is not None and b is not None:
                to[a] = min(b, to.get(a, b))
        at, out = min(to, default=None), []
        while at in to:
            out.append((at, to[at], len(out)))
            at = to[at] if to[at] > at else None
        return pa.table({"file_id": table["file_id"].combine_chunks().take(pa.array([0] * len(out), pa.int32())), "bit_off": pa.array([x[0] for x in out], pa.int64()), "end_bit": pa.array([x[1] for x in out], pa.int64()), "step": pa.array([x[2] for x in out], pa.int32())})

    kind = spans.schema["file_id"].dataType.simpleString()
    narrow = spans.select("file_id", F.col("bit_off").cast("long").alias("bit_off"), F.col("end_bit").cast("long").alias("end_bit"))
    return narrow.groupBy("file_id").applyInArrow(walk, f"file_id {kind}, bit_off bigint, end_bit bigint, step int")


def with_messages(statuses: DataFrame, code: str = "status") -> DataFrame:
    """Adds name and message of each status from the error dimension of a few rows."""
    return statuses.join(F.broadcast(error_codes(statuses.sparkSession)), F.col(code) == F.col("code"), "left").drop("code")


def block_status(decoded: DataFrame) -> DataFrame:
    """Adds final: overflow overrides any status, a checksum mismatch counts only where all else is well."""
    over = F.col("blk_sz") > F.col("level") * 100_000
    return decoded.withColumn("final", F.when(over, CODE["ERR_OVERFLOW"]).when(F.col("status") != 0, F.col("status")).when(F.col("crc") != F.col("stored_crc"), CODE["ERR_BLKCRC"]).otherwise(0))


def stream_crcs(blocks: DataFrame, keys: list[str], order: str, crc: str = "crc") -> DataFrame:
    """(keys, n_blocks, stream_crc): the combined CRC, a partial aggregate after numbering."""
    w = W.partitionBy(*keys)
    placed = blocks.withColumns({"_place": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    return placed.groupBy(*keys).agg(F.count("*").alias("n_blocks"), E.combined_crc(F.col(crc), F.col("_place"), F.col("_n")).alias("stream_crc"))


def progress(parts: DataFrame, keys: list[str], order: str, size: str) -> DataFrame:
    """Adds done and percent: the running share of a file's bytes."""
    w = W.partitionBy(*keys)
    total = F.sum(size).over(w)
    done = F.sum(size).over(w.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return parts.withColumns({"done": done, "percent": F.when(total > 0, 100 * done / total)})


def offset_weights(blocks: DataFrame, keys: list[str], order: str, end: str) -> DataFrame:
    """Adds weight: how far a block's end moves the input beyond all before it."""
    before = F.max(end).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return blocks.withColumn("weight", F.greatest(F.col(end) - F.coalesce(before, F.lit(0)), F.lit(0)))


def first_by_priority(tasks: DataFrame, keys: list[str], priority: str, position: str) -> DataFrame:
    """The task to run next of each group: least priority, then earliest position. A partial aggregate, no sort."""
    rest = [c for c in tasks.columns if c not in (*keys, priority, position)]
    best = tasks.groupBy(*keys).agg(F.min(F.struct(priority, position, *rest)).alias("t"))
    return best.select(*keys, *(F.col(f"t.{c}").alias(c) for c in (priority, position, *rest)))
