"""Files as they arrive: a stream of compressed files, decoded or verified batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from blockloom.functions import codec
from blockloom.operators import streams


def arriving(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """(file_id, content) of files as they appear below a path; the number per batch is the backpressure."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("file_id"), "content")


def decompressed(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The parts of arriving files: map-only, so a plain streaming query."""
    return streams.decompress_whole(arriving(spark, path, files_per_batch))


def blocks_of_arrivals(chunks: DataFrame, level: int = 9) -> DataFrame:
    """(file_id, block_no, raw_off, raw_len, data): completely filled blocks of files whose chunks arrive over time.

    Chunks are (file_id string, byte_off bigint, data binary, last boolean), in any order; the last one of a file says so. State of a
    file: bytes of the unfinished block (at most those that fill one), where they start, and chunks ahead of their turn, which the state
    store holds until the gap closes. A chunk that comes twice counts once, and a finished file takes no more.
    """
    limit = level * 100_000
    state = "block_no bigint, raw_off bigint, rest binary, done boolean, offs array<bigint>, parts array<binary>, ends array<boolean>"

    def step(key, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        no, off, rest, done, offs, parts, ends = held.get if held.exists else (0, 0, b"", False, [], [], [])
        ahead = {int(o): (bytes(p), bool(e)) for o, p, e in zip(offs, parts, ends, strict=True)}
        for f in frames:
            for o, p, e in zip(f["byte_off"], f["data"], f["last"], strict=True):
                if p or e:
                    ahead.setdefault(int(o), (bytes(p or b""), bool(e)))
        rows, joined = [], [bytes(rest)]
        at = off + len(joined[0])
        while at in ahead and not done:
            data, done = ahead.pop(at)
            joined.append(data)
            at += len(data)
        data, lo = b"".join(joined), 0
        while lo < len(data):
            to = codec.fill_block(data, lo, limit)
            if to == len(data) and not done:
                break  # the block may go on
            rows.append((key[0], no, off + lo, to - lo, data[lo:to]))
            no, lo = no + 1, to
        ahead = {} if done else {o: x for o, x in sorted(ahead.items()) if o >= at}
        held.update((no, off + lo, data[lo:], done, list(ahead), [p for p, _ in ahead.values()], [e for _, e in ahead.values()]))
        yield pd.DataFrame(rows, columns=["file_id", "block_no", "raw_off", "raw_len", "data"])

    out = "file_id string, block_no bigint, raw_off bigint, raw_len bigint, data binary"
    return chunks.select("file_id", "byte_off", "data", "last").groupBy("file_id").applyInPandasWithState(step, out, state, "append", "NoTimeout")


def drain(df: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Runs a streaming frame over all that is there, into a Parquet table, exactly once, and reads it."""
    query = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.parquet(sink)
