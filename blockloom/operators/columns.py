"""Byte-stream operators over any table with a key and a binary column.

Work on bytes goes through Arrow batches into vectorised code; whatever is per file, block
or symbol is declared with DataFrame functions. Null content counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockloom.functions import codec
from blockloom.functions import expressions as E
from blockloom.operators.shared import text_batches


def spread(df: DataFrame, target: int = 128 << 20) -> DataFrame:
    """Deals out a table that is too small to keep all cores busy by its files alone; a large one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * cores) if size < cores * target else df


def as_files(df: DataFrame, key: str, content: str) -> DataFrame:
    """(file_id, content) of a table whose column holds text or bytes."""
    c = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    return spread(text_batches(df).select(F.col(key).alias("file_id"), c.alias("content")))


def per_file(files: DataFrame, schema: str, make: Callable[[bytes], Iterable[tuple]], batch_rows: int = 4096) -> DataFrame:
    """Rows (file_id, *make(content)) of each file, a bounded batch at a time."""
    kind = files.schema["file_id"].dataType.simpleString()
    full = f"file_id {kind}, {schema}"
    arrow = _arrow(files, full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # contents one at a time
                for row in make(data.as_py() or b""):
                    rows.append((key, *row))
                    if len(rows) >= batch_rows:
                        yield _batch(rows, arrow)
                        rows = []
            if rows:
                yield _batch(rows, arrow)

    return files.select("file_id", "content").mapInArrow(run, full)


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# --- chunks and blocks


def chunks(files: DataFrame, granule: int) -> DataFrame:
    """(file_id, major, byte_off, data): fixed-size reads; map-only. An empty file has none."""
    n = F.ceil(F.octet_length("content") / F.lit(granule)).cast("bigint")
    parts = files.where(F.octet_length("content") > 0).withColumn("major", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return parts.select("file_id", "major", (F.col("major") * granule).alias("byte_off"), F.substring("content", (F.col("major") * granule + 1).cast("int"), F.lit(granule)).alias("data"))


def split(files: DataFrame, limit: int, sequential: bool = True) -> DataFrame:
    """(file_id, block_no, raw_off, raw_len, enc_len): blocks of at most limit bytes after run-length coding."""

    def make(data: bytes):
        if sequential:
            cuts = codec.split_sequential(data, limit)
        else:
            cuts = [(0, 0, a + lo, b + lo) for lo in range(0, len(data), limit) for _, _, a, b in codec.split_sequential(data[lo : lo + limit], limit)]
        for i, (_, _, a, b) in enumerate(cuts):
            yield i, a, b - a, len(codec.rle_encode(data[a:b]))

    return per_file(files, "block_no int, raw_off bigint, raw_len bigint, enc_len bigint", make)


def run_table(files: DataFrame) -> DataFrame:
    """(file_id, run_no, start, byte, len): the maximal runs of equal bytes."""
    kind = files.schema["file_id"].dataType.simpleString()
    full = f"file_id {kind}, run_no bigint, start bigint, byte int, len bigint"

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                start, value, length = codec.runs(batch.column(1)[i].as_py() or b"")
                for lo in range(0, len(start), 100_000):
                    s = slice(lo, lo + 100_000)
                    m = len(start[s])
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * m, batch.column(0).type), pa.array(np.arange(lo, lo + m)), pa.array(start[s]), pa.array(value[s].astype(np.int32)), pa.array(length[s])], names=["file_id", "run_no", "start", "byte", "len"])

    return files.select("file_id", "content").mapInArrow(run, full)


def _coded(length: np.ndarray) -> np.ndarray:
    """Bytes that whole runs take after initial run-length coding, as expressions.rle_length."""
    rest = length % codec.RUN
    return length // codec.RUN * 5 + np.where(rest < 4, rest, 5)


def run_summary(files: DataFrame) -> DataFrame:
    """(file_id, n_bytes, n_runs, longest, n_long, encoded_len): runs of a file; n_long of 4 and more. An empty file has no row."""

    def make(data: bytes):
        length = codec.runs(data)[2]
        if len(length):
            yield len(data), len(length), int(length.max()), int((length >= 4).sum()), int(_coded(length).sum())

    return per_file(files, "n_bytes bigint, n_runs bigint, longest bigint, n_long bigint, encoded_len bigint", make)


def split_estimate(files: DataFrame, limit: int) -> DataFrame:
    """(file_id, block_no, n_runs, n_bytes): blocks estimated from the running sum of whole runs' coded length.

    Sums are made where the bytes are, so that a row leaves per block and none per run.
    """

    def make(data: bytes):
        length = codec.runs(data)[2]
        if len(length):
            coded = _coded(length)
            block = (np.cumsum(coded) - coded) // limit
            first = np.flatnonzero(np.diff(block, prepend=-1))
            n_runs = np.diff(first, append=len(block))
            yield from zip(block[first].tolist(), n_runs.tolist(), np.add.reduceat(length, first).tolist(), strict=True)

    return per_file(files, "block_no bigint, n_runs bigint, n_bytes bigint", make)


def rle(files: DataFrame) -> DataFrame:
    """(file_id, enc, back): initial run-length coding and its inverse."""

    def make(data: bytes):
        enc = codec.rle_encode(data)
        yield enc, codec.rle_decode(enc)

    return per_file(files, "enc binary, back binary", make, 256)


def missing_run_length(files: DataFrame) -> DataFrame:
    """(file_id, missing): whether coded bytes end right after four equal ones."""
    return per_file(files, "missing boolean", lambda data: [(codec.rle_decode(data) is None,)])


# --- bytes


def histogram(files: DataFrame) -> DataFrame:
    """(file_id, byte, n): each file's bytes counted, a vectorised count of 256 bins."""

    def make(data: bytes):
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        for b in np.flatnonzero(counts).tolist():
            yield b, int(counts[b])

    return per_file(files, "byte int, n bigint", make)


def byte_totals(hist: DataFrame) -> DataFrame:
    """(byte, n, before): all files together, with the counts of lower bytes before each. At most 256 rows meet."""
    total = hist.groupBy("byte").agg(F.sum("n").alias("n"))
    return total.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("byte").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def used_map(hist: DataFrame) -> DataFrame:
    """(file_id, byte, rank): dense rank of the bytes that occur."""
    return hist.select("file_id", "byte", (F.dense_rank().over(W.partitionBy("file_id").orderBy("byte")) - 1).alias("rank"))


def used_bitmap(hist: DataFrame) -> DataFrame:
    """(file_id, big, n_used, cost_bits): the 16 bits over the rows of 16 bytes that occur, and what the map takes."""
    rows = hist.groupBy("file_id", F.floor(F.col("byte") / 16).cast("int").alias("row")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), 15 - F.col("byte") % 16)).alias("small"), F.count("*").alias("k"))
    return rows.groupBy("file_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), 15 - F.col("row"))).cast("bigint").alias("big"), F.sum("k").alias("n_used"), (16 + 16 * F.count("*")).alias("cost_bits"))


# --- rotation sort, move to front, symbols


def sorted_rotations(files: DataFrame) -> DataFrame:
    """(file_id, enc, last, idx, back): run-length coded bytes, last column, the text's row, and the inverse."""

    def make(data: bytes):
        enc = codec.rle_encode(data)
        last, index = codec.bwt(enc)
        yield enc, last, index, codec.ibwt(last, index)

    return per_file(files, "enc binary, last binary, idx int, back binary", make, 256)


def ranks(files: DataFrame) -> DataFrame:
    """(file_id, ranks, n_used): move-to-front ranks of the bytes, alphabet ascending."""

    def make(data: bytes):
        used = sorted(set(data))
        yield codec.mtf(data, used), len(used)

    return per_file(files, "ranks array<int>, n_used int", make, 64)


def block_symbols(files: DataFrame) -> DataFrame:
    """(file_id, syms, n_used): the symbols of a file taken as one block, through all stages."""

    def make(data: bytes):
        enc = codec.rle_encode(data)
        used = sorted(set(enc))
        yield codec.symbols(codec.mtf(codec.bwt(enc)[0], used), len(used)), len(used)

    return per_file(files, "syms array<int>, n_used int", make, 64)


def zero_runs(rank_rows: DataFrame) -> DataFrame:
    """(file_id, syms): ranks to symbols with array functions only: a fold over (symbols, zeros pending)."""

    def digits(n):  # bijective base 2, least first, with at most 20 digits
        step = lambda acc, _: F.when(acc["n"] == 0, acc).otherwise(F.struct(F.call_function("shiftrightunsigned", acc["n"] - 1, F.lit(1)).alias("n"), F.concat(acc["d"], F.array(F.when(acc["n"] % 2 == 1, 0).otherwise(1))).alias("d")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.struct(n.cast("int").alias("n"), F.array().cast("array<int>").alias("d")), step, lambda acc: acc["d"])

    return rank_rows.select("file_id", "n_used", F.posexplode("ranks").alias("pos", "rank")).transform(_zero_runs, digits)


def _zero_runs(rows: DataFrame, digits) -> DataFrame:
    w = W.partitionBy("file_id").orderBy("pos")
    marked = rows.withColumn("island", F.sum((F.col("rank") != 0).cast("int")).over(w))
    zeros = marked.where("rank = 0").groupBy("file_id", "n_used", "island").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    syms = zeros.select("file_id", "pos", F.posexplode(digits(F.col("n"))).alias("i", "sym")).union(marked.where("rank > 0").select("file_id", "pos", F.lit(0).alias("i"), (F.col("rank") + 1).alias("sym")))
    return syms.withColumn("no", F.row_number().over(W.partitionBy("file_id").orderBy("pos", "i")) - 1).select("file_id", "no", "sym")


def symbol_frequencies(symbol_rows: DataFrame) -> DataFrame:
    """(file_id, sym, n, place): counts, and places by falling count, then symbol."""
    f = symbol_rows.groupBy("file_id", "sym").agg(F.count("*").alias("n"))
    return f.withColumn("place", F.row_number().over(W.partitionBy("file_id").orderBy(F.desc("n"), "sym")) - 1)


# --- prefix codes


def shannon_lengths(freq: DataFrame) -> DataFrame:
    """(file_id, sym, n, len): least length whose share is no more than the symbol's, at least 1."""
    total = F.sum("n").over(W.partitionBy("file_id"))
    fits = F.filter(F.sequence(F.lit(1), F.lit(30)), lambda k: F.call_function("shiftleft", F.col("n"), k) >= F.col("total"))
    return freq.withColumn("total", total).select("file_id", "sym", "n", fits[0].alias("len"))


def canonical_codes(lengths: DataFrame) -> DataFrame:
    """(file_id, sym, len, code): the sum of the shares 2^-len before a symbol, in order of (len, sym)."""
    before = W.partitionBy("file_id").orderBy("len", "sym").rowsBetween(W.unboundedPreceding, -1)
    share = F.coalesce(F.sum(F.call_function("shiftleft", F.lit(1).cast("bigint"), 40 - F.col("len"))).over(before), F.lit(0))
    return lengths.select("file_id", "sym", "len", F.call_function("shiftright", share, 40 - F.col("len")).alias("code"))


def kraft(lengths: DataFrame) -> DataFrame:
    """(file_id, n_codes, kraft, verdict): full, over or incomplete, by the sum of 2^(20 - len)."""
    k = lengths.groupBy("file_id").agg(F.count("*").alias("n_codes"), F.sum(F.call_function("shiftleft", F.lit(1).cast("bigint"), 20 - F.col("len"))).alias("kraft"))
    return k.withColumn("verdict", F.when(F.col("kraft") > 1 << 20, "over").when(F.col("kraft") < 1 << 20, "incomplete").otherwise("full"))


def tree_cost(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("file_id").agg(F.sum(F.col("n") * F.col("len")).alias("cost_bits"))


def best_tree(symbol_rows: DataFrame, trees: DataFrame) -> DataFrame:
    """(file_id, grp, tree, cost): the cheapest tree (least number among equals) for each 50 symbols; trees (tree, sym, len)."""
    groups = symbol_rows.withColumn("grp", F.floor(F.col("no") / 50))
    cost = groups.join(trees, "sym").groupBy("file_id", "grp", "tree").agg(F.sum("len").alias("cost"))
    best = cost.groupBy("file_id", "grp").agg(F.min(F.struct("cost", "tree")).alias("b"))
    return best.select("file_id", "grp", F.col("b.tree").alias("tree"), F.col("b.cost").alias("cost"))


def prefix_code(files: DataFrame) -> DataFrame:
    """(file_id, n_syms, n_trees, n_groups, cost_bits, max_len): the alternating choice of trees for a one-block file."""

    def make(data: bytes):
        if data:
            enc = codec.rle_encode(data)
            used = sorted(set(enc))
            syms = codec.symbols(codec.mtf(codec.bwt(enc)[0], used), len(used))
            trees, select = codec.choose_trees(syms, len(used) + 2)
            cost = sum(trees[t][s] for g, t in enumerate(select) for s in syms[50 * g : 50 * g + 50])
            yield len(syms), len(trees), len(select), cost, max(map(max, trees))

    return per_file(files, "n_syms int, n_trees int, n_groups int, cost_bits bigint, max_len int", make)
