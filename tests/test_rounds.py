"""Findings of review rounds, each on tables small enough to write down."""

import bz2
import hashlib
import random

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

from blockloom.functions import codec
from blockloom.operators import columns as C
from blockloom.operators import large as L
from blockloom.operators import streams as S
from blockloom.plans import catalog
from blockloom.schema import CODE


def equal(spark, folder, name, **tables):
    """A query's rows and its SQL's, over tables given as pandas frames."""
    c = duckdb.connect()
    for k, df in tables.items():
        df.to_parquet(f"{folder}/{k}.parquet", index=False)
        c.sql(f"CREATE VIEW {k} AS SELECT * FROM read_parquet('{folder}/{k}.parquet')")
    want = c.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, str(folder)).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())) and got


@pytest.mark.parametrize("name", ["block_status", "size_literal"])
def test_casts_round_as_in_sql(spark, tmp_path, name):
    price = [9999.5, 10000.49, 10000.5, 10000.51, 10001.5, 20000.5, 20000.75, 19999.5]
    lines = pd.DataFrame({"l_orderkey": range(8), "l_linenumber": pd.Series([1, 1, 1, 1, 1, 2, 2, 2], dtype="int32"), "l_quantity": [0.5, 1.5, 2.5, 2.51, 3.0, 4.49, 5.5, 6.5], "l_extendedprice": price, "l_partkey": 7, "l_suppkey": 7, "l_returnflag": "N"})
    equal(spark, tmp_path, name, lineitem=lines)


def test_damaged_streams_are_compressed_once(spark):
    plan = catalog.verify_damaged(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 8  # small and large files: compress, assemble, damage, verify; it was five times as many


def test_blocks_before_a_cut_end_are_left_to_the_library(monkeypatch):
    packed = codec.compress(b"some text of a block, " * 40)
    monkeypatch.setattr(codec, "_symbols", lambda *a: 1 / 0)
    for n in (1, 4, 5, 8, 9):
        status, streams = codec.walk(packed[:-n])
        assert status == CODE["ERR_EOF"] and streams[0].blocks[0].data == b"some text of a block, " * 40


def test_symbols_over_several_segments(monkeypatch):
    """Tables of code lengths are made piece by piece; pieces of any size give the same."""
    data = bytes(i * i % 251 for i in range(9000)) + b"z" * 700
    packed = codec.compress(data)
    for size in (1020, 1777, 1 << 18):
        monkeypatch.setattr(codec, "_SEGMENT", size)
        b = codec.decode_block(packed, 32)
        assert (b.status, b.data, b.size) == (0, data, len(codec.rle_encode(data)))


def test_counts_that_are_missing_or_follow_each_other():
    for data, plain in ((b"aaaa", None), (b"aaaa\0aaaa", None), (b"aaaa\0aaaa\1b", b"aaaaaaaaab"), (b"aaaaaaa", b"a" * 103), (b"\n\n\n\n\n", b"\n" * 14)):
        assert codec.rle_decode(data) == plain


def test_sources_are_never_one_value(spark):
    c = catalog._sources(spark, "/root/testdata/sf0.01").selectExpr("max(length(data)) AS most", "max(chunk) AS chunks").first()
    assert c.most <= 100_000 and c.chunks > 0


def test_chunked_streams_equal_the_library(spark, monkeypatch):
    """Streams of several blocks at any alignment, with chunks so small that blocks and magics lie across them."""
    monkeypatch.setattr(L, "CHUNK", 1000)
    r = random.Random(3)
    texts = {"a": ["x" * 3, "", "yz"], "b": [""], "c": ["", "", "q"], "d": [r.randbytes(60).hex() * r.randint(0, 90) for _ in range(60)]}
    rows = [(k, i, t) for k, v in texts.items() for i, t in enumerate(v)]
    r.shuffle(rows)
    chunks = L.joined(spark.createDataFrame(rows, "f string, no int, t string"), "f", "no", "t", 100_000)
    want = {k: "\n".join(v).encode() for k, v in texts.items()}
    packed = L.stream(L.encode(chunks, 1), 1).cache()
    files = {}
    for c in packed.orderBy("file_id", "chunk").collect():
        files[c.file_id] = files.get(c.file_id, b"") + bytes(c.data[:1000])
    assert {k: bz2.decompress(v) for k, v in files.items()} == want and len(files["d"]) > 5000
    assert {x.file_id: (x.plain_bytes, x.digest, x.status) for x in L.digests(packed).collect()} == {k: (len(v), hashlib.md5(v).hexdigest(), 0) for k, v in want.items()}
    assert {x.file_id: (x.n_streams, x.n_blocks > 2, x.plain_bytes, x.status) for x in L.verify(packed).collect()} == {k: (1, k == "d", len(v), 0) for k, v in want.items()}
    # a fault in a block, a stream behind the first, no stream
    d = files["d"]
    odd = {"bad": d[:10] + bytes([d[10] ^ 1]) + d[11:], "two": d + files["a"], "none": b"text", "cut": d[:-5]}
    cut = L.chunked(spark.createDataFrame([(k, 0, bytearray(v)) for k, v in odd.items()], "file_id string, off bigint, data binary"), 1000, L.BEHIND)
    two = want["d"] + want["a"]
    assert {x.file_id: (x.digest, x.status) for x in L.digests(cut).collect() if x.file_id == "two"} == {"two": (hashlib.md5(two).hexdigest(), 0)}
    got = {x.file_id: (x.n_streams, x.plain_bytes, x.status) for x in L.verify(cut).collect()}
    assert got["two"] == (2, len(two), 0) and got["bad"][2] == CODE["ERR_BLKCRC"] and got["none"][2] == -1 and got["cut"][2] == CODE["ERR_EOF"]


def test_batches_of_texts_are_bounded(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    files = C.as_files(spark.range(0, 80, 1, 1).selectExpr("id", "repeat('x', 500000) AS t"), "id", "t").coalesce(1)
    sizes = files.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n bigint").collect()
    assert len(sizes) > 10 and max(r.n for r in sizes) < 6_000_000


def test_trees_stop_when_the_choice_is_settled(monkeypatch):
    calls = []
    real = codec.code_lengths
    monkeypatch.setattr(codec, "code_lengths", lambda f, *a: calls.append(1) or real(f, *a))
    data = b"the same words again and the same words " * 30
    bits_, n = codec.encode_native(data)
    assert bz2.decompress(codec.assemble(9, [(bits_, n, codec.bits.crc(data))])) == data
    assert 0 < len(calls) < 8 * 2


def test_taxonomy_walks_each_stream_once(spark):
    plan = catalog.error_taxonomy(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 6 and "LeftOuter" not in plan.split("MapInArrow")[0].replace("LeftOuter, (status", "")


def test_aligned_blocks_are_encoded_into_chunks(spark):
    text = "".join(chr(97 + i * i % 23) + chr(97 + i % 7) for i in range(130_000))
    chunks = L.joined(spark.createDataFrame([("f", 1, text)], "f string, no int, t string"), "f", "no", "t", 100_000)
    blocks = S.align(L.encode(chunks, 1)).cache()
    packed = b"".join(bytes(c.data[: L.CHUNK]) for c in L.stream(blocks, 1).orderBy("chunk").collect())
    rows = blocks.orderBy("major", "minor").collect()
    assert len(rows) >= 3 and all(r.n_bits == 8 * len(r.bits) for r in rows)
    assert packed[4:-10] == b"".join(bytes(r.bits) for r in rows) and bz2.decompress(packed) == text.encode()
