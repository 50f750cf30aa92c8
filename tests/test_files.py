"""Files, data sources, streaming and the command line."""

import bz2
import os
import random

import pytest
from pyspark.sql import functions as F

from blockloom import cli
from blockloom.functions import bits, codec, layout
from blockloom.functions import expressions as E
from blockloom.operators import columns as C
from blockloom.operators import confirm as J
from blockloom.operators import streams as S
from blockloom.sources.files import granule, operands, read_files, register
from blockloom.streaming.arrivals import blocks_of_arrivals, decompressed, drain


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    r = random.Random(3)
    for i in range(5):
        data = r.randbytes(250_000) if i == 4 else b"line of text %d\n" % i * 1000
        (d / f"f{i}.bz2").write_bytes(bz2.compress(data, 1))
    return d


def test_read_and_scan_sources(spark, folder):
    register(spark)
    files = read_files(spark, str(folder), "*.bz2")
    assert files.count() == 5
    want = {(r.file_id.rsplit("/")[-1], r.bit_off, r.kind) for r in S.scan(files, 1 << 12).collect()}
    got = {(r.file_id.rsplit("/")[-1], r.bit_off, r.kind) for r in spark.read.format("bz2blocks").option("chunk", "999").load(f"file://{folder}").collect()}
    assert got == want and sum(k == "block" for _, _, k in got) >= 7
    files.createOrReplaceTempView("packed")
    by_sql = spark.sql("SELECT p.file_id, h.block_no, h.bit_off, h.status FROM packed p, LATERAL bz_headers(p.content) h").collect()
    assert len(by_sql) == S.headers(files.select("file_id", "content")).count() and all(r.status == 0 for r in by_sql)
    assert spark.sql("SELECT * FROM packed p, LATERAL bz_blocks(p.content) b").count() == len(want)


def test_confirmation_of_real_streams(spark, folder):
    files = read_files(spark, str(folder)).select("file_id", "content")
    found, parsed = S.scan(files), S.headers(files)
    blocks = found.where("kind = 'block'")
    assert J.missing(parsed, blocks).count() == 0 and J.confirmed(parsed, blocks).count() == parsed.count()
    fake = blocks.union(blocks.select("file_id", F.col("bit_off") + 7, "kind"))
    assert J.rejected(parsed, fake).count() == parsed.count()
    decoded = S.decode_candidates(files, fake.union(found.where("kind = 'end'")))
    assert decoded.where("status = 0").count() >= parsed.count()
    spans = parsed.select("file_id", "bit_off", "end_bit")
    assert J.reachable(spans).count() == parsed.count()


def test_sink_and_large_files(spark, tmp_path):
    register(spark)
    data = {"a": random.Random(5).randbytes(420_000), "b": b"", "c": b"z" * 1_000_000}
    files = spark.createDataFrame(list(data.items()), "file_id string, content binary")
    packed = S.compress(files, 1)
    packed.select(F.concat("file_id", F.lit(".bz2")).alias("name"), "content").write.format("bz2files").mode("append").option("path", f"file://{tmp_path}/out").save()
    for k, v in data.items():
        assert bz2.decompress((tmp_path / "out" / f"{k}.bz2").read_bytes()) == v
    assert not [f for f in os.listdir(tmp_path / "out") if f.startswith(".")]
    back = S.decompress(packed.select("file_id", "content")).collect()
    assert max(len(r.data) for r in back) <= S.PART
    for k, v in data.items():
        assert b"".join(bytes(r.data) for r in sorted((r for r in back if r.file_id == k), key=lambda r: r.part)) == v
    one, many = (S.encode_blocks(files, 1, s).groupBy("file_id").count().collect() for s in ("sequential", "parallel"))
    assert {r.file_id for r in one} == {r.file_id for r in many} == {"a", "c"}


def test_large_files_block_by_block(spark, tmp_path):
    """Several blocks and streams, damage, tails and a false magic, against the standard library."""
    r = random.Random(9)
    plain = {"many": r.randbytes(350_000), "runs": bytes(5_000_000) + r.randbytes(300_000), "joined": r.randbytes(300_000), "tail": r.randbytes(300_000), "false": b""}
    packed = {k: bz2.compress(v, 1) for k, v in plain.items()}
    packed["joined"] += bz2.compress(b"") + bz2.compress(b"end", 3) + b"BZh"
    plain["joined"] += b"end"
    packed["tail"] += b"not a stream \x31\x41\x59\x26\x53\x59 behind"
    w = bits.Writer()
    w.put(int.from_bytes(b"BZh1", "big"), 32)
    w.put(bits.read(packed["many"], 32, 8 * len(packed["many"]) - 32), 8 * len(packed["many"]) - 32)
    packed["same"], plain["same"] = w.done(), plain["many"]
    for k, at, mask in (("data", 150_000, 4), ("crc", 10, 1), ("sign", 0, 1)):
        bad = bytearray(packed["many"])
        bad[at] ^= mask
        packed[k] = bytes(bad)
    packed["cut"] = packed["many"][:-40_000]
    del packed["false"], plain["false"]
    files = spark.createDataFrame(list(packed.items()), "file_id string, content binary")
    assert {x.file_id for x in S.plan_blocks(files, 1 << 14).where("block_no = -1").collect()} == {"crc", "sign", "cut"}
    assert {x.file_id: x.n for x in S.plan_blocks(files, 1 << 14).where("block_no >= 0").groupBy("file_id").agg(F.count("*").alias("n")).collect()}["many"] == len(codec.walk(packed["many"])[1][0].blocks) > 3
    back = S.decompress(files).collect()
    checked = {x.file_id: x for x in S.verify(files).collect()}
    for k, v in packed.items():
        mine = sorted((x for x in back if x.file_id == k), key=lambda x: x.part)
        status, streams = codec.walk(v, sizes=False)
        assert checked[k].status == status
        if k in plain:
            assert status == 0 and b"".join(bytes(x.data) for x in mine) == plain[k] and all(x.status == 0 for x in mine)
            assert (checked[k].n_streams, checked[k].n_blocks, checked[k].plain_bytes) == (len(streams), sum(len(s.blocks) for s in streams), len(plain[k]))
        else:
            assert status != 0 and [(x.data, x.status) for x in mine] == [(None, status)]
    missed = spark.createDataFrame([("many", codec.walk(packed["many"])[1][0].blocks[1].bit_off)], "file_id string, bit_off long")
    (late,) = S.decode_missing(files, missed).collect()
    assert late.status == 0 and bytes(late.data) == codec.walk(packed["many"])[1][0].blocks[1].data


def test_sink_keeps_names_apart(spark, tmp_path):
    register(spark)
    rows = [("a/b", b"1"), ("a_b", b"2"), ("é f", b"3")]
    spark.createDataFrame(rows, "name string, content binary").write.format("bz2files").mode("overwrite").option("path", f"file://{tmp_path}/out").save()
    assert sorted(open(tmp_path / "out" / f, "rb").read() for f in os.listdir(tmp_path / "out")) == [b"1", b"2", b"3"]


def test_stream_of_arrivals(spark, folder, tmp_path):
    out = drain(decompressed(spark, str(folder), 2), str(tmp_path / "t"), str(tmp_path / "c"))
    assert out.select("file_id").distinct().count() == 5 and out.where("status <> 0").count() == 0
    assert drain(decompressed(spark, str(folder), 2), str(tmp_path / "t"), str(tmp_path / "c")).count() == out.count()


def test_blocks_of_chunks_that_arrive_over_time(spark, tmp_path):
    r = random.Random(4)
    files = {"a": b"".join(bytes([r.randrange(3)]) * r.randint(1, 300) for _ in range(3000)), "b": r.randbytes(230_000), "c": b"", "d": b"z" * 99_999}
    rows = []
    for name, data in files.items():
        cuts = [*range(0, len(data), 31_000)] or [0]
        rows += [(name, lo, data[lo : lo + 31_000], lo == cuts[-1]) for lo in cuts]
    rows += rows[:3]
    r.shuffle(rows)
    schema = "file_id string, byte_off bigint, data binary, last boolean"
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(blocks_of_arrivals(arriving, 1), str(tmp_path / "t"), str(tmp_path / "c")).collect()
    want = [(k, i, a, b - a, v[a:b]) for k, v in files.items() for i, (_, _, a, b) in enumerate(codec.split_sequential(v, 100_000))]
    assert sorted((x.file_id, x.block_no, x.raw_off, x.raw_len, bytes(x.data)) for x in got) == sorted(want)


def test_command_line(tmp_path, capfd):
    a, b, c = (str(tmp_path / n) for n in ("a.txt", "b.txt", "done.bz2"))
    for f in (a, b, c):
        open(f, "wb").write(f.encode() * 100)
    assert cli.main(["-1", "-k", "-v", a, b, c]) == cli.WARNED
    assert bz2.decompress(open(a + ".bz2", "rb").read()) == a.encode() * 100
    assert cli.main(["-t", a + ".bz2"]) == cli.OK and cli.main(["-t", c]) == cli.FATAL
    os.unlink(a)
    assert cli.main(["-d", a + ".bz2"]) == cli.OK and open(a, "rb").read() == a.encode() * 100
    assert not os.path.exists(a + ".bz2")
    assert cli.main(["-d", b + ".bz2"]) == cli.FATAL  # b is there
    assert cli.main([str(tmp_path / "none")]) == cli.WARNED


def test_command_line_keeps_whole_files_and_removes_partial_ones(tmp_path, capfd):
    """Of three files the second is damaged in its last block: the first is done, the second leaves nothing, the third is not begun."""
    data = random.Random(1).randbytes(250_000)
    packed = codec.compress(data, 1)
    for name, content in (("a", packed), ("b", layout.patched(packed, 8 * len(packed) - 40, 32, 7)), ("c", packed)):
        (tmp_path / f"{name}.bz2").write_bytes(content)
    assert cli.main(["-d", *(str(tmp_path / f"{n}.bz2") for n in "abc")]) == cli.FATAL
    assert sorted(os.listdir(tmp_path)) == ["a", "b.bz2", "c.bz2"] and (tmp_path / "a").read_bytes() == data
    old = tmp_path / "c"
    old.symlink_to(tmp_path / "a")
    assert cli.main(["-d", str(tmp_path / "c.bz2")]) == cli.FATAL and old.is_symlink()
    assert cli.main(["-df", str(tmp_path / "c.bz2")]) == cli.OK and not old.is_symlink() and old.read_bytes() == data


def test_sink_leaves_nothing_of_failed_tasks(spark, tmp_path):
    register(spark)
    broken = spark.range(6).coalesce(1).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") < 4, F.lit(b"x")).alias("content"))
    with pytest.raises(Exception):
        broken.write.format("bz2files").mode("overwrite").option("path", f"file://{tmp_path}/out").save()
    assert os.listdir(tmp_path / "out") == []


def test_command_line_modes(tmp_path, monkeypatch, capfdbinary):
    """Filters, the program's name, options that exclude each other, ranges."""
    import io

    def filtered(data, *args, name=""):
        monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(data)))
        capfdbinary.readouterr()
        state = cli.main(list(args), name)
        return state, capfdbinary.readouterr().out

    data = b"some text " * 50_000
    state, packed = filtered(data, "-2")
    assert state == cli.OK and bz2.decompress(packed) == data
    assert filtered(packed, name="bzcat") == filtered(packed, "-d") == filtered(packed, name="bunzip2") == (cli.OK, data)
    assert filtered(data, "-dcf") == (cli.OK, data) and filtered(data, "-d")[0] == cli.FATAL
    assert filtered(packed, "-t") == (cli.OK, b"") and filtered(packed[:-1], "-t")[0] == cli.FATAL
    assert filtered(b"", "-z", name="bunzip2") == (cli.OK, bz2.compress(b""))
    for bad in (["-c", "-t"], ["-t", "-c"], ["-n", "0"], ["-n", "x"], ["--no-such"]):
        assert cli.main(bad, "") == cli.FATAL
    assert cli.main(["-V"], "") == cli.main(["-h"], "") == cli.OK
    o = cli.parser("").parse_args(["-t", "-z", "-c"])
    assert (o.mode, o.out) == ("z", "c")
    f = tmp_path / "x.txt"
    f.write_bytes(data)
    capfdbinary.readouterr()
    assert cli.main(["-c", str(f)], "") == cli.OK and bz2.decompress(capfdbinary.readouterr().out) == data and f.exists()


def test_names_sizes_operands(spark):
    names = ["x.bz2", "x.tbz2", "x.tbz", "x.tz2", "x", ".bz2", "x.bz2.txt"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(E.output_name(F.col("n"))).collect()] == ["x", "x.tar", "x.tar", "x.tar", "x.out", "", "x.bz2.txt.out"]
    sizes = ["5", "2k", "3M", "1E", "9E", str((1 << 63) - 1), str(1 << 63), "0" * 30 + "5k", "", "k", "1kk", "-1", "12x", " 7"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n string").select(E.size_literal(F.col("n"))).collect()]
    assert got == [5, 2048, 3 << 20, 1 << 60, None, (1 << 63) - 1, None, 5120, None, None, None, None, None, 7]
    m = spark.createDataFrame([("a", True, 1), ("b.tbz", True, 1), ("c", False, 1), ("d", True, 2)], "name string, regular boolean, links int")
    assert [r.skip for r in operands(m).collect()] == [None, "compressed suffix", "not a regular file", "more than one links"]
    assert [r.skip for r in operands(m, force=True).collect()] == [None, "compressed suffix", None, None]
    assert [granule(x) for x in ("compress", "expand", "small", "copy")] == [900_000, 262_144, 32_768, 65_536]


def test_null_and_empty_content(spark):
    t = spark.createDataFrame([(1, None), (2, b""), (3, b"aaaa")], "k int, c binary")
    files = C.as_files(t, "k", "c")
    out = {r.file_id: r for r in S.verify(S.compress(files).select("file_id", "content")).collect()}
    assert [out[i].plain_bytes for i in (1, 2, 3)] == [0, 0, 4] and all(r.status == 0 for r in out.values())
    assert S.verify(files).where("status = -1").count() == 3
    assert C.run_summary(files).collect()[0].encoded_len == len(codec.rle_encode(b"aaaa"))
    empty = files.where("false")
    assert S.compress(empty).count() == S.decompress(empty).count() == C.histogram(empty).count() == 0
