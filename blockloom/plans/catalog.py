"""Queries over the test tables, each with the same result stated in SQL where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockloom.functions import codec
from blockloom.functions import expressions as E
from blockloom.functions.layout import KINDS
from blockloom.operators import columns as C
from blockloom.operators import confirm as J
from blockloom.operators import large as L
from blockloom.operators import streams as S
from blockloom.schema import CODE, ERRORS
from blockloom.sources.files import operands

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return C.as_files(_t(spark, sf, "documents"), "doc_id", "text")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return C.as_files(_t(spark, sf, "benchmark"), "item_id", "text")


def _whole(x: Column) -> Column:
    """A double as a bigint as SQL casts it: the nearest, of two the even one."""
    return F.rint(x).cast("bigint")


def _as(df: DataFrame, key: str) -> DataFrame:
    return df.withColumnRenamed("file_id", key)


# --- SQL pieces

BYTES = """{name} AS (SELECT {key} AS k, unnest(range(octet_length(encode({col})))) AS pos, unnest(regexp_extract_all(hex(encode({col})), '..')) AS hx FROM {table} WHERE {col} <> '')"""
DOC_BYTES = BYTES.format(name="b", key="doc_id", col="text", table="documents")
ITEM_BYTES = BYTES.format(name="b", key="item_id", col="text", table="benchmark")
RUNS = """m AS (SELECT k, pos, hx, CASE WHEN hx = lag(hx) OVER (PARTITION BY k ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM b),
i AS (SELECT k, pos, hx, sum(fresh) OVER (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM m),
r AS (SELECT k, run, min(pos) AS start, count(*) AS len FROM i GROUP BY k, run)"""
CODED = "(5 * (len // 259) + CASE WHEN len % 259 < 4 THEN len % 259 ELSE 5 END)"
#: One byte at a time through a table made from the polynomial.
CRC_TABLE = "t AS (SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c & 2147483648 <> 0 THEN xor((c << 1) & 4294967295, 79764919) ELSE (c << 1) & 4294967295 END, n << 24) ORDER BY n) AS tbl FROM range(256) g(n))"
CRC = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode({col})), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, x: xor((c << 8) & 4294967295, tbl[xor(c >> 24, x) + 1]), 4294967295::BIGINT), 4294967295)"
CRCS = f"{CRC_TABLE}, c AS (SELECT doc_id, lang, source, {CRC.format(col='text')} AS crc FROM documents, t)"
#: Rank of a byte: how many others occurred since it last did; before the text stands the alphabet, least first.
RANKS = """a AS (SELECT k, hx, row_number() OVER (PARTITION BY k ORDER BY hx) AS no FROM (SELECT DISTINCT k, hx FROM b)),
l AS (SELECT b.k, b.pos, b.hx AS cur, a.hx AS sym, coalesce(max(CASE WHEN a.hx = b.hx THEN b.pos END) OVER (PARTITION BY b.k, a.hx ORDER BY b.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -a.no) AS seen FROM b JOIN a ON a.k = b.k),
o AS (SELECT k, pos, seen FROM l WHERE cur = sym),
q AS (SELECT l.k, l.pos, count(*) FILTER (WHERE l.seen > o.seen) AS rank FROM l JOIN o ON o.k = l.k AND o.pos = l.pos GROUP BY l.k, l.pos)"""
#: A run of n zeros as symbols: the binary digits of n + 1 but the first, least first.
SYMBOLS = """z AS (SELECT k, pos, rank, sum(CASE WHEN rank <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM q),
zr AS (SELECT k, island, min(pos) AS pos, count(*) AS n FROM z WHERE rank = 0 GROUP BY k, island),
zd AS (SELECT k, pos, n, unnest(range(CAST(floor(log2(n + 1)) AS BIGINT))) AS i FROM zr),
u AS (SELECT k, pos, i, ((n + 1) >> i) & 1 AS sym FROM zd UNION ALL SELECT k, pos, 0, rank + 1 FROM z WHERE rank <> 0),
s AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY pos, i) - 1 AS no, sym FROM u)"""
ITEM_SYMBOLS = f"{ITEM_BYTES}, {RANKS}, {SYMBOLS}"
FREQ = "f AS (SELECT k, sym, count(*) AS n FROM s GROUP BY k, sym)"
LENGTHS = f"{FREQ}, tot AS (SELECT k, sum(n) AS total FROM f GROUP BY k), ln AS (SELECT f.k, f.sym, f.n, (SELECT min(x) FROM range(1, 31) g(x) WHERE (f.n << x::BIGINT) >= tot.total) AS len FROM f JOIN tot ON tot.k = f.k)"


# --- names, sizes, signatures, chunks


def _names():
    return F.concat("url", F.get(F.array(*map(F.lit, (".bz2", ".tbz2", ".tbz", ".tz2", ".txt", ""))), F.col("page_id") % 6))


_NAMES_SQL = "url || ['.bz2', '.tbz2', '.tbz', '.tz2', '.txt', ''][page_id % 6 + 1]"


@query(f"SELECT page_id, CASE WHEN page_id % 6 = 0 THEN url WHEN page_id % 6 < 4 THEN url || '.tar' ELSE n || '.out' END AS output FROM (SELECT page_id, url, {_NAMES_SQL} AS n FROM pages)")
def suffix_map(spark, sf):
    return _t(spark, sf, "pages").select("page_id", E.output_name(_names()).alias("output"))


@query(f"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'not a regular file' WHEN page_id % 3 > 1 THEN 'more than one links' WHEN page_id % 6 < 4 THEN 'compressed suffix' END AS skip FROM (SELECT page_id, {_NAMES_SQL} AS n FROM pages)")
def operand_skips(spark, sf):
    manifest = _t(spark, sf, "pages").select("page_id", _names().alias("name"), (F.col("page_id") % 5 != 0).alias("regular"), (F.col("page_id") % 3).alias("links"))
    return operands(manifest).select("page_id", "skip")


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * [1, 1024, 1048576, 1073741824, 1099511627776, 1125899906842624, 1][l_linenumber] AS size FROM lineitem")
def size_literal(spark, sf):
    unit = F.get(F.array(*map(F.lit, ("", "k", "M", "g", "T", "P", ""))), F.col("l_linenumber") - 1)
    text = F.concat(_whole(F.col("l_quantity")).cast("string"), unit)
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", E.size_literal(text).alias("size"))


@query("SELECT doc_id, CASE WHEN regexp_matches(t, '^BZh[1-9]') THEN CAST(substr(t, 4, 1) AS INT) END AS level FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'BZh' || (doc_id % 12) || text END AS t FROM documents)")
def signature_sniff(spark, sf):
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("BZh"), (F.col("doc_id") % 12).cast("string"), "text"))
    return _t(spark, sf, "documents").select("doc_id", E.signature_level(text.cast("binary")).alias("level"))


@query("SELECT doc_id, major, major * 4096 AS byte_off, least(4096, octet_length(encode(text)) - major * 4096) AS n, md5(substr(hex(encode(text)), 8192 * major + 1, 8192)) AS digest FROM documents, unnest(range((octet_length(encode(text)) + 4095) // 4096)) g(major)")
def chunk_split(spark, sf):
    c = C.chunks(_docs(spark, sf), 4096)
    return _as(c.select("file_id", "major", "byte_off", F.octet_length("data").cast("bigint").alias("n"), F.md5(F.encode(F.hex("data"), "UTF-8")).alias("digest")), "doc_id")


# --- run lengths and block splits


@query(f"WITH {DOC_BYTES}, {RUNS} SELECT k AS doc_id, sum(len)::BIGINT AS n_bytes, count(*) AS n_runs, max(len) AS longest, count(*) FILTER (WHERE len >= 4) AS n_long, sum({CODED})::BIGINT AS encoded_len FROM r GROUP BY k")
def rle_runs(spark, sf):
    return _as(C.run_summary(_docs(spark, sf)), "doc_id")


@query(f"WITH {DOC_BYTES}, {RUNS} SELECT k AS doc_id, sum({CODED})::BIGINT AS enc_bytes, true AS same FROM r GROUP BY k")
def rle_roundtrip(spark, sf):
    docs = _docs(spark, sf).where(F.octet_length("content") > 0)
    return _as(C.rle(docs).join(docs, "file_id").select("file_id", F.octet_length("enc").cast("bigint").alias("enc_bytes"), (F.col("back") == F.col("content")).alias("same")), "doc_id")


@query(f"WITH {DOC_BYTES}, {RUNS}, e AS (SELECT k, len, coalesce(sum({CODED}) OVER (PARTITION BY k ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1000 AS block_no FROM r) SELECT k AS doc_id, block_no::BIGINT AS block_no, count(*) AS n_runs, sum(len)::BIGINT AS n_bytes FROM e GROUP BY k, block_no")
def split_estimate(spark, sf):
    return _as(C.split_estimate(_docs(spark, sf), 1000), "doc_id")


@query()
def split_sequential(spark, sf):
    return _as(C.split(_docs(spark, sf), 1000), "doc_id")


@query()
def split_parallel(spark, sf):
    return _as(C.split(_docs(spark, sf), 1000, sequential=False), "doc_id")


@query("SELECT doc_id, doc_id % 2 = 0 AS missing FROM documents WHERE text <> ''")
def missing_run_length(spark, sf):
    """A coded text followed by four of a byte that it does not end with lacks a count; with a fifth it has one."""
    docs = _t(spark, sf, "documents").where("text <> ''")
    files = C.rle(docs.select(F.col("doc_id").alias("file_id"), F.col("text").cast("binary").alias("content")))
    tail = F.when(F.col("file_id") % 2 == 0, F.unhex(F.lit("00000000"))).otherwise(F.unhex(F.lit("0000000000")))
    return _as(C.missing_run_length(files.select("file_id", F.concat("enc", tail).alias("content"))), "doc_id")


# --- bytes and checksums


@query(f"WITH {DOC_BYTES}, h AS (SELECT ('0x' || hx)::INT AS byte, count(*) AS n FROM b GROUP BY hx) SELECT byte, n, coalesce(sum(n) OVER (ORDER BY byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM h")
def byte_histogram(spark, sf):
    return C.byte_totals(C.histogram(_docs(spark, sf)))


@query(f"WITH {DOC_BYTES} SELECT k AS doc_id, ('0x' || hx)::INT AS byte, (row_number() OVER (PARTITION BY k ORDER BY hx) - 1)::INT AS rank FROM (SELECT DISTINCT k, hx FROM b)")
def used_map(spark, sf):
    return _as(C.used_map(C.histogram(_docs(spark, sf))), "doc_id")


@query(f"WITH {DOC_BYTES}, d AS (SELECT DISTINCT k, ('0x' || hx)::INT AS byte FROM b) SELECT k AS doc_id, sum(DISTINCT 1 << (15 - byte // 16))::BIGINT AS big, count(*) AS n_used, 16 + 16 * count(DISTINCT byte // 16) AS cost_bits FROM d GROUP BY k")
def used_bitmap(spark, sf):
    return _as(C.used_bitmap(C.histogram(_docs(spark, sf))), "doc_id")


@query(f"WITH {CRCS} SELECT doc_id, crc::BIGINT AS crc FROM c")
def block_crc(spark, sf):
    return _docs(spark, sf).select(F.col("file_id").alias("doc_id"), E.block_crc(F.col("content")).alias("crc"))


_FOLD = "list_reduce(list(crc ORDER BY doc_id), lambda a, x: xor(((a << 1) & 4294967295) | (a >> 31), x), 0::BIGINT)"


@query(f"WITH {CRCS} SELECT lang, count(*) AS n_blocks, ({_FOLD})::BIGINT AS stream_crc FROM c GROUP BY lang")
def stream_crc(spark, sf):
    crcs = C.spread(_t(spark, sf, "documents").select("lang", "doc_id", "text")).select("lang", "doc_id", E.block_crc(F.col("text").cast("binary")).alias("crc"))
    return J.stream_crcs(crcs, ["lang"], "doc_id")


@query(f"WITH {CRCS}, s AS (SELECT source, ({_FOLD})::BIGINT AS x, 1 + count(*) % 9 AS level FROM c GROUP BY source) SELECT source, printf('425A683%d', level) AS header, printf('177245385090%08X', x) AS trailer FROM s")
def stream_frame(spark, sf):
    crcs = C.spread(_t(spark, sf, "documents").select("source", "doc_id", "text")).select("source", "doc_id", E.block_crc(F.col("text").cast("binary")).alias("crc"))
    s = J.stream_crcs(crcs, ["source"], "doc_id")
    return s.select("source", F.hex(E.stream_header(1 + F.col("n_blocks") % 9)).alias("header"), F.hex(E.stream_trailer(F.col("stream_crc"))).alias("trailer"))


@query("SELECT l_orderkey, l_linenumber, (((l_partkey * 40503) & 4294967295) << l_linenumber) & 4294967295 | (((l_partkey * 40503) & 4294967295) >> (32 - l_linenumber)) AS rotated FROM lineitem")
def rotate_bits(spark, sf):
    x = (F.col("l_partkey") * 40503).bitwiseAND(F.lit(E.MASK))
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", E.rotl32(x, F.col("l_linenumber")).alias("rotated"))


@query("SELECT doc_id, (8 - (n_chars % 8)) % 8 AS pad FROM documents")
def block_padding(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", E.padding_bits(F.col("n_chars")).alias("pad"))


# --- rotation sort, ranks, symbols


@query(f"""WITH h AS (SELECT item_id AS k, hex(encode(text)) AS t, octet_length(encode(text)) AS n FROM benchmark WHERE text <> ''),
rot AS (SELECT k, n, t, g.i AS i, substr(t || t, 2 * g.i + 1, 2 * n) AS x FROM h, unnest(range(n)) g(i)),
srt AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY x, i) - 1 AS no, substr(x, 2 * n - 1, 2) AS last FROM rot)
SELECT k AS item_id, max(CASE WHEN i = 0 THEN no END)::INT AS idx, md5(string_agg(last, '' ORDER BY no)) AS last_column, true AS inverts FROM srt GROUP BY k""")
def rotation_sort(spark, sf):
    def make(data: bytes):
        if data:
            last, index = codec.bwt(data)
            yield last, index, codec.ibwt(last, index) == data

    out = C.per_file(_items(spark, sf), "last binary, idx int, inverts boolean", make, 256)
    return _as(out.select("file_id", "idx", F.md5(F.encode(F.hex("last"), "UTF-8")).alias("last_column"), "inverts"), "item_id")


@query()
def rotation_sort_documents(spark, sf):
    s = C.sorted_rotations(_docs(spark, sf))
    return _as(s.select("file_id", "idx", F.md5("last").alias("last_column"), (F.col("back") == F.col("enc")).alias("inverts")), "doc_id")


@query(f"WITH {ITEM_BYTES}, {RANKS} SELECT k AS item_id, pos, rank FROM q")
def mtf_ranks(spark, sf):
    r = C.ranks(_items(spark, sf)).select("file_id", F.posexplode("ranks").alias("pos", "rank"))
    return _as(r.select("file_id", F.col("pos").cast("bigint").alias("pos"), F.col("rank").cast("bigint").alias("rank")), "item_id")


def _symbols(spark, sf):
    return C.zero_runs(C.ranks(_items(spark, sf)))


@query(f"WITH {ITEM_SYMBOLS} SELECT k AS item_id, no, sym::INT AS sym FROM s")
def zero_run_symbols(spark, sf):
    return _as(_symbols(spark, sf), "item_id")


@query(f"WITH {ITEM_SYMBOLS}, {FREQ} SELECT k AS item_id, sym::INT AS sym, n, (row_number() OVER (PARTITION BY k ORDER BY n DESC, sym) - 1)::INT AS place FROM f")
def symbol_frequencies(spark, sf):
    return _as(C.symbol_frequencies(_symbols(spark, sf)), "item_id")


@query(f"WITH {ITEM_SYMBOLS} SELECT k AS item_id, count(*) AS n_symbols, CASE WHEN count(*) > 2400 THEN 6 WHEN count(*) > 1200 THEN 5 WHEN count(*) > 600 THEN 4 WHEN count(*) > 300 THEN 3 ELSE 2 END AS n_trees, (count(*) + 49) // 50 AS n_groups FROM s GROUP BY k")
def tree_plan(spark, sf):
    n = _symbols(spark, sf).groupBy("file_id").agg(F.count("*").alias("n_symbols"))
    return _as(n.select("file_id", "n_symbols", E.tree_count(F.col("n_symbols")).alias("n_trees"), E.group_count(F.col("n_symbols")).alias("n_groups")), "item_id")


def _lengths(spark, sf):
    return C.shannon_lengths(C.symbol_frequencies(_symbols(spark, sf)))


@query(f"WITH {ITEM_SYMBOLS}, {LENGTHS} SELECT k AS item_id, count(*) AS n_codes, sum(1048576 >> len::INT)::BIGINT AS kraft, CASE WHEN sum(1048576 >> len::INT) > 1048576 THEN 'over' WHEN sum(1048576 >> len::INT) < 1048576 THEN 'incomplete' ELSE 'full' END AS verdict FROM ln GROUP BY k")
def kraft_check(spark, sf):
    return _as(C.kraft(_lengths(spark, sf)), "item_id")


@query(f"WITH RECURSIVE {ITEM_SYMBOLS}, {LENGTHS}, p AS (SELECT k, sym, len, row_number() OVER (PARTITION BY k ORDER BY len, sym) AS no FROM ln), w AS (SELECT k, sym, len, no, 0::BIGINT AS code FROM p WHERE no = 1 UNION ALL SELECT p.k, p.sym, p.len, p.no, (w.code + 1) << (p.len - w.len)::BIGINT FROM w JOIN p ON p.k = w.k AND p.no = w.no + 1) SELECT k AS item_id, sym::INT AS sym, len::INT AS len, code FROM w")
def canonical_codes(spark, sf):
    return _as(C.canonical_codes(_lengths(spark, sf)), "item_id")


@query(f"WITH {ITEM_SYMBOLS}, {LENGTHS} SELECT k AS item_id, sum(n * len)::BIGINT AS cost_bits FROM ln GROUP BY k")
def tree_cost(spark, sf):
    return _as(C.tree_cost(_lengths(spark, sf)), "item_id")


@query(f"WITH {ITEM_SYMBOLS}, tr AS (SELECT tree, sym, 1 + (sym * (tree + 3)) % 12 AS len FROM range(6) a(tree), range(258) z(sym)), co AS (SELECT k, no // 50 AS grp, tree, sum(len) AS cost FROM s JOIN tr ON tr.sym = s.sym GROUP BY k, no // 50, tree) SELECT k AS item_id, grp, arg_min(tree, cost * 10 + tree)::BIGINT AS tree, min(cost)::BIGINT AS cost FROM co GROUP BY k, grp")
def best_tree_per_group(spark, sf):
    trees = spark.range(6).withColumnRenamed("id", "tree").join(F.broadcast(spark.range(258).withColumnRenamed("id", "sym")), how="cross").withColumn("len", 1 + (F.col("sym") * (F.col("tree") + 3)) % 12)
    return _as(C.best_tree(_symbols(spark, sf), F.broadcast(trees)), "item_id")


@query()
def prefix_code(spark, sf):
    return _as(C.prefix_code(_items(spark, sf)), "item_id")


# --- discovery and confirmation, on positions that events stand for


def _positions(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("bit_off"), "event_type", "value")
    return e.where("value >= 10").drop("event_type"), e.where("event_type <> 'click'").select("file_id", "bit_off", "event_type")


_PC = "WITH p AS (SELECT user_id AS file_id, event_id AS bit_off, value FROM events WHERE value >= 10), c AS (SELECT user_id AS file_id, event_id AS bit_off, event_type FROM events WHERE event_type <> 'click')"


@query(f"{_PC} SELECT p.file_id, p.bit_off, p.value, c.event_type FROM p, c WHERE p.file_id = c.file_id AND p.bit_off = c.bit_off")
def candidates_confirmed(spark, sf):
    return J.confirmed(*_positions(spark, sf))


@query(f"{_PC} SELECT * FROM c WHERE (file_id, bit_off) NOT IN (SELECT (file_id, bit_off) FROM p)")
def candidates_rejected(spark, sf):
    return J.rejected(*_positions(spark, sf))


@query(f"{_PC} SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.file_id = p.file_id AND c.bit_off = p.bit_off)")
def candidates_missing(spark, sf):
    return J.missing(*_positions(spark, sf))


@query(f"{_PC} SELECT p.file_id, p.bit_off, 0 AS part, event_type, (row_number() OVER (PARTITION BY p.file_id ORDER BY p.bit_off) - 1)::INT AS out_no FROM p JOIN c ON p.file_id = c.file_id AND p.bit_off = c.bit_off")
def output_order(spark, sf):
    parsed, candidates = _positions(spark, sf)
    return J.reordered(parsed, candidates.withColumn("part", F.lit(0)))


@query("SELECT doc_id, 8 * 4096 * major AS bit_off, CASE WHEN major > 0 THEN true ELSE false END AS follows FROM documents, unnest(range((octet_length(encode(text)) + 4095) // 4096)) g(major)")
def chain_follows(spark, sf):
    c = C.chunks(_docs(spark, sf), 4096)
    spans = c.select("file_id", (F.col("byte_off") * 8).alias("bit_off"), ((F.col("byte_off") + F.octet_length("data")) * 8).alias("end_bit"))
    return _as(J.chained(spans).select("file_id", "bit_off", "follows"), "doc_id")


@query("SELECT doc_id, max(major)::INT AS steps, max(least(octet_length(encode(text)), 4096 * (major + 1))) * 8 AS end_bit FROM documents, unnest(range((octet_length(encode(text)) + 4095) // 4096)) g(major) GROUP BY doc_id")
def chain_walk(spark, sf):
    c = C.chunks(_docs(spark, sf), 4096)
    spans = c.select("file_id", (F.col("byte_off") * 8).alias("bit_off"), ((F.col("byte_off") + F.octet_length("data")) * 8).alias("end_bit"))
    return _as(J.reachable(spans).groupBy("file_id").agg(F.max("step").alias("steps"), F.max("end_bit").alias("end_bit")), "doc_id")


_ERRORS_SQL = ", ".join(f"({c}, '{n}', '{m}')" for c, n, m in ERRORS)


@query(f"WITH e(code, name, message) AS (VALUES {_ERRORS_SQL}) SELECT name, message, count(*) AS n FROM lineitem JOIN e ON code = 3 + (l_partkey % 17) GROUP BY name, message")
def error_lookup(spark, sf):
    statuses = _t(spark, sf, "lineitem").select((3 + F.col("l_partkey") % 17).alias("status"))
    return J.with_messages(statuses.groupBy("status").agg(F.count("*").alias("n"))).select("name", "message", "n")


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN CAST(l_extendedprice AS BIGINT) * 10 > l_linenumber * 100000 THEN {CODE['ERR_OVERFLOW']} WHEN l_returnflag = 'R' THEN {CODE['ERR_RUNLEN']} WHEN l_partkey <> l_suppkey THEN {CODE['ERR_BLKCRC']} ELSE 0 END AS final FROM lineitem")
def block_status(spark, sf):
    d = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (_whole(F.col("l_extendedprice")) * 10).alias("blk_sz"), F.col("l_linenumber").alias("level"), F.when(F.col("l_returnflag") == "R", CODE["ERR_RUNLEN"]).otherwise(0).alias("status"), F.col("l_partkey").alias("crc"), F.col("l_suppkey").alias("stored_crc"))
    return J.block_status(d).select("l_orderkey", "l_linenumber", "final")


# --- metrics


@query("SELECT doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS done, round(100 * sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n_chars) OVER (PARTITION BY source)::DOUBLE, 6) AS percent FROM documents")
def progress_percent(spark, sf):
    p = J.progress(_t(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars")
    return p.select("doc_id", "done", F.round("percent", 6).alias("percent"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / l_tax_, 9) AS ratio, round(1 - l_quantity / l_tax_, 9) AS savings FROM (SELECT *, l_partkey + 1 AS l_tax_ FROM lineitem)")
def ratio_savings(spark, sf):
    c, p = F.col("l_quantity"), F.col("l_partkey") + 1
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(E.ratio(c, p), 9).alias("ratio"), F.round(E.savings(c, p), 9).alias("savings"))


@query("SELECT o_orderkey, greatest(k - coalesce(max(k) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS weight FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS k FROM orders)")
def offset_weight(spark, sf):
    rows = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("k"))
    return J.offset_weights(rows, ["o_custkey"], "o_orderkey", "k").select("o_orderkey", "weight")


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def task_pick(spark, sf):
    return J.first_by_priority(_t(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS since, coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 3600 SECOND < ts, false) AS due FROM events")
def elapsed_times(spark, sf):
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = _t(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("now"), F.unix_micros(before.cast("timestamp")).alias("then"))
    return e.select("event_id", ((F.col("now") - F.col("then")) / 1e6).alias("since"), F.coalesce(F.col("then") + 3_600_000_000 < F.col("now"), F.lit(False)).alias("due"))


# --- whole streams


def _joined(parts: DataFrame) -> DataFrame:
    """Digest of each file's output; files of the test tables are one part each."""
    joined = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.hex("data").alias("hex")))), lambda x: x["hex"]), ""))
    whole = parts.groupBy("file_id").agg(joined.alias("data"), F.max("status").alias("status"))
    return whole.select("file_id", F.octet_length("data").cast("bigint").alias("plain_bytes"), F.md5("data").alias("digest"), "status")


@query("SELECT doc_id, octet_length(encode(text)) AS plain_bytes, md5(text) AS digest, 0 AS status FROM documents")
def roundtrip_documents(spark, sf):
    return _as(_joined(S.decompress(S.compress(_docs(spark, sf)), False)), "doc_id")


@query("SELECT page_id, octet_length(encode(html)) AS plain_bytes, md5(html) AS digest, 0 AS status FROM pages")
def roundtrip_pages(spark, sf):
    files = C.as_files(_t(spark, sf, "pages"), "page_id", "html")
    return _as(_joined(S.decompress(S.compress(files, 1, "sequential"), False)), "page_id")


@query("SELECT doc_id, octet_length(encode(text)) AS plain_bytes, md5(text) AS digest, 0 AS status FROM documents")
def roundtrip_native(spark, sf):
    """Through this package's own encoder, stage by stage, and the library's decoder."""
    return _as(_joined(S.decompress(S.compress(_docs(spark, sf), engine="native"), False)), "doc_id")


def _sources(spark, sf):
    """The texts of a source as one file of many blocks, in chunks of a block."""
    d = _t(spark, sf, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", "text")
    return L.joined(d, "source", "doc_id", "text", 100_000)


_SOURCES = "SELECT coalesce(source, '') AS source, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY coalesce(source, '')"


@query(f"SELECT source, octet_length(encode(text)) AS plain_bytes, md5(text) AS digest, 0 AS status FROM ({_SOURCES})")
def roundtrip_sources(spark, sf):
    """Files of several blocks, each block decoded by itself."""
    return _as(L.digests(L.stream(L.encode(_sources(spark, sf), 1), 1)), "source")


@query(f"SELECT source, 1 AS n_streams, octet_length(encode(text)) AS plain_bytes, 0 AS status FROM ({_SOURCES})")
def verify_sources(spark, sf):
    checked = L.verify(L.stream(L.encode(_sources(spark, sf), 1), 1))
    return _as(checked.select("file_id", "n_streams", "plain_bytes", "status"), "source")


@query("SELECT doc_id, octet_length(encode(text || lang)) AS plain_bytes, md5(text || lang) AS digest, 0 AS status FROM documents")
def concatenated_streams(spark, sf):
    """Two streams back to back, and a bare BZ behind them."""
    d = _t(spark, sf, "documents")
    a, b = S.compress(C.as_files(d, "doc_id", "text")), S.compress(C.as_files(d, "doc_id", "lang"), 1)
    both = a.join(b.select("file_id", F.col("content").alias("second")), "file_id").select("file_id", F.concat("content", "second", F.lit(b"BZ")).alias("content"))
    return _as(_joined(S.decompress(both, False)), "doc_id")


@query("SELECT page_id, octet_length(encode(html)) AS plain_bytes, md5(html) AS digest, 0 AS status FROM pages")
def pass_through(spark, sf):
    """Half of the pages compressed, half as they are; all come back."""
    files = C.as_files(_t(spark, sf, "pages"), "page_id", "html")
    mixed = S.compress(files.where("file_id % 2 = 0")).select("file_id", "content").union(files.where("file_id % 2 = 1"))
    return _as(_joined(S.pass_through(mixed, False)), "page_id")


@query("SELECT doc_id, 0 AS stream_no, 0 AS block_no, 9 AS level, crc::BIGINT AS stored_crc FROM (WITH " + CRCS + " SELECT doc_id, crc FROM c) WHERE crc <> 0")
def header_table(spark, sf):
    h = S.headers(S.compress(_docs(spark, sf)).select("file_id", "content"), False)
    return _as(h.select("file_id", "stream_no", "block_no", "level", "stored_crc"), "doc_id")


@query("SELECT doc_id, 'block' AS kind, count(*) AS n FROM documents WHERE text <> '' GROUP BY doc_id UNION ALL SELECT doc_id, 'end', count(*) FROM documents GROUP BY doc_id")
def scan_magics(spark, sf):
    found = S.scan(S.compress(_docs(spark, sf)).select("file_id", "content"), 1024)
    return _as(found.groupBy("file_id", "kind").agg(F.count("*").alias("n")), "doc_id")


@query("SELECT page_id, octet_length(encode(html)) AS plain_bytes, md5(html) AS digest, 0 AS status FROM pages")
def speculative_decode(spark, sf):
    """Scan, decode every candidate by itself, keep those on the chain, decode what the chain misses, put all in order."""
    packed = S.compress(C.as_files(_t(spark, sf, "pages"), "page_id", "html"), 1).select("file_id", "content")
    decoded = S.decode_candidates(packed, S.scan(packed, 1 << 14))
    parsed = S.headers(packed, False)
    good = J.block_status(decoded.withColumn("level", F.lit(1))).where("final = 0")
    late = J.block_status(S.decode_missing(packed, J.missing(parsed, good)).withColumn("level", F.lit(1)))
    kept = J.reordered(parsed, good.union(late).select("file_id", "bit_off", "part", "data", "final"))
    return _as(_joined(kept.select("file_id", F.col("out_no").alias("part"), "data", F.col("final").alias("status"))), "page_id")


@query("SELECT doc_id, 1 AS n_streams, CASE WHEN text = '' THEN 0 ELSE 1 END AS n_blocks, octet_length(encode(text)) AS plain_bytes, 0 AS status, 'OK' AS name, '' AS message FROM documents")
def verify_documents(spark, sf):
    return _as(S.verify(S.compress(_docs(spark, sf)).select("file_id", "content"), False), "doc_id")


_DAMAGE = {"block_crc": "ERR_BLKCRC", "stream_crc": "ERR_STRMCRC", "header": "ERR_HEADER", "cut": "ERR_EOF"}
_DAMAGE_SQL = " UNION ALL ".join(f"SELECT '{k}' AS damage, {CODE[n]} AS status, '{next(m for c, _, m in ERRORS if c == CODE[n])}' AS message, count(*) AS n FROM documents WHERE text <> ''" for k, n in _DAMAGE.items())


@query(f"{_DAMAGE_SQL} UNION ALL SELECT 'signature', -1, 'not a valid compressed file', count(*) FROM documents WHERE text <> ''")
def verify_damaged(spark, sf):
    packed = S.compress(_docs(spark, sf).where(F.octet_length("content") > 0)).select("file_id", "content")  # the damage is to a block
    told = S.verify(S.damage_each(packed, [*_DAMAGE, "signature"]), False)
    return told.groupBy(F.col("file_id.kind").alias("damage"), "status", "message").agg(F.count("*").alias("n"))


_KIND = [next(c for c, n, _ in ERRORS if n == kind) for kind in KINDS]
_FIELD_KINDS = ("ERR_BITMAP", "ERR_TREES", "ERR_GROUPS", "ERR_SELECTOR", "ERR_DELTA", "ERR_EMPTY", "ERR_UNTERM", "ERR_BWTIDX")


@query(f"SELECT doc_id, status, message, CASE WHEN status IN ({', '.join(str(CODE[k]) for k in _FIELD_KINDS)}) THEN status ELSE 0 END AS by_fields FROM (SELECT doc_id, {_KIND}[doc_id % {len(KINDS)} + 1] AS status FROM documents WHERE text <> '') JOIN (VALUES {', '.join(f"({c}, '{m}')" for c, _, m in ERRORS)}) e(code, message) ON code = status")
def error_taxonomy(spark, sf):
    """Each stream with one fault, of every kind in turn: what verify says, and what the predicates on block fields say of those that they know."""
    docs = _docs(spark, sf).where(F.octet_length("content") > 0)
    packed = S.compress(docs).select("file_id", "content").withColumn("kind", F.get(F.array(*map(F.lit, KINDS)), (F.col("file_id") % len(KINDS)).cast("int")))
    bad = S.spoil(packed, "kind")
    return _as(S.verify_fields(bad).select("file_id", "status", "message", "by_fields"), "doc_id")


@query(f"SELECT source, octet_length(encode(text)) AS plain_bytes, md5(text) AS digest, 0 AS status, true AS whole FROM ({_SOURCES})")
def aligned_streams(spark, sf):
    """Blocks of whole bytes; streams are their bytes joined in order, and decode to the texts."""
    blocks = S.align(L.encode(_sources(spark, sf), 1))
    whole = F.bool_and((F.col("n_bits") % 8 == 0) & (F.col("n_bits") == 8 * F.octet_length("bits"))).over(W.partitionBy("file_id"))
    keyed = blocks.withColumn("whole", whole).withColumn("file_id", F.struct("file_id", "whole"))
    d = L.digests(L.stream(keyed, 1))
    return d.select(F.col("file_id.file_id").alias("source"), "plain_bytes", "digest", "status", "file_id.whole")


@query()
def compression_stats(spark, sf):
    docs = _docs(spark, sf)
    return _as(S.stats(docs, S.compress(docs)), "doc_id")


@query("SELECT source, count(*) AS n_docs, sum(octet_length(encode(text)))::BIGINT AS plain_bytes, count(*) FILTER (WHERE text <> '') AS n_blocks, true AS crc_ok, true AS text_equal FROM documents GROUP BY source")
def verified_sources(spark, sf):
    """Compress, parse, decode, check and compare every document; metrics by source."""
    d = C.spread(_t(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "source", F.coalesce("text", F.lit("")).cast("binary").alias("content")))

    def make(data: bytes):
        packed = codec.compress(data)
        status, streams = codec.walk(packed, sizes=False)
        blocks = [b for s in streams for b in s.blocks]
        yield len(packed), len(blocks), status == 0 and all(b.crc == b.stored_crc for b in blocks), b"".join(b.data for b in blocks) == data

    checked = C.per_file(d.select("file_id", "content"), "compr_bytes bigint, n_blocks int, crc_ok boolean, text_equal boolean", make)
    sizes = d.select("file_id", "source", F.octet_length("content").alias("plain"))
    return sizes.join(checked, "file_id").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("plain").alias("plain_bytes"), F.sum("n_blocks").alias("n_blocks"), F.bool_and("crc_ok").alias("crc_ok"), F.bool_and("text_equal").alias("text_equal"))
