"""Every query against its SQL over the smallest tables; queries without SQL against plain code."""

import glob
import hashlib
import random
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from blockloom.functions import codec
from blockloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def value(x):
    if x is None or x is pd.NA or (isinstance(x, (float, np.floating)) and np.isnan(x)):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.integer, np.floating)):
        return round(float(x), 6)
    return str(x)


def rows(df):
    return sorted(repr(tuple(map(value, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got)


def fold(data, limit):
    """Blocks by a byte-wise greedy fold: a fourth equal byte costs its count byte too, and needs room for both."""
    at, size, run, last, cuts = 0, 0, 0, None, []
    for i, x in enumerate(data):
        run = run + 1 if x == last and run < 259 else 1
        cost = 1 if run < 4 else 2 if run == 4 else 0
        if size + cost > limit:
            cuts.append((at, i))
            at, size, run, cost = i, 0, 1, 1
        size, last = size + cost, x
    return [*cuts, (at, len(data))] if data else []


def test_splits(spark, con):
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    for name, cuts in (("split_sequential", lambda d: fold(d, 1000)), ("split_parallel", lambda d: [(a + lo, b + lo) for lo in range(0, len(d), 1000) for a, b in fold(d[lo : lo + 1000], 1000)])):
        got = sorted(tuple(r) for r in catalog.QUERIES[name](spark, SF).select("doc_id", "block_no", "raw_off", "raw_len", "enc_len").collect())
        want = sorted((k, i, a, b - a, len(codec.rle_encode(t.encode()[a:b]))) for k, t in texts.items() for i, (a, b) in enumerate(cuts(t.encode())))
        assert got == want


@pytest.mark.parametrize("limit", [7, 20, 61, 300])
def test_greedy_blocks_equal_the_fold(limit):
    r = random.Random(limit)
    for _ in range(150):
        data = b"".join(bytes([r.choice(b"ab")]) * r.choice((1, 2, 3, 4, 5, 6, 258, 259, 260, 264, 518, 520)) for _ in range(r.randint(0, 8)))
        assert [c[2:] for c in codec.split_sequential(data, limit)] == fold(data, limit)


def test_rotations_of_documents(spark, con):
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    for r in catalog.rotation_sort_documents(spark, SF).collect():
        enc = codec.rle_encode(texts[r.doc_id].encode())
        twice, n = enc + enc, len(enc)
        order = sorted(range(n), key=lambda i: (twice[i : i + n], i))
        assert r.inverts and r.idx == order.index(0) and r.last_column == hashlib.md5(bytes(enc[i - 1] for i in order)).hexdigest()


def test_prefix_code_against_one_tree(spark, con):
    texts = dict(con.sql("SELECT item_id, text FROM benchmark").fetchall())
    for r in catalog.prefix_code(spark, SF).collect():
        enc = codec.rle_encode(texts[r.item_id].encode())
        used = sorted(set(enc))
        syms = codec.symbols(codec.mtf(codec.bwt(enc)[0], used), len(used))
        one = codec.code_lengths(np.bincount(syms, minlength=len(used) + 2).tolist())
        assert r.n_syms == len(syms) and r.n_groups == -(-len(syms) // 50) and r.max_len <= 20
        assert r.cost_bits <= 1.1 * sum(one[s] for s in syms)


def test_stats_add_up(spark):
    for r in catalog.compression_stats(spark, SF).collect():
        assert r.compr_bytes >= 14 and abs(r.ratio - r.compr_bytes / r.plain_bytes) < 1e-12 and abs(r.ratio + r.savings - 1) < 1e-12


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(r.crc_ok and r.text_equal for r in e.entry(spark).collect())
