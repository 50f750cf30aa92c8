"""The pipeline's stages on the smallest tables."""

import collections

import pytest

import corpus_pipeline
from tests.llm.conftest import SF
from tests.llm.test_pairs import all_pairs, reach, words


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF).write.parquet(f"{d}/{i}")
        docs = spark.read.parquet(f"{d}/{i}")
        out.append(docs)
    return out


def test_stages(spark, stages):
    quality, near, mixed, tokens = stages
    first = spark.read.parquet(f"{SF}/documents.parquet")
    for s in (quality, near, mixed):
        assert sorted(s.columns) == sorted(first.columns)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id: r.text for r in quality.collect()}
    assert all(k in kept for k, q in labels.items() if q == 1) and not any(k in kept for k, q in labels.items() if q == 0)
    found = all_pairs({k: words(t) for k, t in kept.items()})
    comp = reach(kept, [(a, b) for a in found for b in found[a]])
    assert {r.doc_id for r in near.collect()} == set(comp.values())
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= set(comp.values()) and max(copies.values()) <= 3
    rows = tokens.collect()
    assert len(rows) == sum(copies.values()) and all(r.exact for r in rows)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[-1].collect()))


def test_mix_repeats_rows_not_keys(spark):
    words = " ".join(["word"] * 1280)
    rows = [(None, words, "en", "c", 1), (None, words + " other", "en", "c", 1), (1, words + " long", "en", "a", 1), (1, "short", "en", "a", 1), (2, words + " " + words, "en", "b", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.source_mix(spark, d, SF).collect())
    taken = {}
    for r in corpus_pipeline.mixing.mix(d).where("size > 0").collect():
        taken.setdefault((r.doc_id, r["size"]), r.taken / r["size"])
    for k, text, *_ in rows:
        x = taken[k, len(text.split())]
        assert int(x) <= got[k, text] <= int(x) + 1
    assert all(got[None, text] >= 1 for k, text, *_ in rows if k is None)


def test_stages_on_odd_rows(spark, odd):
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, odd, SF)
        rows = out.collect()
        assert step(spark, odd.where("false"), SF).count() == 0, name
        if name != "SentencePiece":
            assert sorted(out.columns) == sorted(corpus_pipeline.COLUMNS)
        if name == "n-gram Jaccard join":
            assert len(rows) == 10
        if name == "SentencePiece":
            assert len(rows) == odd.count()
