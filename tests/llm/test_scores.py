"""Language model against a dictionary version, quality on held-out labels."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from blockloom.llm import lm, quality
from blockloom.llm.common import spans
from blockloom.llm.lm import score
from tests.llm.conftest import SF


def brute(texts, order, priors, mod=7):
    tok = {k: (t or "").encode().lower().split() + [None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % mod == 2 for k in tok}
    grams = collections.Counter()  # of every length, by tuple; <s> counts as a context
    for k, w in tok.items():
        if not held[k]:
            seen = ["<s>", *w]
            for n in (1, 2, 3):
                grams.update(zip(*(seen[i:] for i in range(n)), strict=False))
    n, v = sum(c for g, c in grams.items() if len(g) == 1 and g != ("<s>",)), sum(len(g) == 1 and g != ("<s>",) for g in grams)
    out = {}
    for k, w in tok.items():
        seen, base, score_ = ["<s>", *w], 0, 0
        for i in range(1, len(seen)):
            p = (grams[(seen[i],)] + 1) / (n + v + 1)
            base += math.log10(p)
            for m in range(1, order):
                if i >= m:
                    context = tuple(seen[i - m : i])
                    p = (grams[(*context, seen[i])] + priors[m - 1] * p) / (grams[context] + priors[m - 1])
            score_ += math.log10(p)
        out[k] = (held[k], len(w), sum(grams[(x,)] > 0 for x in w), n, base, score_)
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_lm_equals_brute_force_in_any_blocks(spark, docs, texts, order):
    want = brute(texts, order, lm.PRIORS)
    for how in ({}, {"block_tokens": 500, "range_ngrams": 300}):
        got = {r.doc_id: r for r in score(docs, order=order, **how).collect()}
        assert got.keys() == want.keys()
        for k, w in want.items():
            r = got[k]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
            assert abs(r.base_score - w[4]) < 1e-6 and abs(r.score - w[5]) < 1e-6
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_traversal_in_stretches_and_sums_to_one():
    """Any stretch gives the same; from a state, the probabilities of all words and of an unknown one sum to 1."""
    texts_ = [b"a b a b a c", b"", b"a b a d", b"b a b a b a b a"]
    words, tokens, sizes = {}, [], []
    for t in texts_:
        w = t.split()
        tokens += [words.setdefault(x, len(words)) for x in w]
        sizes.append(len(w))
    b = lm.Block(bytes(4), lm.pack(np.array(sizes, np.uint32)), lm.pack(np.array(tokens, np.uint32)), np.arange(1, len(words) + 1, dtype=np.uint64).tobytes(), 3)
    counts = b.word_counts(), b.bigram_counts(), b.trigram_counts()
    n, v = int(counts[0][:-1].sum()), int((counts[0][:-1] > 0).sum())
    auto = lm.Automaton(b, *counts, n, v, (0.7, 1.3))
    assert all(np.allclose(auto.traverse(k), auto.traverse(99)) for k in (1, 2, 3, 5))
    a, bb = words[b"a"], words[b"b"]
    pair = int(np.searchsorted(b.bigram, a * b.w + bb))
    everyone = np.arange(b.w - 1)
    total = np.zeros(b.w - 1)
    find = lambda keys, key: np.where(np.isin(key, keys), np.searchsorted(keys, key), -1)
    trigram, bigram = find(b.trigram, pair * b.w + everyone), find(b.bigram, bb * b.w + everyone)
    auto.has3, auto.is2 = np.append(auto.has3, False), np.append(auto.is2, False)  # place -1: no such arc
    auto.arc3, auto.arc2 = np.append(auto.arc3, 0), np.append(auto.arc2, 0)
    auto.step(everyone, trigram, bigram, np.full(b.w - 1, pair), np.full(b.w - 1, bb), total)
    unknown = auto.fail3[pair] + auto.fail2[bb] + math.log10(1 / (n + v + 1))
    assert abs((10**total).sum() + 10**unknown - 1) < 1e-9


def test_words_and_numbers_in_bulk():
    texts_ = ["", "Ab aB\x0bÀ ", " x", "y\x1cz " + "long" * 9 + " longlong", None, "ab", "q" * 40, "b a"] * 3
    prints, counts = lm.word_prints(*spans(pa.array(texts_)))
    want = [w for t in texts_ for w in (t or "").encode().lower().split()]
    assert counts.tolist() == [len((t or "").encode().split()) for t in texts_]
    names = dict(zip(want, prints.tolist(), strict=True))
    assert [names[w] for w in want] == prints.tolist() and len(set(names.values())) == len(names)
    r = np.random.default_rng(3)
    keys = r.integers(0, 50, 400)
    for top in (50, 1 << 62):
        k, at, of = lm.numbered(keys, top)
        assert k.tolist() == sorted(set(keys.tolist())) and (keys[at] == k).all() and (k[of] == keys).all()
    words, of = lm.first_seen(prints)
    assert (words[of] == prints).all() and of[0] == 0
    h = r.integers(0, 1 << 63, 1000).astype(np.uint64)
    assert sorted(lm.in_order(h)) == list(range(1000)) and (np.diff(h[lm.in_order(h)].astype(float)) >= -(2.0**11)).all()


def test_lm_odd_rows(odd):
    rows = score(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id in (4, 5, 6):
            assert r.n_tokens == 1
        assert r.score <= 0 and r.base_score <= 0 and math.isfinite(r.score)
    assert not [r for r in rows if r.doc_id is None][0].held_out
    assert score(odd.where("false")).count() == 0


def test_statistics_do_not_depend_on_neighbours(texts):
    t = [*texts.values(), "", None, "a", "!!", "\n\n", "x " * 1000]
    together = quality.statistics(*spans(pa.array(t)))
    alone = np.concatenate([quality.statistics(*spans(pa.array([x], pa.string()))) for x in t])
    assert np.allclose(together, alone) and np.isfinite(together).all()
    sliced = quality.statistics(*spans(pa.array(t)[3:9]))
    assert np.allclose(sliced, together[3:9])


def plain_statistics(text):
    """The statistics one by one, byte by byte."""
    b = (text or "").encode()
    if not b:
        return [0.0] * len(quality.FEATURES)
    n = len(b)
    is_up, is_low, is_digit = (lambda c: 65 <= c <= 90), (lambda c: 97 <= c <= 122), (lambda c: 48 <= c <= 57)
    is_space, is_high = (lambda c: c == 32 or 9 <= c <= 13), (lambda c: c >= 128)
    is_punct, is_symbol = (lambda c: c in b".,;:'\"()-?"), (lambda c: c in b"!#$%&*+/<=>@[\\]^_`{|}~")
    count = lambda f, x=b: sum(map(f, x))
    share = lambda a, c: a / max(c, 1)
    words, lines = re.split(rb"[\x20\x09-\x0d]+", b), b.split(b"\n")
    words = [w for w in words if w]
    some = lambda line: min(len(line) - count(is_space, line), 12) / 12
    letters = count(is_up) + count(is_low) + count(is_high)
    again = [i > 0 and words[i] == words[i - 1] for i in range(len(words))]
    near = [i > 1 and words[i] == words[i - 2] and not again[i] for i in range(len(words))]
    in_line = []  # of each word: its line
    for i, line in enumerate(lines):
        in_line += [i] * len([w for w in re.split(rb"[\x20\x09-\x0d]+", line) if w])
    solid = [len(line) - count(is_space, line) for line in lines]
    worst = lambda f: max(map(f, range(len(lines))))
    per_line = [sum(j == i for j in in_line) for i in range(len(lines))]
    again_in = [sum(a for a, j in zip(again, in_line, strict=True) if j == i) for i in range(len(lines))]
    return [
        math.log1p(n), math.log(len(lines)), share(sum(map(len, words)), len(words)), share(sum(len(w) > 14 for w in words), len(words)), share(count(is_up), letters), share(count(is_digit), n), share(count(is_symbol), n),
        share(sum(is_space(b[i]) and is_space(b[i - 1]) for i in range(1, n)) + is_space(b[-1]), n), share(count(is_punct), n), share(count(is_low) + count(is_up), letters),
        worst(lambda i: share(count(is_up, lines[i]), count(is_up, lines[i]) + count(is_low, lines[i])) * some(lines[i])), worst(lambda i: share(count(is_symbol, lines[i]), solid[i]) * some(lines[i])), worst(lambda i: share(lines[i].count(b"|"), solid[i]) * some(lines[i])),
        share(sum(count(is_symbol, w) > 0 for w in words), len(words)), share(sum(count(is_up, w) > 1 and count(is_low, w) == 0 for w in words), len(words)),
        share(sum(b[i] == b[i - 1] and not is_space(b[i]) and not is_low(b[i]) for i in range(1, n)), n), share(sum(0 < k < 20 for k in solid), len(lines)), share(count(lambda c: c in b"aeiouAEIOU"), letters),
        share(sum(again), len(words)), share(sum(near), len(words)), worst(lambda i: share(again_in[i], per_line[i]) * min(per_line[i] / 6, 1)),
    ]


def test_statistics_equal_plain_ones(texts):
    t = [*list(texts.values())[:60], "", "a", "!!", "\n\n", "x x x  y y\nA|B|C|D|E|F|G|H|I", " lead AND  Trail ", "é è é 11 22!!", "the the the the the the\nshort\n\n end"]
    got = quality.statistics(*spans(pa.array(t)))
    for text, row in zip(t, got, strict=True):
        assert dict(zip(quality.FEATURES, row.round(9), strict=True)) == dict(zip(quality.FEATURES, np.round(plain_statistics(text), 9), strict=True)), text[:60]


def test_discriminant_equals_densities():
    """Scores against Gaussian log densities by inverse and determinant."""
    r = np.random.default_rng(0)
    x = np.abs(r.normal(size=(300, len(quality.FEATURES)))) * (1 + np.arange(300)[:, None] % 2)
    m = quality.QDA.fit(x, np.arange(300) % 2)
    z = np.clip((np.sqrt(x) - m.mean) / m.std, -8, 8)
    ll = [-0.5 * np.einsum("ij,jk,ik->i", z - mu, np.linalg.inv(cov), z - mu) - 0.5 * np.linalg.slogdet(cov)[1] for mu, cov in m.classes]
    want = 1 / (1 + np.exp(-(m.scale * np.arcsinh(ll[1] - ll[0] + m.prior) + m.shift)))
    assert np.allclose(m.score(x), want)


def test_quality_fit_is_bounded(spark):
    """A labelled key on many rows counts once."""
    d = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "good prose here."), (3, "!!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    model = quality.fit(d, labels)
    assert np.isfinite(model.score(np.zeros((1, len(quality.FEATURES))))).all()


def test_quality_on_held_out_labels(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").toPandas()
    held = scored[[zlib.crc32(str(k).encode()) % 4 == 2 for k in scored.doc_id]]
    assert ((held.score >= 0.7) == (held.quality == 1)).mean() > 0.97
    assert scored.score.between(0, 1).all()


def test_quality_odd_rows(spark, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    out = quality.score(odd, model)
    rows = out.collect()
    assert out.columns.count("score") == 1 and len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    again = quality.QDA.from_json(model.to_json())
    x = quality.statistics(*spans(pa.array(["some text", ""])))
    assert np.allclose(again.score(x), model.score(x))
    for none in (labels.where("false"), labels.where("quality = 1"), spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, quality int")):
        s = quality.score(odd, quality.fit(odd, none)).collect()
        assert all(0 <= r.score <= 1 for r in s)
