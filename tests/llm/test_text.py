"""Tokens, pieces, pages, archives, media and mixing."""

import gzip
import hashlib
import html
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.llm import media, mixing, pages, pieces, records, warc, wordbpe
from blockloom.llm.common import spans
from tests.llm.conftest import SF

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


STRANGE = "abTHe  éÉßñ'’st\n\t.,!?;:12漢̈ ​🙂\x1c\x85_-İΣς▁　ﬁqz"


def strange(n, longest):
    r = random.Random(n)
    return ["".join(r.choice(STRANGE) for _ in range(r.randint(0, longest))) for _ in range(n)]


# --- records


@pytest.mark.parametrize("size", [1 << 20, 1000, 64])
def test_word_encoding_is_the_library_s(tok, texts, monkeypatch, size):
    monkeypatch.setattr(wordbpe, "SLICE", size)
    monkeypatch.setattr(wordbpe, "KNOWN_PARTS", 400_000 if size > 64 else 300)
    t = ["x" * 7000, "a" * 64 + " " + "b" * 65, "<|endoftext|>", "foo<|startoftext|>bar it's don't 12345 %%%&&& Ünïcödé × ÷ ªº ȺǅΩİı", *strange(3000 if size > 1000 else 300, 30), "", *(list(texts.values()) if size > 1000 else [])]
    encoder = wordbpe.WordEncoder(WORDS)
    for some in (t, t[::-1]):
        ids, n = encoder.encode(*spans(pa.array(some)))
        want = [x.ids for x in tok.encode_batch(some, add_special_tokens=False)]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert encoder.encode(*spans(pa.array([], pa.string())))[0].tolist() == []


def test_merges_rebuild_every_piece(tok):
    """Each merge's product, cut into bytes, merges back to itself: merges by rank have no dead ends."""
    encoder = wordbpe.WordEncoder(WORDS)
    letters = wordbpe._byte_letters()
    back = {v: k for k, v in letters.items()}
    pieces_ = [(i, bytes(back[c] for c in p.removesuffix("</w>"))) for p, i in tok.get_vocab().items() if p.endswith("</w>") and p != "</w>"]
    for n in {len(p) for _, p in pieces_}:
        some = [(i, p) for i, p in pieces_ if len(p) == n]
        for who, ids in encoder.merges.rows(np.frombuffer(b"".join(p for _, p in some), np.uint8).reshape(-1, n)):
            for w, row in zip(who.tolist(), ids.tolist(), strict=True):
                p = some[w][1]
                assert row == [t.id for t in tok.model.tokenize("".join(letters[b] for b in p))]


def test_frames():
    data = records.frame(b"abc") + records.frame(b"") + records.frame(b"x" * 300)
    a, at = records.unframe(data, 0)
    b, at = records.unframe(data, at)
    c, at = records.unframe(data, at)
    assert (a, b, c, at) == (b"abc", b"", b"x" * 300, len(data))
    for i in (0, 9, 13, 15):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad), 0)
    with pytest.raises(ValueError):
        records.unframe(data[:-1], len(records.frame(b"abc")) + 16)


def stored(df, tok):
    want, start = {}, 0
    for r in sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u2").tobytes())):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.setdefault(r.doc_id, []).append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return want


def got_rows(rows):
    out = {}
    for r in rows.select("doc_id", "start", F.octet_length("ids") / 4, F.crc32("ids")).collect():
        out.setdefault(r[0], []).append((r[1], int(r[2]), r[3]))
    return {k: sorted(v) for k, v in out.items()}


def test_records_over_several_files(docs, tok, monkeypatch):
    monkeypatch.setattr(records.plan_files, "__defaults__", ("doc_id", "text", 60_000))
    manifest = records.encode_and_store(docs, WORDS)
    assert manifest.count() > 3
    assert got_rows(records.read(manifest)) == stored(docs, tok)
    row = manifest.orderBy("bucket").collect()[1]
    first = [r for r in stored(docs, tok).values() if r[0][0] == row.start][0][0]
    assert zlib.crc32(records.read_record(row.path, 0).astype("<u4").tobytes()) == first[2]


def test_records_odd_rows(odd, tok):
    assert got_rows(records.read(records.encode_and_store(odd, WORDS))) == stored(odd, tok)
    assert records.read(records.encode_and_store(odd.where("false"), WORDS)).count() == 0


# --- pieces


def test_pieces_are_the_library_s(sp, texts):
    v = pieces.vocabulary(PIECES)
    for t in strange(2000, 40) + list(texts.values()):
        ids = np.frombuffer(pieces.encode_text(v, t), "<u4")
        assert ids.tolist() == sp.encode(t)
        assert pieces.decode_ids(v, ids) == t.replace("▁", " ")


@pytest.mark.parametrize("letters,chunk", [(STRANGE, 16), ("etaoinshr", 20), ("▁ a", 17), ("th" * 3 + "e", 24), ("the ing and  er ", 33)])
def test_chunks_scan_to_the_same(sp, letters, chunk):
    v, r = pieces.vocabulary(PIECES), random.Random(chunk)
    for _ in range(60):
        text = "".join(r.choice(letters) for _ in range(r.randint(1, 300)))
        n, rows, parts = v.normalise(text), [], []
        for k in range(0, len(n), chunk):
            lo = max(0, k - 64)
            s, a = n[lo : lo + chunk + 128], k - lo
            b = min(len(n) - lo, a + chunk)
            parts.append((s, a, b))
            ins, outs, m = pieces.chunk_matrix(v, s, a, b)
            rows.append((k // chunk, [(p - a, q - a) for p, q in ins], [(p - b, q - b) for p, q in outs], m))
        ids = b"".join(pieces.chunk_pieces(v, s, a, b, (e[0] + a, e[1] + a), (f[0] + b, f[1] + b)) for (s, a, b), (_, e, f) in zip(parts, pieces._scan(rows), strict=True))
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(text)


def test_products_of_matrices_associate():
    r = np.random.default_rng(1)
    a, b, c = (np.where(r.random(s) < 0.5, -np.inf, r.integers(-5, 5, s).astype(float)) for s in ((3, 4), (4, 5), (5, 2)))
    assert np.array_equal(pieces.compose(pieces.compose(a, b), c), pieces.compose(a, pieces.compose(b, c)))


def test_pieces_odd_rows(odd, sp):
    for chunk in (pieces.CHUNK, 50):
        out = pieces.decode(pieces.encode(odd, PIECES, chunk=chunk), PIECES)
        assert out.columns.count("ids") == out.columns.count("decoded") == 1
        rows = out.collect()
        assert len(rows) == odd.count()
        for r in rows:
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == sp.encode(r.text or "")
            assert r.decoded == (r.text or "").replace("▁", " ")
    a, b = (sorted(map(str, pieces.digest(odd, PIECES, chunk=c).collect())) for c in (pieces.CHUNK, 50))
    assert a == b and len(a) == odd.count()
    assert pieces.digest(odd.where("false"), PIECES).count() == 0


# --- pages


def test_pages_of_the_table(spark):
    p = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in pages.extract(p).collect()}
    for r in p.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = (html.unescape(re.sub(r"<[^>]*>", "", x)) for x in re.split(r"</?(?:p|h\d|br)[^>]*>", inner))
        want = "\n".join(x for x in (" ".join(y.split()) for y in parts) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def text_of(page):
    return [t for k, t in pages.blocks(page) if k == pages.MAIN]


def test_markup():
    assert text_of("<article><header><h1>Title</h1></header><p>a &amp; b&nbsp; c &#8364; &copy</p><p class='ad-box'>buy</p><p>d<i>e</i>f<br>g<aside>no</aside><footer>no</footer></article><p>no") == ["Title", "a & b c € ©", "def", "g"]
    assert text_of("<main><nav><ul><li>x</nav><ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table><form>f</form><script>if (a<b) '</p>'</script><!-- <p>c</p> --><pre> z \n z</pre></main>") == ["one", "two", "1 2", "3", "z z"]
    assert text_of("<article>5 < 6 and 7 <b>8</b><div class=comments><article>hi</article></div><div hidden>h</div><div style='display: none'>n</div>end") == ["5 < 6 and 7 8", "end"]
    assert [t for k, t in pages.blocks("<div class='site-header'>Site</div><div id=masthead>x</div><div class=body>y</div>") if k == pages.OPEN] == ["y"]
    assert text_of("<article><div class='entry-header'><h1>T</h1></div>z</article>") == ["T", "z"]
    assert pages.blocks(None) == pages.blocks("") == [] and text_of("<article><p>cut &am") == ["cut &am"]


@pytest.mark.parametrize("odd", ["<svg width='1'/>", "<svg viewBox='0 0 1 1'><path d=''/></svg>", "<svg><svg/><text>n</text></svg>", "<datalist id=x><option value=1><option>n</datalist>", "<select><option>n<option>n</select>", "<video-player src=x></video-player>", "<title-bar></title-bar>", "<video src=x>", "<object data=x>", "<iframe src=x>", "<iframe src=x />", "<script src='x'/>", "<audio src=x><p>n</audio>", "<option>n<option>n", "<noscript><p>n</p></noscript>"])
def test_markup_that_hides_no_more_than_itself(odd):
    body = f"<p>one</p>{odd}<p>two</p><p>three <b>four</b></p><video>n</video>"
    assert text_of(f"<article>{body}</article><svg></svg><iframe></iframe>") == ["one", "two", "three four"]
    assert [t for k, t in pages.blocks(f"<div>{body}</div>")] == ["one", "two", "three four"]


def test_names_are_whole():
    for kept in ("<h2 id=related-work>x</h2>", "<section id=social-policy>x</section>", "<p id=notice-period>x</p>", "<h2 id=comments>x</h2>", "<div class=market-share>x</div>", "<div class='no-sidebar'>x</div>", "<div class=section id=related>x</div>", "<p class='legal-notice-text'>x</p>"):
        assert text_of(f"<article>{kept}<p>y</p></article>") == ["x", "y"], kept
    for gone in ("<div class='big ad-box'>x</div>", "<div class=related-posts>x</div>", "<ul class=social_share>x</ul>", "<div id=comments>x</div>", "<div class=widget-12>x</div>", "<section class=comments-area>x</section>", "<div class='cookie-notice'>x</div>", "<div class=wp-sidebar>x</div>"):
        assert text_of(f"<article>{gone}<p>y</p></article>") == ["y"], gone
    assert text_of("<article><p>a<object><article><p>n</article></object>b<video></article>c</video>") == ["ab"]


def test_repeats_without_a_main_element(spark):
    shared = "this line of many words stands on every page of the host"
    rows = [(i, f"http://h{i % 2}.example/{i}", f"<body><div>{shared}</div><div>unique{i} words {i} of page {i} here</div><nav>menu {i}</nav></body>") for i in range(8)]
    rows += [(100, "http://alone.example/", f"<body><div>{shared}</div></body>")]
    out = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert out[i].text == f"unique{i} words {i} of page {i} here" and out[i].n_repeated >= 12
    assert out[100].text == shared and out[100].n_repeated == 0


def test_copies_and_quotations_without_a_main_element_stay(spark):
    r = random.Random(4)
    prose = lambda n: " ".join(r.choice(("ka", "lo", "mi", "nu", "re")) + str(r.randint(0, 9999)) for _ in range(n))
    menu, quote, small = prose(12), prose(20), ["Home", "About us", "Our contact data"]
    article = [prose(40) for _ in range(5)]
    bodies = [[*article, f"read {i} times"] for i in range(5)]  # near copies, as of ?utm_source=
    bodies += [article, article]
    bodies += [[prose(60), f"{prose(9)} {quote} {prose(9)}", *([quote] if i < 2 else [])] for i in range(8)]
    page = lambda parts: "<body>" + "".join(f"<div>{x}</div>" for x in (menu, *small, *parts)) + "</body>"
    rows = [(i, f"http://h.example/a?utm_source={i}", page(b)) for i, b in enumerate(bodies)]
    rows += [(90 + i, f"http://two.example/?page={i}", page(article)) for i in range(2)]
    out = {x.page_id: x.text for x in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, b in enumerate(bodies):
        assert out[i] == "\n".join(b)
    assert out[90] == out[91] == "\n".join([menu, *small, *article])


def test_names_and_implied_ends():
    body = "<article><p>x</p>%s<p>y</p></article>"
    for gone in ("<ul><li class='ad'><div>Buy now</div></ul>", "<table><tr><td class='advert'><p>Buy now</p></td></tr></table>", "<ol class=commentlist><li><p>c</p><li>d</ol>", "<ins class=adsbygoogle>ad</ins>", "<div class=author-bio><p>b</p></div>"):
        assert text_of(body % gone) == ["x", "y"], gone
    assert text_of(body % "<ul><li class=ad><p>buy<li>keep<ul><li>in</ul><li>last</ul>") == ["x", "keep", "in", "last", "y"]
    assert text_of(body % "<dl><dt class=ad>no<dd>d<dt>t</dl><table><tr><td class=ad>no<td>1<tbody><tr><th>2</table>") == ["x", "d", "t", "1", "2", "y"]
    assert text_of(body % "<p>one <label>two</label> three") == ["x", "one two three", "y"]
    for kept in ("<div class='content has-menu'>", "<div class=sidebar>", "<section id=related>"):
        assert text_of(f"{kept}<article><p>x</p></article>") == ["x"], kept
    assert text_of("<div class=related><article>no</article></div><article>x<div class=ad>a</div></article>") == ["x"]


def test_suffix_array_equals_all_substrings(spark):
    """n_repeated and n_outside against every window of every page, on hosts of few distinct words."""
    r = random.Random(11)
    rows = []
    for i in range(60):
        words_ = [r.choice("abc") if r.random() < 0.8 else f"u{i}" for _ in range(r.choice((0, 1, 3, 5, 6, 9, 40)))]
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<nav>{' '.join(words_)}</nav><article>t{i}</article>"))
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    streams = {i: pages.stream(pages.blocks(h))[0] for i, _, h in rows}
    want = {}
    for i, words_ in streams.items():
        under, n = set(), min(6, len(words_))
        for at in range(len(words_) - n + 1 if words_ else 0):
            part = words_[at : at + n]
            for j, others in streams.items():
                if j != i and j % 3 == i % 3 and ((len(words_) < 6 and others == part) or (n == 6 and any(others[k : k + 6] == part for k in range(len(others) - 5)))):
                    under.update(range(at, at + n))
        want[i] = (len(words_), len(under))
    assert 0 < sum(u for _, u in want.values()) < sum(n for n, _ in want.values())
    for n in (1, 9):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {x.page_id: (x.n_outside, x.n_repeated) for x in pages.extract(d.repartition(4)).collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_longest_repeats_by_hand():
    r = np.random.default_rng(2)
    for _ in range(200):
        rows = np.unique(r.integers(1, 3, (r.integers(1, 12), 5)).astype(np.uint32) * (np.arange(5) < r.integers(2, 6)), axis=0)
        a = r.integers(0, 3, len(rows))
        b = np.maximum(a, np.where(r.random(len(rows)) < 0.2, 3, a))
        got = pages.longest_repeats(np.zeros(len(rows), np.int64), rows, a, b)
        for i, x in enumerate(rows):
            size = int((x != 0).sum())
            want = size if a[i] != b[i] else max([0, *(min(size, int(np.cumprod((x == y) & (x != 0)).sum())) for j, y in enumerate(rows) if (a[j], b[j]) != (a[i], b[i]))])
            assert got[i] == want


def test_pages_odd_rows(spark):
    rows = [(1, None, None, 1), (2, "u", "", 2), (None, "http://x/", "<article>a</article>", 3), (3, "http://x/", "<article>a</article>", 3), (3, "http://x/", "<article>a</article>", 3), (4, "not a url", "<p>" + "long words " * 20_000, 4), (5, "http://x/", "<" * 500 + "article a='", 5)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, page int").withColumns({"host": F.lit(1), "blocks": F.lit(2), "at": F.lit(3)})
    got = pages.extract(d).collect()
    assert len(got) == len(rows) and sorted(r.text for r in got)[:2] == ["", ""]
    assert [r.text for r in got if r.page_id in (None, 3)] == ["a", "a", "a"]
    assert pages.extract(d.where("false")).count() == 0


# --- archives


def test_archive_links_and_digests(spark):
    p = spark.read.parquet(f"{SF}/pages.parquet")
    derived = warc.derivatives(warc.responses(p))
    rows = warc.digest(derived).collect()
    assert len(rows) == p.count() and all(r.linked and r.refers_to == r.response_id for r in rows)
    assert len({i for r in rows for i in (r.response_id, r.metadata_id, r.conversion_id)}) == 3 * len(rows)
    source = {r.page_id: r.html for r in p.collect()}
    for r in rows:
        assert r.payload_digest == warc.sha1(source[r.page_id].encode()) and r.outlinks == source[r.page_id].count("<a href")
    one = derived.first()
    for data in (one.warc, one.derived):
        for at in (0, 40, len(data) // 2, len(data) - 6):
            bad = bytearray(data)
            bad[at] ^= 0x55
            try:
                assert warc.parse(bytes(bad)) != warc.parse(bytes(data))
            except ValueError:
                pass


def test_archive_odd_rows(spark):
    rows = [(1, None, None), (None, "u\r\nInjected: x", "<title>a\r\nb</title>é"), (2, "u", ""), (2, "u", ""), (3, "u", "<p>x" * 20_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"warc": F.lit("clash"), "derived": F.lit("clash")})
    out = warc.digest(warc.derivatives(warc.responses(d))).collect()
    assert len(out) == 5 and all(r.linked for r in out)
    assert [r.title for r in out if r.page_id is None] == ["a b"]
    assert warc.derive(b"") == b"" and warc.derivatives(warc.responses(d.where("false"))).count() == 0
    assert warc.plain_text("<p>a</p><script>x</script>b<br>c &lt;d&gt;") == "a\nb\nc <d>"


def http(body, *lines):
    return b"\r\n".join([b"HTTP/1.1 200 OK", *lines, b"", b""]) + body


def test_archive_of_real_shapes():
    """Chunked, compressed and other charsets; gzip members; what plain text keeps apart."""
    page = "<html lang=fr><title>T</title><table><tr><td>caf\xe9<td>b</table><select><option>x<option>y</select></html>"
    made = {
        "chunked": http(b"5;a=b\r\n" + page.encode()[:5] + b"\r\n%x\r\n" % (len(page.encode()) - 5) + page.encode()[5:] + b"\r\n0\r\n\r\n", b"Transfer-Encoding: chunked", b"Content-Type: text/html; charset=UTF-8"),
        "latin": http(page.encode("latin-1"), b"content-type:text/html;charset=ISO-8859-1"),
        "meta": http(b"<meta charset=iso-8859-1>" + page.encode("latin-1")),
        "gzip": http(gzip.compress(page.encode()), b"Content-Encoding: gzip"),
        "deflate": http(zlib.compress(page.encode())[2:-4], b"Content-Encoding: deflate"),
        "unknown": http(page.encode(), b"Content-Type: text/html; charset=no-such"),
    }
    for name, message in made.items():
        one = warc.record("response", f"<urn:{name}>", [("WARC-Target-URI", "http://x/")], message)
        for data in (one, gzip.compress(one), gzip.compress(one) + gzip.compress(one)):
            meta, conversion = warc.parse(warc.derive(data))[:2]
            assert conversion[1].decode() == "T\ncaf\xe9 b\nx y", name
            assert b"language: fr" in meta[1] and conversion[0]["warc-refers-to"] == f"<urn:{name}>"


def test_archive_errors_are_rows(spark):
    good = warc.response("1", "http://x/", "<p>a</p>")
    bad = [b"junk", good[:-3], good.replace(b"Content-Length: ", b"Content-Length: x", 1), good.replace(b"WARC-Record-ID", b"WARC-Other-ID", 1), gzip.compress(good)[:-9], gzip.compress(good) + b"tail", good.replace(b"<p>a", b"<p>b")]
    d = spark.createDataFrame([(i, x) for i, x in enumerate([good, None, b"", *bad])], "i int, warc binary")
    rows = sorted(warc.derivatives(d.withColumn("error", F.lit(1))).collect())
    assert [r.error is None for r in rows] == [True] * 3 + [False] * len(bad)
    assert all((r.derived is None) == (r.error is not None) for r in rows) and len(warc.parse(bytes(rows[0].derived))) == 2
    assert warc.parse(warc.record("resource", "<a>", [("WARC-Block-Digest", "md5:x")], b"b"))


# --- media


def png():
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0\0")) + part(b"IEND", b"")


MEDIA = {
    "png": png(),
    "wav": media.to_wav(b"\x80" * 99),
    "gif": b"GIF89a\1\0\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;",
    "jpeg": b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x02scan\xff\xd9",
    "bmp": b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0",
    "pdf": b"%PDF-1.4 body %%EOF",
    "mp4": struct.pack(">I4s8s", 16, b"ftyp", b"isom\0\0\0\1") + struct.pack(">I4s", 8, b"free"),
    "ogg": b"OggS\0\2" + b"\0" * 20 + b"\1\5hello",
    "flac": b"fLaC\x80\0\0\x22" + b"\0" * 34 + b"frames",
}


@pytest.mark.parametrize("kind", MEDIA)
def test_each_format(kind):
    data = MEDIA[kind]
    assert (kind, 0, len(data)) in media.carve(data)
    if kind not in ("flac",):
        assert (kind, 7, len(data)) in media.carve(b"1234567" + data + b"tail")
    assert not [x for x in media.carve(data[: len(data) // 2]) if x[0] == kind and x[1] == 0 and kind not in ("ogg", "flac", "mp4")]


def test_carving_is_linear_and_takes_streams_whole():
    for data, n in ((MEDIA["ogg"] * 3000, 1), (b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x02" * 15_000, 0), (b"%PDF-1" * 30_000, 0), (MEDIA["png"] * 500, 500), (MEDIA["gif"] * 2000, 2000)):
        t = time.time()
        found = media.carve(data)
        assert len(found) == n and sum(x[2] for x in found) <= len(data) and time.time() - t < 2
    both = MEDIA["pdf"][:9] + MEDIA["png"] + b"%%EOF"
    assert [x[0] for x in media.carve(both)] == ["pdf", "png"]


def test_sniffing_corrects_types(spark):
    rows = [(b, "image/gif") for b in MEDIA.values()] + [(None, "image/png"), (b"", None), (b"BM only text that says RIFF", "text/plain"), (b"xx" + MEDIA["png"] + MEDIA["gif"], "text/plain")]
    d = spark.createDataFrame(rows, "media binary, said string").withColumns({"sniffed": F.lit("clash"), "carved": F.lit(1)})
    out = media.sniff(d, "media", "said").collect()
    assert [r.sniffed for r in out] == [*MEDIA, "unknown", "unknown", "unknown", "unknown"]
    assert [r.corrected for r in out] == [k != "gif" for k in MEDIA] + [False] * 4
    assert [(c.type, c.start) for c in out[-1].carved] == [("png", 2), ("gif", 2 + len(MEDIA["png"]))]


def test_media_round_trip(spark, odd, texts, docs):
    rows = media.digest(media.text_media(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = media.padded(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id].encode()), len(raw)) and len(raw) % 64 == 0
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.to_wav(raw)).hexdigest() and r.media_bytes == len(raw) + 44 and r.sniffed == "wav"
    out = media.digest(media.text_media(odd)).collect()
    assert len(out) == odd.count() and all(r.payload_bytes == 64 for r in out if r.doc_id in (4, 5))
    assert media.digest(media.text_media(odd.where("false"))).count() == 0


# --- mixing


def level(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_targets(spark):
    for sizes in ({"a": 10, "b": 20, "c": 30}, {"a": 1, "b": 1000, "c": 1, "é": 0, None: 50}, {"x": 5}, {str(i): i * i for i in range(20)}):
        d = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(d).collect()}
        want = level(sizes)
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mix_meets_targets_and_limits(docs):
    a, b = (mixing.mix(docs).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert a.equals(b) and len(a) == docs.count()
    want = level(a.groupby("source")["size"].sum().to_dict())
    for s, g in a.groupby("source"):
        assert abs(g.target.iloc[0] - want[s]) < 1e-6 and g.source_size.iloc[0] == g["size"].sum()
        assert abs(g.taken.sum() - want[s]) <= 64 + 0.01 * want[s]
        assert (g.taken <= 3 * g["size"]).all()


def test_schedule_is_the_mix_by_hand(docs):
    """Blocks, their order and what is taken of each document, walked point by point."""
    rows = mixing.schedule(docs).collect()
    mixed = {r.doc_id: r for r in mixing.mix(docs).collect()}
    by_slot, taken = {}, {}
    for r in rows:
        by_slot.setdefault(r.slot, []).append(r)
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.words
        assert 0 <= r.first_word and r.words > 0 and r.first_word + r.words <= mixed[r.doc_id]["size"]
    assert all(taken.get(k, 0) == m.taken for k, m in mixed.items())
    sizes = {m.source: m.source_size for m in mixed.values()}
    wanted = {m.source: m.target for m in mixed.values()}
    names = sorted(sizes, key=lambda s: (s is None, s))
    blocks = {s: -(-sizes[s] // 128) for s in names}
    count = {s: min(round(wanted[s] * blocks[s] / sizes[s]), 3 * blocks[s]) for s in names}
    total, ends = sum(count.values()), {}
    for s in names:
        ends[s] = (sum(ends[x][1] - ends[x][0] for x in ends), sum(ends[x][1] - ends[x][0] for x in ends) + count[s])
    done = dict.fromkeys(names, 0)
    for k in range(int(total * 1.02) + 64):
        x = k * mixing.GOLDEN % 1.0 * total
        s = next((s for s in names if ends[s][0] <= x < ends[s][1]), None)
        if s is not None and done[s] < count[s]:
            assert {(r.source, r.block) for r in by_slot[k]} == {(s, done[s] % blocks[s])}
            done[s] += 1
    assert len(by_slot) == total
    for part in by_slot.values():  # a block's words are whole and of about one size
        assert abs(sum(r.words for r in part) - sizes[part[0].source] / blocks[part[0].source]) <= 1
    order = [by_slot[k][0].source for k in sorted(by_slot)][: total // 2]
    assert all(abs(order.count(s) / len(order) - count[s] / total) < 0.05 for s in names)


def test_mix_sizes_are_words(docs, texts):
    for r in mixing.mix(docs).collect():
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id]))


def test_mix_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.taken == 0 for r in rows if r["size"] == 0) and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert mixing.mix(odd.where("false")).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(odd.where("doc_id in (4, 5)")).collect())


def test_mix_runs_no_python(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
