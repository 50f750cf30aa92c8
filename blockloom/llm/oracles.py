"""The queries' results in SQL, where SQL can express them."""

from __future__ import annotations

from blockloom.llm.lm import PRIORS

#: crc32 of a blob's hex form, a byte at a time through a table made from the polynomial.
_TABLE = "t AS (SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS tbl FROM range(256) g(n))"


def _crc(hexed: str) -> str:
    return f"xor(list_reduce(list_transform(regexp_extract_all({hexed}, '..'), lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c >> 8, tbl[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295)"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: comp: smallest node reachable over links (a, b), both ways.
_REACH = "comp AS (SELECT n AS k, min(m) AS component_id FROM (WITH RECURSIVE w(n, m) AS (SELECT k, k FROM nodes UNION SELECT l.b, w.m FROM w JOIN links l ON l.a = w.n WHERE w.m < l.b) SELECT * FROM w) GROUP BY n)"

ORACLES = {
    "op1_lm_score": f"""WITH {_TABLE}, d AS (SELECT doc_id, {_crc("hex(encode(CAST(doc_id AS VARCHAR)))")} % 7 = 2 AS held, list_append({_WORDS}, ' ') AS w FROM documents, t),
x AS (SELECT doc_id, held, unnest(range(len(w))) AS pos, unnest(w) AS w, unnest(list_prepend('  ', w[:len(w) - 1])) AS v, unnest(list_prepend(NULL, list_prepend('  ', w[:len(w) - 1])[:len(w) - 1])) AS u FROM d),
uni AS (SELECT w, count(*) AS c FROM x WHERE NOT held GROUP BY w), ctx AS (SELECT v, count(*) AS c FROM x WHERE NOT held GROUP BY v),
bi AS (SELECT v, w, count(*) AS c FROM x WHERE NOT held GROUP BY v, w), tri AS (SELECT u, v, w, count(*) AS c FROM x WHERE NOT held AND u IS NOT NULL GROUP BY u, v, w),
k AS (SELECT sum(c) AS n, count(*) AS vv FROM uni),
p1 AS (SELECT x.*, coalesce(uni.c, 0) AS c, (coalesce(uni.c, 0) + 1.0::DOUBLE) / (k.n + k.vv + 1)::DOUBLE AS root, k.n FROM x LEFT JOIN uni ON uni.w = x.w, k),
p2 AS (SELECT p1.*, (coalesce(bi.c, 0) + {PRIORS[0]}::DOUBLE * root) / (coalesce(ctx.c, 0) + {PRIORS[0]}::DOUBLE) AS two FROM p1 LEFT JOIN bi ON bi.v = p1.v AND bi.w = p1.w LEFT JOIN ctx ON ctx.v = p1.v),
p3 AS (SELECT p2.*, CASE WHEN p2.u IS NULL THEN two ELSE (coalesce(tri.c, 0) + {PRIORS[1]}::DOUBLE * two) / (coalesce(bi.c, 0) + {PRIORS[1]}::DOUBLE) END AS three FROM p2 LEFT JOIN tri ON tri.u = p2.u AND tri.v = p2.v AND tri.w = p2.w LEFT JOIN bi ON bi.v = p2.u AND bi.w = p2.v)
SELECT doc_id, held AS held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, max(n)::BIGINT AS train_tokens, sum(log10(root)) AS base_score, sum(log10(three)) AS score FROM p3 GROUP BY doc_id, held""",
    "op5_near_vectors": f"""WITH RECURSIVE nodes AS (SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), links AS (SELECT a.k AS a, b.k AS b FROM nodes a JOIN nodes b ON a.k <> b.k AND list_cosine_similarity(a.v, b.v) >= 0.95), {_REACH}
SELECT nodes.k AS vec_id, (SELECT count(*) FROM links WHERE a = nodes.k) AS n_links, component_id, component_id = nodes.k AS kept FROM nodes JOIN comp ON comp.k = nodes.k""",
    "op9_media": f"""WITH {_TABLE}, d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents), h AS (SELECT doc_id, octet_length(raw) AS n, greatest(64, (octet_length(raw) + 63) // 64 * 64) AS k, hex(raw) AS x FROM d), e AS (SELECT doc_id, n, k, rpad(x, CAST(2 * k AS INT), '0') AS x FROM h),
le AS (SELECT *, lambda_free.f AS k_le, lambda_free.g AS riff_le FROM (SELECT *, struct_pack(f := substr(printf('%08X', k), 7, 2) || substr(printf('%08X', k), 5, 2) || substr(printf('%08X', k), 3, 2) || substr(printf('%08X', k), 1, 2), g := substr(printf('%08X', k + 36), 7, 2) || substr(printf('%08X', k + 36), 5, 2) || substr(printf('%08X', k + 36), 3, 2) || substr(printf('%08X', k + 36), 1, 2)) AS lambda_free FROM e)),
m AS (SELECT doc_id, n, k, x, '52494646' || riff_le || '57415645666D74201000000001000100401F0000401F00000100080064617461' || k_le || x AS w, list_transform(regexp_extract_all(x, '..'), lambda y: ('0x' || y)::BIGINT) AS s FROM le),
q AS (SELECT *, list_sum(s)::BIGINT AS total, list_sum(list_transform(s, lambda y: y * y))::BIGINT AS squares, list_sum(list_transform(range(2, k + 1), lambda i: CASE WHEN (s[i] >= 128) <> (s[i - 1] >= 128) THEN 1 ELSE 0 END))::BIGINT AS crossings FROM m)
SELECT doc_id, n AS n_bytes, k::BIGINT AS payload_bytes, sha256(unhex(x)) AS payload_sha256, {_crc("substr(x, CAST(2 * k - 127 AS INT), 128)")}::BIGINT AS tail_crc32, (k + 44)::BIGINT AS media_bytes, sha256(unhex(w)) AS media_sha256, printf('wav:%d:%.6f:%.6f:%d:0', k, total / k, (k * squares - total * total)::DOUBLE / (k * k)::DOUBLE, crossings) AS feature, 'wav' AS sniffed, true AS corrected FROM q, t""",
    "op10_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id AS k, {_WORDS} AS w FROM documents), s AS (SELECT DISTINCT k, list_slice(w, i + 1, i + 5) AS g FROM d, unnest(range(greatest(len(w) - 4, least(len(w), 1)))) r(i)), z AS (SELECT k, count(*) AS n FROM s GROUP BY k),
pairs AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY a.k, b.k), links AS (SELECT a, b, c, x.n AS na, y.n AS nb FROM pairs JOIN z x ON x.k = a JOIN z y ON y.k = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
nodes AS (SELECT k FROM d), {_REACH}, cls AS (SELECT a AS k, min(b) AS m FROM links WHERE c = na AND c = nb GROUP BY a)
SELECT d.k AS doc_id, least(d.k, coalesce(cls.m, d.k)) AS class_id, component_id, (SELECT count(*) FROM links WHERE a = d.k) AS n_links, coalesce(z.n, 0) AS n_shingles FROM d JOIN comp ON comp.k = d.k LEFT JOIN z ON z.k = d.k LEFT JOIN cls ON cls.k = d.k""",
}
