"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from .bpe import op3_bpe
from .chat import op8_chat_formatting
from .exact_dedup import op7_exact_dedup
from .fingerprints import op13_document_fingerprints
from .gru_lm import op4_language_model
from .html_wrapper import op1_html_extraction
from .merkle import op11_merkle_manifest
from .ngram_join import op2_ngram_jaccard_join
from .packing import op10_best_fit_packing
from .spelling import op12_spelling_variants
from .toxicity import op5_toxicity
from .voronoi_knn import op6_exact_topk
from .warc import op9_warc_revisits

TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5"""

DEDUP_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents),
w AS (SELECT doc_id, n, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM w"""

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) + 32 AS chars FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

WARC_SQL = r"""
WITH p AS (SELECT page_id AS id, url, sha256(coalesce(html, '')) AS digest,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//', '') AS rest FROM pages),
k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^[^@]*@|:(80|443)$', '', 'g'), '^www\.', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS query FROM p),
u AS (SELECT id, digest, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key, '"' || substr(digest, 1, 16) || '"' AS tag FROM k),
v AS (SELECT id * 4 + 1 AS record_id, url_key, tag, id * 10 + (id * 7919) % 5000 * 10 + 5 AS ts FROM u
  UNION ALL SELECT id * 4 + 2, url_key, tag, id * 10 + id % 7 * 10 - 35 FROM u),
j AS (SELECT v.*, u.id AS of_id, u.digest, u.tag AS of_tag,
    row_number() OVER (PARTITION BY v.record_id ORDER BY u.id DESC) AS n
  FROM v LEFT JOIN u ON u.url_key = v.url_key AND (u.id * 10 < v.ts OR u.id * 10 = v.ts AND u.id * 4 < v.record_id))
SELECT record_id, url_key, CASE WHEN of_tag = tag THEN of_id * 4 END AS response_id,
  CASE WHEN of_id IS NULL THEN 'no_response' WHEN of_tag = tag THEN 'resolved' ELSE 'validator_mismatch' END AS outcome,
  CASE WHEN of_tag = tag THEN digest END AS digest,
  CASE WHEN of_tag = tag THEN 'content-type=text/html;date=' || ts || ';etag=' || tag || ';server=a' END AS headers
FROM j WHERE n = 1"""

#: The table of the CRC-32 of zlib, made by its rule.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"


def leaf(n: str) -> str:
    return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", n, "text"))) + ")"


MERKLE_SQL = f"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS t),
d AS (SELECT doc_id, lang, {leaf("n_chars")} AS leaf, {leaf("(n_chars + 1)")} AS altered,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM documents, crc),
l AS (SELECT doc_id, lang, leaf, CASE WHEN crc % 7 = 0 AND altered IS NOT NULL THEN altered ELSE leaf END AS altered,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM d),
node AS (SELECT lang, 0 AS lvl, idx, n, leaf AS digest FROM l
  UNION ALL SELECT lang, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY lang, lvl, idx // 2, n),
s AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (SELECT 0 AS lvl, idx, n, subroot AS digest FROM s
  UNION ALL SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 2, n),
low AS (SELECT doc_id, lang, leaf, 0 AS lvl, idx, n, altered AS folded, '' AS way FROM l
  UNION ALL SELECT p.doc_id, p.lang, p.leaf, p.lvl + 1, p.idx // 2, (p.n + 1) // 2,
    sha256(CASE WHEN p.idx % 2 = 1 THEN o.digest || p.folded ELSE p.folded || coalesce(o.digest, '') END), p.way || coalesce(o.digest, '')
  FROM low p LEFT JOIN node o ON o.lang IS NOT DISTINCT FROM p.lang AND o.lvl = p.lvl AND o.idx = xor(p.idx, 1) WHERE p.n > 1),
high AS (SELECT low.doc_id, low.leaf, s.subroot, 0 AS lvl, s.idx, s.n, low.folded, low.way FROM low JOIN s ON s.lang IS NOT DISTINCT FROM low.lang WHERE low.n = 1
  UNION ALL SELECT p.doc_id, p.leaf, p.subroot, p.lvl + 1, p.idx // 2, (p.n + 1) // 2,
    sha256(CASE WHEN p.idx % 2 = 1 THEN o.digest || p.folded ELSE p.folded || coalesce(o.digest, '') END), p.way || coalesce(o.digest, '')
  FROM high p LEFT JOIN top o ON o.lvl = p.lvl AND o.idx = xor(p.idx, 1) WHERE p.n > 1)
SELECT doc_id, leaf, subroot, digest AS root, sha256(way) AS proof_sha256, folded AS folded_root, folded = digest AS verified
FROM high JOIN top ON top.n = 1 WHERE high.n = 1"""

SPELLING_SQL = f"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS t),
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
per AS (SELECT doc_id, w, count(*) AS n FROM run GROUP BY doc_id, w),
code AS (SELECT w, n, xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w))), lambda i: ('0x' || substr(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM per, crc),
word AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n FROM code GROUP BY 1
  HAVING sum(n) >= 3 AND length(word) >= 5),
cut AS (SELECT word, n, unnest(range(length(word))) AS i FROM word),
less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM cut),
near AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN word b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN word b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top, min(other) FILTER (n = m) AS other FROM (SELECT *, max(n) OVER (PARTITION BY word) AS m FROM near) GROUP BY word),
form AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 2 * w.n THEN b.other END AS form, CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n
  FROM word w LEFT JOIN best b ON b.word = w.word),
walk AS (SELECT word, word AS root, form AS next FROM form UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN form f ON f.word = w.next)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM form f JOIN walk w ON w.word = f.word AND w.next IS NULL"""

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_bpe": op3_bpe,
    "op4_language_model": op4_language_model,
    "op5_toxicity": op5_toxicity,
    "op6_exact_topk": op6_exact_topk,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_document_fingerprints": op13_document_fingerprints,
}

ORACLES = {
    "op6_exact_topk": TOPK_SQL,
    "op7_exact_dedup": DEDUP_SQL,
    "op8_chat_formatting": CHAT_SQL,
    "op9_warc_revisits": WARC_SQL,
    "op11_merkle_manifest": MERKLE_SQL,
    "op12_spelling_variants": SPELLING_SQL,
}
