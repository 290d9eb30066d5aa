"""The queries of this subpackage and the DuckDB statements for those that SQL can express."""

from __future__ import annotations

from .arc_warc import op8_warc
from .decontaminate import op7_decontaminate
from .jaccard import op4_jaccard
from .language import op1_language
from .mjpeg import op5_mjpeg
from .sentencepiece_bpe import op6_sentencepiece
from .suffix_dedup import op10_suffix_dedup
from .token_files import op3_token_files
from .token_counts import op9_token_counts
from .toxicity import op2_toxicity

QUERIES = {f.__name__: f for f in (op1_language, op2_toxicity, op3_token_files, op4_jaccard, op5_mjpeg, op6_sentencepiece, op7_decontaminate, op8_warc, op9_token_counts, op10_suffix_dedup)}

#: Word lists in list functions; windows found by an equality join on runs of words.
_OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (SELECT item_id, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)
), grams AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT size FROM win) WHERE len(w) >= size)
), found AS (
  SELECT doc_id, i, grams.size, item_id FROM grams JOIN win ON grams.size = win.size AND grams.g = win.g
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id
), all_docs AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256
  FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
)
SELECT *, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM all_docs
"""

#: Base32 of the digest's bits, five at a time.
_OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hx FROM pages
), b AS (
  SELECT page_id, h, hx, array_to_string(list_transform(string_split(hx, ''), lambda c: list_extract(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'], strpos('0123456789abcdef', c))), '') AS bits FROM p
), m AS (
  SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, i * 5 + 1, 1) AS INT) + 8 * CAST(substr(bits, i * 5 + 2, 1) AS INT) + 4 * CAST(substr(bits, i * 5 + 3, 1) AS INT) + 2 * CAST(substr(bits, i * 5 + 4, 1) AS INT) + CAST(substr(bits, i * 5 + 5, 1) AS INT), 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hx) AS r FROM b
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = r THEN NULL ELSE r END AS refers_to FROM m
"""

#: Sets as distinct rows, an equality join that counts common shingles, and reach along links.
_OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 80 * (na.n + nb.n - m)
), r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON r.doc_id = l.a
), c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id
), k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM documents LEFT JOIN n USING (doc_id) JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

#: Every 400-byte string of the hexadecimal text by its digest; starts that lie near make spans.
_OP10_SQL = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), s AS (SELECT doc_id, i, md5(substr(x, CAST(2 * i + 1 AS INT), 800)) AS h FROM (SELECT doc_id, x, unnest(range(n - 399)) AS i FROM t WHERE n >= 400)
), c AS (SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)
), g AS (SELECT doc_id, i, sum(CASE WHEN i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c)
), e AS (SELECT doc_id, min(i) AS b, max(i) + 400 AS e FROM g GROUP BY doc_id, span
), k AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a FROM e
), m AS (SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, string_agg(substr(x, CAST(2 * a + 1 AS INT), CAST(2 * (b - a) AS INT)), '' ORDER BY b) AS kept, max(e) AS last FROM k JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept || substr(x, CAST(2 * last + 1 AS INT)), x))) AS kept_sha256 FROM t LEFT JOIN m USING (doc_id)
"""

ORACLE_SQL = {"op4_jaccard": _OP4_SQL, "op7_decontaminate": _OP7_SQL, "op8_warc": _OP8_SQL, "op10_suffix_dedup": _OP10_SQL}
