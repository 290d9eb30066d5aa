"""DuckDB statements that state each query's result independently of the Spark plans."""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions.tokens import CONSONANTS, SUFFIXES, WEIRD_CASE, reference_pattern


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_STRIP = f"regexp_replace(text, '^{_SPACE}|{_SPACE}$', '', 'g')"
_SYMBOLS = r"[^\p{L}\p{M}\p{N}_\s\x0b.,;:!?''" + '"' + r"\-–—…*()]{3,}"
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]"

PAGES = "pages_ AS (SELECT source AS filename, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_number, text, doc_id FROM documents)"

TOKENS = f"""{PAGES},
tok AS (SELECT filename, page_number, doc_id, text, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS ws, length({_STRIP}) < 100 AS short FROM pages_),
w AS (SELECT filename, page_number, i, ws[i] AS token, trim(ws[i], {text(L.EDGE_PUNCTUATION)}) AS w FROM (SELECT filename, page_number, ws, unnest(range(1, len(ws) + 1)) AS i FROM tok WHERE NOT short)),
iss AS (SELECT *, CASE
  WHEN length(w) < 2 OR lower(w) IN ({quoted(L.VALID_SHORT)}) OR regexp_matches(w, {text(reference_pattern("(?i:{})"))}) OR lower(w) IN ({quoted(L.VALID_TERMS)}) THEN NULL
  WHEN length(w) > 4 AND length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) / length(w) < 0.3 THEN 'low_alpha'
  WHEN regexp_matches(w, '(?i){CONSONANTS}') AND NOT regexp_matches(lower(w), '{SUFFIXES}') THEN 'consonant_cluster'
  WHEN regexp_matches(w, '{_SYMBOLS}') THEN 'symbol_run'
  WHEN regexp_matches(w, '{WEIRD_CASE}') THEN 'weird_case'
  WHEN regexp_matches(w, '{_CONTROL}') THEN 'control_char' END AS t FROM w),
gar AS (SELECT p.filename, p.page_number, count(w.i) AS total_words, count(w.t) AS garbled_count, CASE WHEN count(w.i) = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - 2.0 * count(w.t) / count(w.i)) END AS garbled_score
  FROM pages_ p LEFT JOIN iss w USING (filename, page_number) GROUP BY ALL)"""

_VOWEL = f"length(regexp_replace(l, '[^{L.VOWELS}]', '', 'g'))"

VALID = f"""(length(l) < 2 OR NOT (
  ({_VOWEL} / length(l) < 0.1 AND length(l) > 3) OR ({_VOWEL} / length(l) > 0.9 AND length(l) > 4)
  OR len(list_filter(range(1, length(l) - 2), lambda i: substr(l, i, 1) = substr(l, i + 1, 1) AND substr(l, i, 1) = substr(l, i + 2, 1) AND substr(l, i, 1) = substr(l, i + 3, 1))) > 0
  OR len(list_filter(range(1, length(l) - 4), lambda i: substr(l, i, 2) = substr(l, i + 2, 2) AND substr(l, i, 2) = substr(l, i + 4, 2))) > 0
  OR (length(l) > 6 AND len(list_distinct(string_split(l, ''))) / length(l) < 0.3)))"""

_CLEAN = f"regexp_replace(translate(token, {text(L.DELETED_PUNCTUATION)}, ''), '^{_SPACE}|{_SPACE}$', '', 'g')"

DICTIONARY = f"""dtok AS (SELECT filename, page_number, doc_id, unnest(ws) AS token FROM tok),
dw AS (SELECT filename, page_number, doc_id, {_CLEAN} AS word FROM dtok),
dl AS (SELECT filename, page_number, doc_id, word, lower(word) AS l FROM dw WHERE length(word) >= 3 AND regexp_matches(word, '\\p{{L}}')),
vocab AS (SELECT l FROM (SELECT DISTINCT doc_id, l FROM dl WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) GROUP BY l HAVING count(*) >= 3),
judged AS (SELECT l, l IN (SELECT l FROM vocab) AS known, {VALID} AS valid FROM (SELECT DISTINCT l FROM dl)),
dic0 AS (SELECT filename, page_number, count(*) FILTER (known) AS known, count(*) FILTER (NOT known AND valid) AS structured, count(*) FILTER (NOT known AND NOT valid) AS unknown, count(*) AS scored FROM dl JOIN judged USING (l) GROUP BY ALL),
dic AS (SELECT p.filename, p.page_number, coalesce(known, 0) AS known, coalesce(structured, 0) AS structured, coalesce(unknown, 0) AS unknown, coalesce(scored, 0) AS scored,
  CASE WHEN coalesce(scored, 0) = 0 THEN 1.0 ELSE round((known + 0.5 * structured) / scored, 4) END AS dictionary_score FROM pages_ p LEFT JOIN dic0 USING (filename, page_number))"""

QUALITY = f"""{TOKENS}, {DICTIONARY},
q0 AS (SELECT filename, page_number, total_words, garbled_count, garbled_score, known, structured, unknown, scored, dictionary_score, 0.55 * garbled_score + 0.45 * dictionary_score AS score FROM gar JOIN dic USING (filename, page_number)),
q AS (SELECT *, score < 0.85 OR garbled_score < 0.5 OR dictionary_score < 0.4 AS flagged FROM q0)"""

STRUGGLE = f"""{QUALITY},
dg AS (SELECT *, round(abs(garbled_score - dictionary_score), 4) AS magnitude, list_filter([
  CASE WHEN garbled_score < 0.7 AND dictionary_score > 0.5 THEN 'character_confusion' END,
  CASE WHEN dictionary_score < 0.6 AND garbled_score > 0.7 THEN 'vocabulary_miss' END,
  CASE WHEN dictionary_score < 0.4 AND garbled_score > 0.4 AND garbled_score < 0.7 THEN 'language_confusion' END,
  CASE WHEN abs(garbled_score - dictionary_score) > 0.3 THEN 'signal_disagreement' END,
  CASE WHEN abs(score - 0.85) < 0.05 THEN 'gray_zone' END], lambda x: x IS NOT NULL) AS struggle FROM q)"""

SAMPLE = """cnt AS (SELECT category, filename, count(*) AS n FROM {src} GROUP BY ALL),
quota AS (SELECT *, count(*) OVER (PARTITION BY category) AS docs, row_number() OVER (PARTITION BY category ORDER BY filename) - 1 AS rk FROM cnt),
take AS (SELECT category, filename, n, least(greatest(1, {target} // docs) + CASE WHEN rk < {target} - greatest(1, {target} // docs) * docs THEN 1 ELSE 0 END, n) AS k FROM quota),
rk AS (SELECT category, filename, page_number, row_number() OVER (PARTITION BY category, filename ORDER BY page_number) - 1 AS r FROM {src}),
smp AS (SELECT category, filename, page_number FROM rk JOIN take USING (category, filename) WHERE list_contains(list_transform(range(k), lambda i: CAST(floor(i * (n / k)) AS BIGINT)), r))"""
