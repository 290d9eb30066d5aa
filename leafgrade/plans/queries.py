"""Queries over the driver's tables. Each function takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import lexicon as L
from ..functions import tokens as T
from ..functions import transforms as X
from ..functions.numbers import rounded
from ..operators import batching, coverage, diagnostics, rollups, signals
from ..scratch import derived
from . import oracle as O

KEY = ["filename", "page_number"]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _inputs(d: str) -> list[str]:
    return [f"{d}/documents.parquet", f"{d}/labels.parquet"]


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, _inputs(d), "vocabulary", lambda: signals.vocabulary(sources.document_pages(spark, d), sources.table(spark, d, "labels")))


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, _inputs(d), "dictionary", lambda: signals.dictionary(sources.document_pages(spark, d), _vocab(spark, d), KEY))


def quality(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every page without its text, made once a session: most queries begin here."""

    def make() -> DataFrame:
        marked = signals.garbled(sources.document_pages(spark, d)).drop("text", "doc_id", "sample_issues", "sample_context")
        return signals.scored(marked.join(_dictionary(spark, d), KEY))

    return derived(spark, _inputs(d), "quality", make)


def diagnosed(spark: SparkSession, d: str) -> DataFrame:
    pairs = diagnostics.disagreements({"garbled": F.col("garbled_score"), "dictionary": F.col("dictionary_score")})
    return quality(spark, d).withColumns({"disagreements": pairs, "struggle": diagnostics.struggles(F.col("score"), F.col("garbled_score"), F.col("dictionary_score"))}).withColumn("has_disagreement", diagnostics.has_disagreement(F.col("disagreements")))


@query(f"WITH {O.PAGES}, t AS (SELECT filename, page_number, list_filter(regexp_split_to_array(text, '{O._SPACE}'), lambda x: x <> '') AS ws FROM pages_) SELECT filename, page_number, CAST(len(ws) AS BIGINT) AS n_tokens, CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT) AS n_token_chars, CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct FROM t")
def token_stats(spark, d):
    """Tokens, their characters and distinct tokens of each page."""
    t = sources.document_pages(spark, d).withColumn("w", T.tokens(F.col("text")))
    return t.select(*KEY, F.size("w").cast("long").alias("n_tokens"), F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("n_token_chars"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query(f"WITH {O.TOKENS} SELECT filename, page_number, total_words, garbled_count, round(garbled_score, 6) AS garbled_score, garbled_score >= 0.85 AS passed FROM gar")
def garbled_by_page(spark, d):
    g = signals.garbled(sources.document_pages(spark, d))
    return g.select(*KEY, F.col("total_words").cast("long"), F.col("garbled_count").cast("long"), rounded("garbled_score", 6).alias("garbled_score"), (F.col("garbled_score") >= 0.85).alias("passed"))


@query(f"WITH {O.TOKENS} SELECT t AS issue, count(*) AS n, count(DISTINCT w) AS n_words FROM iss WHERE t IS NOT NULL GROUP BY t")
def garbled_by_type(spark, d):
    pages = sources.document_pages(spark, d).where(~T.too_short(F.col("text")))
    each = pages.select(F.explode(T.tokens(F.col("text"))).alias("t")).select(T.cleaned(F.col("t")).alias("w")).withColumn("issue", T.issue(F.col("w"))).where("issue IS NOT NULL")
    return each.groupBy("issue", "w").agg(F.count("*").alias("n")).groupBy("issue").agg(F.sum("n").alias("n"), F.count("*").alias("n_words"))


@query(f"WITH {O.TOKENS} SELECT filename, page_number, string_agg(w || ' (' || t || ')', '|' ORDER BY i) AS issues FROM (SELECT *, row_number() OVER (PARTITION BY filename, page_number ORDER BY i) AS r FROM iss WHERE t IS NOT NULL) WHERE r <= 10 GROUP BY ALL")
def garbled_samples(spark, d):
    """The first ten issues of each page that has any."""
    return signals.garbled(sources.document_pages(spark, d)).where("garbled_count > 0").select(*KEY, F.array_join("sample_issues", "|").alias("issues"))


@query(f"WITH {O.TOKENS}, s AS (SELECT *, row_number() OVER (PARTITION BY filename, page_number ORDER BY i) AS r FROM iss WHERE t IS NOT NULL), c AS (SELECT s.filename, s.page_number, s.i, '...' || array_to_string(tok.ws[greatest(s.i - 5, 1):s.i + 5], ' ') || '...' AS c FROM s JOIN tok USING (filename, page_number) WHERE r <= 10) SELECT filename, page_number, string_agg(c, '|' ORDER BY i) AS contexts FROM c GROUP BY ALL")
def garbled_context(spark, d):
    """Five tokens on either side of each sampled issue."""
    g = signals.garbled(sources.document_pages(spark, d), signals.QualityConfig(collect_context=True))
    return g.where("garbled_count > 0").select(*KEY, F.array_join("sample_context", "|").alias("contexts"))


@query(f"WITH {O.TOKENS}, {O.DICTIONARY} SELECT filename, page_number, known, structured, unknown, scored, dictionary_score FROM dic")
def dictionary_by_page(spark, d):
    return _dictionary(spark, d).select(*KEY, "known", "structured", "unknown", "scored", "dictionary_score")


_WORDS = ["ab", "strngthsx", "aeiouy", "aaeeiioou", "hellooooo", "banana", "xzxzxz", "ananan", "aaabaaab", "mississippi", "Bewusstsein", "éèêëé", "rhythm", "x", "brrrr", "lalala", "pppppppp"]


@query(f"WITH words AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '{O._SPACE}')) AS w FROM documents UNION SELECT unnest([{O.quoted(_WORDS)}]) AS w), x AS (SELECT w, lower(w) AS l FROM words WHERE w <> '') SELECT w AS word, {O.VALID} AS valid FROM x")
def structural_validity(spark, d):
    """Whether each distinct token could be a word by its letters."""
    docs = sources.table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word"))
    words = docs.union(spark.createDataFrame([(w,) for w in _WORDS], "word string")).distinct()
    return words.select("word", T.structurally_valid(F.col("word")).alias("valid"))


_CONF = "CAST((length(ws[i]) * 7 + (i - 1) * 13) % 101 AS INT)"


@query(f"""WITH {O.TOKENS}, c AS (SELECT filename, page_number, i, {_CONF} AS conf, greatest(1, length(ws[i])) AS g FROM (SELECT filename, page_number, ws, unnest(range(1, len(ws) + 1)) AS i FROM tok)),
u AS (SELECT filename, page_number, count(*) AS word_count, sum(conf * g) / sum(g) AS m, min(conf) AS min_conf, count(*) FILTER (conf < 30) AS low FROM c WHERE conf > 0 GROUP BY ALL)
SELECT filename, page_number, coalesce(word_count, 0) AS word_count, round(coalesce(m / 100, 0.5), 6) AS confidence_score, min_conf, least(coalesce(low, 0), 20) AS n_low FROM pages_ LEFT JOIN u USING (filename, page_number)""")
def confidence_by_page(spark, d):
    """Word confidences made from token length and place, weighted by length."""
    conf = lambda x, i: F.struct(x.alias("text"), ((F.length(x) * 7 + i * 13) % 101).cast("int").alias("conf"))
    pages = sources.document_pages(spark, d).withColumn("words", F.transform(T.tokens(F.col("text")), conf))
    out = pages.select(*KEY, "words").withColumns(signals.confidence(F.col("words")))
    return out.select(*KEY, F.col("word_count").cast("long"), rounded("confidence_score", 6).alias("confidence_score"), "min_conf", F.size("low_words").cast("long").alias("n_low"))


@query(f"WITH {O.QUALITY} SELECT filename, page_number, round(garbled_score, 6) AS garbled_score, dictionary_score, round(score, 6) AS score, flagged FROM q")
def composite_quality(spark, d):
    """The flagship: all signals of every page, its composite score and flag."""
    return quality(spark, d).select(*KEY, rounded("garbled_score", 6).alias("garbled_score"), "dictionary_score", rounded("score", 6).alias("score"), "flagged")


@query(f"""WITH {O.QUALITY}, m AS (SELECT filename, page_number, {_CONF.replace("ws[i]", "filename").replace("(i - 1)", "page_number")} / 100.0 AS c, garbled_score AS g, dictionary_score AS s FROM q), x AS (SELECT *, 0.4 * g + 0.3 * s + 0.3 * c AS b FROM m), y AS (SELECT *, CASE WHEN c > 0.95 THEN greatest(b, 0.9) WHEN c < 0.2 THEN least(b, 0.3) ELSE b END AS score FROM x)
SELECT filename, page_number, round(score, 6) AS score, score < 0.85 OR g < 0.5 OR s < 0.4 OR c < 0.3 AS flagged FROM y""")
def composite_with_confidence(spark, d):
    """The composite of three signals with its limits; the confidence comes from file and page number."""
    q = quality(spark, d).withColumn("c", ((F.length("filename") * 7 + F.col("page_number") * 13) % 101) / 100.0)
    q = q.withColumn("score", signals.composite(F.col("garbled_score"), F.col("dictionary_score"), F.col("c")))
    return q.select(*KEY, rounded("score", 6).alias("score"), signals.is_flagged(F.col("score"), F.col("garbled_score"), F.col("dictionary_score"), F.col("c")).alias("flagged"))


@query(f"WITH {O.QUALITY} SELECT filename, page_number, round(score, 6) AS score FROM q WHERE flagged")
def flagged_pages(spark, d):
    return quality(spark, d).where("flagged").select(*KEY, rounded("score", 6).alias("score"))


@query(f"WITH {O.QUALITY} SELECT filename, page_number, round(score, 6) AS score FROM q WHERE abs(score - 0.85) < 0.05")
def gray_zone(spark, d):
    return quality(spark, d).where(signals.in_gray_zone(F.col("score"))).select(*KEY, rounded("score", 6).alias("score"))


@query(f"WITH {O.STRUGGLE} SELECT filename, page_number, magnitude, magnitude > 0.3 AS has_disagreement FROM dg")
def signal_disagreements(spark, d):
    return diagnosed(spark, d).select(*KEY, F.get("disagreements", F.lit(0)).magnitude.alias("magnitude"), "has_disagreement")


@query(f"WITH {O.STRUGGLE} SELECT filename, page_number, array_to_string(struggle, ',') AS struggle FROM dg")
def struggle_categories(spark, d):
    return diagnosed(spark, d).select(*KEY, F.array_join("struggle", ",").alias("struggle"))


def _literals(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


def _values(rows) -> str:
    def lit(s):
        return "''" if s == "" else " || ".join(f"chr({ord(c)})" if not (c.isascii() and c.isprintable()) or c == "'" else f"'{c}'" for c in s)

    return "(VALUES " + ", ".join(f"({i}, {lit(s)})" for i, s in enumerate(rows)) + ") t(id, text)"


_UNICODE = ["café", "Selbst­bewusstsein", "ﬀﬁﬂﬃﬄ", "plain", "", "ﬅ stays", "Ångström ﬁn­al"]
_HYPHENS = ["knowl-\nedge", "Merleau-\nPonty", "merleau-\nponty", "well-known", "Jean-\nPaul and inter-\nesting", "end-\n Next", "", "sartre-\nbeauvoir's", "x-\ny z-\nW"]
_LINES = ["word\nword", "Title\nThe text", "a\n  indented\nmore", "one line", "para one\nstill\n\npara two\nAgain", "", "a long line that has quite a few more than sixty characters in it, yes\nNext line", "tail  \nlower", "x\n\n\n\ny\nz"]
_PUNCT = ["word .", "word , word", "hello   \n", "a  b   c", "end \t", "x \n; y", "", "no change.", "a\t\nb  \nc !"]
_MARKDOWN = [("page1\n---\npage2\n---\npage3", 3), ("no separators", 3), ("a\n---\nb\n---\nc\n---\nd", 2), ("x", 1), ("", 0), ("a\n\n\nb\n\n\n\nc", 3), ("a\n----\nb", 2)]


@query("SELECT id, nfc_normalize(replace(replace(replace(replace(replace(replace(text, chr(64256), 'ff'), chr(64257), 'fi'), chr(64258), 'fl'), chr(64259), 'ffi'), chr(64260), 'ffl'), chr(173), '')) AS out, CAST(len(regexp_extract_all(text, '[\\x{FB00}-\\x{FB04}\\x{AD}]')) AS INT) AS n FROM " + _values(_UNICODE))
def normalize_unicode(spark, d):
    out, n = X.normalize_unicode(F.col("text"))
    return _literals(spark, _UNICODE).select("id", out.alias("out"), n.alias("n"))


@query("WITH k AS (SELECT id, regexp_replace(regexp_replace(text, '(?i)(^|[^\\w])(?:(merleau)-\\n(ponty)|(sartre)-\\n(beauvoir)|(buber)-\\n(rosenzweig))\\b', '\\1\\2\\4\\6-\\3\\5\\7', 'g'), '(^|[^\\w])([A-Z]\\w*)-\\n([A-Z]\\w*)', '\\1\\2-\\3', 'g') AS t FROM " + _values(_HYPHENS) + ") SELECT id, regexp_replace(t, '(\\w+)-\\n(\\w+)', '\\1\\2', 'g') AS out, CAST(len(regexp_extract_all(t, '(\\w+)-\\n(\\w+)')) AS INT) AS n FROM k")
def dehyphenate(spark, d):
    out, n = X.dehyphenate(F.col("text"))
    return _literals(spark, _HYPHENS).select("id", out.alias("out"), n.alias("n"))


@query("""WITH b AS (SELECT id, unnest(regexp_split_to_array(text, '\\n\\n+')) AS blk, generate_subscripts(regexp_split_to_array(text, '\\n\\n+'), 1) AS bi FROM """ + _values(_LINES) + """),
l AS (SELECT id, bi, unnest(string_split(blk, chr(10))) AS line, generate_subscripts(string_split(blk, chr(10)), 1) AS li FROM b),
p AS (SELECT *, lag(line) OVER (PARTITION BY id, bi ORDER BY li) AS prev, count(*) OVER (PARTITION BY id, bi) AS n FROM l),
k AS (SELECT *, CASE WHEN n = 1 THEN line WHEN li = 1 THEN rtrim(line) WHEN regexp_matches(line, '^[ \\t]') THEN chr(10) || line WHEN length(trim(prev)) < 60 AND regexp_matches(rtrim(line), '^\\p{Lu}') THEN chr(10) || rtrim(line) ELSE ' ' || rtrim(line) END AS piece,
 CASE WHEN n = 1 OR li = 1 OR regexp_matches(line, '^[ \\t]') OR (length(trim(prev)) < 60 AND regexp_matches(rtrim(line), '^\\p{Lu}')) THEN 0 ELSE 1 END AS j FROM p),
g AS (SELECT id, bi, string_agg(piece, '' ORDER BY li) AS blk, sum(j) AS j FROM k GROUP BY id, bi)
SELECT id, string_agg(blk, chr(10) || chr(10) ORDER BY bi) AS out, CAST(sum(j) AS INT) AS n FROM g GROUP BY id""")
def join_paragraphs(spark, d):
    out, n = X.join_paragraphs(F.col("text"))
    return _literals(spark, _LINES).select("id", out.alias("out"), n.cast("int").alias("n"))


@query("WITH a AS (SELECT id, text, regexp_replace(text, '\\s+([.,;:!?])', '\\1', 'g') AS s1 FROM " + _values(_PUNCT) + "), b AS (SELECT *, regexp_replace(s1, '  +', ' ', 'g') AS s2 FROM a), c AS (SELECT *, regexp_replace(s2, '[ \\t]+(\\n)', '\\1', 'g') AS s3 FROM b) SELECT id, regexp_replace(s3, '[ \\t]+$', '', 'g') AS out, CAST(len(regexp_extract_all(text, '\\s+[.,;:!?]')) + len(regexp_extract_all(s1, '  +')) + len(regexp_extract_all(s2, '[ \\t]+\\n')) + len(regexp_extract_all(s3, '[ \\t]+$')) AS INT) AS n FROM c")
def normalize_punctuation(spark, d):
    out, n = X.normalize_punctuation(F.col("text"))
    return _literals(spark, _PUNCT).select("id", out.alias("out"), n.cast("int").alias("n"))


@query("SELECT id, array_to_string(CASE WHEN n <= 0 THEN [] WHEN n = 1 THEN [text] WHEN len(regexp_split_to_array(text, '\\n-{3,}\\n')) >= n THEN regexp_split_to_array(text, '\\n-{3,}\\n')[1:n] WHEN len(regexp_split_to_array(text, '\\n{3,}')) >= n THEN regexp_split_to_array(text, '\\n{3,}')[1:n] ELSE list_concat([text], list_transform(range(n - 1), lambda x: '')) END, '|') AS parts FROM " + "(SELECT v.id, v.text, [" + ", ".join(str(n) for _, n in _MARKDOWN) + "][v.id + 1] AS n FROM " + _values([m for m, _ in _MARKDOWN]).replace("t(id, text)", "v(id, text)") + ")")
def split_markdown(spark, d):
    rows = spark.createDataFrame([(i, m, n) for i, (m, n) in enumerate(_MARKDOWN)], "id int, text string, n int")
    return rows.select("id", F.array_join(X.split_markdown(F.col("text"), F.col("n")), "|").alias("parts"))


@query(None)
def postprocess_documents(spark, d):
    """The whole clean-up of every document, with its counts; chains of hyphens take the exact form."""
    docs = sources.table(spark, d, "documents").select("doc_id", "text")
    parts = []
    for chains in (False, True):
        out, counts = X.postprocess(F.col("text"), chains)
        parts.append(docs.where(F.coalesce(X.has_hyphen_chain(F.col("text")), F.lit(False)) == chains).select("doc_id", F.sha2(out, 256).alias("text_sha256"), *[c.cast("int").alias(k) for k, c in counts.items()]))
    return parts[0].unionAll(parts[1])


@query("WITH t AS (SELECT doc_id, text, regexp_replace(text, '\\s+([.,;:!?])', '\\1', 'g') AS s1 FROM documents), b AS (SELECT *, regexp_replace(s1, '  +', ' ', 'g') AS s2 FROM t), c AS (SELECT *, regexp_replace(s2, '[ \\t]+(\\n)', '\\1', 'g') AS s3 FROM b) SELECT doc_id, md5(regexp_replace(s3, '[ \\t]+$', '', 'g')) AS out_md5 FROM c")
def punctuation_documents(spark, d):
    docs = sources.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(X.normalize_punctuation(F.col("text"))[0].cast("binary")).alias("out_md5"))


def _engine(q: DataFrame) -> DataFrame:
    return q.withColumn("engine", F.when(F.col("score") < 0.8, "surya").when(F.col("page_number") % 2 == 0, "tesseract").otherwise("existing"))


_ENGINE = "CASE WHEN score < 0.8 THEN 'surya' WHEN page_number % 2 = 0 THEN 'tesseract' ELSE 'existing' END"
_FILES = f"fl AS (SELECT filename, count(*) AS page_count, round(avg(score), 6) AS quality_score, count(*) FILTER (flagged) AS flagged_pages, CASE WHEN count(DISTINCT {_ENGINE}) = 1 THEN min({_ENGINE}) ELSE 'mixed' END AS engine FROM q GROUP BY filename)"


@query(f"WITH {O.QUALITY}, {_FILES} SELECT * FROM fl")
def file_rollup(spark, d):
    return rollups.file_rollup(_engine(quality(spark, d))).withColumn("quality_score", rounded("quality_score", 6))


@query("SELECT id, engine FROM (VALUES (0, 'none'), (1, 'surya'), (2, 'mixed'), (3, 'tesseract'), (4, 'none')) t(id, engine)")
def file_engine(spark, d):
    rows = spark.createDataFrame([(0, []), (1, ["surya", "none"]), (2, ["surya", "tesseract"]), (3, ["tesseract"]), (4, ["none"])], "id int, e array<string>")
    return rows.select("id", rollups.file_engine(F.col("e")).alias("engine"))


@query(f"WITH {O.QUALITY}, {_FILES} SELECT count(*) AS n_files, count(*) FILTER (page_count % 3 > 0) AS success_count, count(*) FILTER (page_count % 3 = 0) AS error_count, count(*) FILTER (flagged_pages > 0) AS flagged_count, CAST(sum(flagged_pages) AS BIGINT) AS total_flagged_pages FROM fl")
def batch_summary(spark, d):
    """Files of a number of pages that three divides count as failed."""
    return rollups.batch_summary(rollups.file_rollup(_engine(quality(spark, d))).withColumn("success", F.col("page_count") % 3 > 0))


@query(f"WITH {O.STRUGGLE}, base AS (SELECT filename, count(*) AS total_pages, count(*) FILTER (flagged) AS flagged_pages, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, count(*) FILTER (magnitude > 0.3) AS disagreements FROM dg GROUP BY filename), c AS (SELECT filename, category, count(*) AS n FROM (SELECT filename, unnest(struggle) AS category FROM dg) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY n DESC, category) AS k FROM c) SELECT base.*, round(100.0 * flagged_pages / total_pages, 2) AS flagged_pct, (SELECT string_agg(category, ',' ORDER BY k) FROM r WHERE r.filename = base.filename AND k <= 3) AS dominant FROM base")
def document_summary(spark, d):
    out = rollups.document_summary(diagnosed(spark, d))
    return out.withColumns({"min_score": rounded("min_score", 6), "max_score": rounded("max_score", 6), "dominant": F.array_join("dominant", ",")})


@query(f"WITH {O.QUALITY}, f AS (SELECT filename, page_number, row_number() OVER (ORDER BY filename, page_number) - 1 AS batch_index FROM q WHERE flagged) SELECT filename, page_number, batch_index, batch_index // 11 AS sub_batch, batch_index % 11 AS idx_in_batch FROM f")
def flagged_batches(spark, d):
    """Flagged pages of all files in batches of 11 (what 16 GB hold)."""
    return batching.in_batches(batching.indexed(signals.bad_pages(quality(spark, d), KEY), KEY), 11)


_SIZES = [(100, 64.0, "cpu"), (10, 64.0, "cpu"), (100, 8.0, "mps"), (100, 16.0, "mps"), (100, 32.0, "mps"), (0, 32.0, "mps"), (6, 4.0, "mps"), (500, 400.0, "cuda"), (3, 0.5, "cuda")]


@query("SELECT *, CASE WHEN pages <= 0 THEN 0 WHEN device = 'cpu' THEN least(pages, 32) ELSE greatest(1, least(pages, CAST(floor(memory_gb * 0.5 / 0.7) AS INT), 100)) END AS size, memory_gb < 4.0 AS pressure, CASE WHEN device = 'cpu' THEN 32 WHEN memory_gb >= 32 THEN 128 WHEN memory_gb >= 16 THEN 64 ELSE 32 END AS recognition FROM (VALUES " + ", ".join(f"({p}, CAST({m} AS DOUBLE), '{x}')" for p, m, x in _SIZES) + ") t(pages, memory_gb, device)")
def batch_sizes(spark, d):
    rows = spark.createDataFrame(_SIZES, "pages int, memory_gb double, device string")
    a = (F.col("pages"), F.col("memory_gb"), F.col("device"))
    return rows.withColumns({"size": batching.safe_batch_size(*a), "pressure": batching.under_pressure(a[1]), "recognition": batching.engine_batch_tiers(a[2], a[1]).recognition})


@query(f"WITH {O.QUALITY}, f AS (SELECT filename, page_number, row_number() OVER (ORDER BY filename, page_number) - 1 AS bi FROM q WHERE flagged) SELECT filename, page_number, CASE WHEN bi % 11 < 9 THEN 'surya' ELSE 'tesseract' END AS engine, CASE WHEN bi % 11 < 9 THEN round((bi % 11) / 10.0, 6) ELSE round(q.score, 6) END AS score, CASE WHEN bi % 11 < 9 THEN (bi % 11) / 10.0 < 0.85 ELSE flagged END AS flagged FROM q LEFT JOIN f USING (filename, page_number)")
def second_pass_writeback(spark, d):
    """A second engine answers the first nine pages of each batch; flags follow from the new score alone."""
    q = quality(spark, d).withColumn("engine", F.lit("tesseract"))
    batches = batching.in_batches(batching.indexed(signals.bad_pages(q, KEY), KEY), 11)
    texts = batches.where("idx_in_batch < 9").select("sub_batch", "idx_in_batch", F.concat(F.lit("read "), F.col("filename")).alias("new_text"), (F.col("idx_in_batch") / 10.0).alias("new_score"))
    out = batching.write_back(q, batches, texts)
    return out.select(*KEY, "engine", rounded("score", 6).alias("score"), "flagged")


@query(f"WITH {O.PAGES}, r AS (SELECT filename, page_number, row_number() OVER (PARTITION BY filename ORDER BY page_number) - 1 AS k FROM pages_ WHERE page_number % 3 = 1) SELECT filename, page_number, CASE WHEN k < 4 THEN 'new ' || k ELSE md5(text) END AS content FROM pages_ LEFT JOIN r USING (filename, page_number)")
def replace_pages(spark, d):
    """Every third page is to be replaced; four replacements a file."""
    pages = sources.document_pages(spark, d).withColumn("text", F.md5(F.col("text").cast("binary")))
    new = pages.select("filename").distinct().select("filename", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).withColumn("new_text", F.concat(F.lit("new "), "k"))
    return batching.replace_pages(pages, pages.where("page_number % 3 = 1"), new).select(*KEY, F.col("text").alias("content"))


@query(f"WITH {O.PAGES} SELECT filename, page_number, doc_id FROM pages_ WHERE page_number BETWEEN 2 AND 6")
def page_range(spark, d):
    a, b = batching.parse_page_range("3-7", 10)
    return sources.document_pages(spark, d).where(F.col("page_number").between(a, b)).select(*KEY, "doc_id")


@query(f"WITH {O.PAGES}, r(pos, page_number) AS (VALUES (0, 4), (1, 0), (2, 4), (3, 1000000)) SELECT pos, filename, page_number, doc_id FROM r JOIN pages_ USING (page_number)")
def page_slice(spark, d):
    return batching.page_slice(sources.document_pages(spark, d), [4, 0, 4, 1000000]).select("pos", *KEY, "doc_id")


@query(f"WITH {O.STRUGGLE} SELECT category, count(*) AS n_pages, count(DISTINCT filename) AS n_files FROM (SELECT filename, unnest(struggle) AS category FROM dg) GROUP BY category")
def category_coverage(spark, d):
    return coverage.category_coverage(diagnosed(spark, d))


@query(f"WITH {O.PAGES}, src AS (SELECT 'all' AS category, filename, page_number FROM pages_), {O.SAMPLE.format(src='src', target=47)} SELECT filename, page_number FROM smp")
def cross_document_sample(spark, d):
    return coverage.cross_document_sample(sources.document_pages(spark, d).select(*KEY), 47)


@query(f"""WITH {O.STRUGGLE}, e AS (SELECT filename, page_number, unnest(struggle) AS category FROM dg),
s AS (SELECT category, count(*) AS total, CASE category WHEN 'gray_zone' THEN 16 WHEN 'signal_disagreement' THEN 12 ELSE 4 END AS lim FROM e GROUP BY category),
src AS (SELECT e.*, lim FROM e JOIN s USING (category) WHERE total > lim),
{O.SAMPLE.replace("SELECT category, filename, count(*) AS n FROM {src} GROUP BY ALL", "SELECT category, filename, count(*) AS n, any_value(lim) AS lim FROM {src} GROUP BY category, filename").format(src="src", target="lim")}
SELECT filename, page_number FROM smp UNION SELECT filename, page_number FROM e JOIN s USING (category) WHERE total <= lim""")
def difficult_pages(spark, d):
    return coverage.difficult_pages(diagnosed(spark, d))


@query(f"""WITH {O.STRUGGLE}, x AS (SELECT filename, page_number AS p, score, len(struggle) = 0 AS clean, count(*) OVER (PARTITION BY filename) AS n, row_number() OVER (PARTITION BY filename ORDER BY page_number) - 1 AS i FROM dg),
s1 AS (SELECT filename, min(p) AS p FROM x WHERE i < 3 AND clean GROUP BY filename),
s2 AS (SELECT filename, min(p) AS p FROM x WHERE i >= 3 AND i < 10 AND clean AND score > 0.9 AND (filename, p) NOT IN (SELECT (filename, p) FROM s1) GROUP BY filename),
s12 AS (SELECT * FROM s1 UNION SELECT * FROM s2),
body AS (SELECT filename, p, row_number() OVER (PARTITION BY filename ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY filename) AS m, n FROM x WHERE i >= n // 4 AND i < 3 * n // 4 AND clean AND score > 0.9 AND (filename, p) NOT IN (SELECT (filename, p) FROM s12)),
room AS (SELECT x.filename, 3 - count(s12.p) FILTER (s12.p >= x.n // 4 AND s12.p <= 3 * x.n // 4) AS room FROM (SELECT DISTINCT filename, n FROM x) x LEFT JOIN s12 USING (filename) GROUP BY x.filename),
s3 AS (SELECT filename, p FROM (SELECT filename, p, row_number() OVER (PARTITION BY filename ORDER BY k) AS r FROM body WHERE k % greatest(1, m // 3) = 0) JOIN room USING (filename) WHERE r <= room),
s123 AS (SELECT * FROM s12 UNION SELECT * FROM s3),
s4 AS (SELECT filename, max(p) AS p FROM x WHERE i >= n - 20 AND clean AND score > 0.9 AND (filename, p) NOT IN (SELECT (filename, p) FROM s123) GROUP BY filename)
SELECT filename, p AS page_number FROM s123 UNION SELECT filename, p AS page_number FROM s4""")
def regression_pages(spark, d):
    return coverage.regression_pages(diagnosed(spark, d))


@query("SELECT word, string_agg(list_name, ',' ORDER BY list_name) AS lists FROM (" + " UNION ALL ".join(f"SELECT unnest([{O.quoted(w)}]) AS word, '{k}' AS list_name" for k, w in L.TERM_LISTS.items()) + ") GROUP BY word")
def term_lists(spark, d):
    """The union of all term lists, with the lists that hold each term."""
    rows = spark.createDataFrame([(w, k) for k, words in L.TERM_LISTS.items() for w in words], "word string, list_name string")
    return rows.groupBy("word").agg(F.array_join(F.array_sort(F.collect_list("list_name")), ",").alias("lists"))


@query(f"WITH {O.TOKENS}, {O.DICTIONARY} SELECT l AS word FROM vocab UNION SELECT unnest(['eigenwort', 'logos']) AS word")
def vocab_union(spark, d):
    custom = spark.createDataFrame([("Eigenwort ",), ("logos",), ("  ",)], "word string")
    return sources.with_custom_words(_vocab(spark, d), custom)


@query("SELECT * FROM (VALUES (0, 'eng,fra', 'en,fr', 'eng+fra'), (1, 'eng,fra,ell,lat,deu', 'en,fr,el,la,de', ''), (2, 'deu', 'de', 'deu')) t(id, first_codes, second_codes, plus)")
def language_resolve(spark, d):
    from ..operators.languages import resolved

    rows = spark.createDataFrame([(0, ["en", "fr"]), (1, []), (2, ["de"])], "id int, codes array<string>")
    return resolved(rows)


@query(None)
def engine_diff(spark, d):
    """Word-level differences of each conversation turn and the next."""
    c = sources.table(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("new_text"))
    out = diagnostics.engine_diff(c.join(after, ["conv_id", "turn"]), "text", "new_text")
    return out.select("conv_id", "turn", "n_additions", "n_deletions", "n_substitutions")


@query(None)
def result_json(spark, d):
    """Each file's record with its pages as JSON, null fields left out."""
    q = _engine(quality(spark, d)).withColumns({"quality_score": rounded("score", 6), "status": F.when(F.col("flagged"), "flagged").otherwise("good")})
    files = rollups.file_rollup(q).withColumns({"quality_score": rounded("quality_score", 6), "success": F.lit(True)})
    return rollups.file_json(files, q)


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def progress_by_hour(spark, d):
    """Progress events by hour and type."""
    e = sources.table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), rounded(F.sum("value"), 4).alias("total"))


@query(f"WITH {O.STRUGGLE}, e AS (SELECT filename, page_number, unnest(struggle) AS category FROM dg), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY filename, page_number) AS r FROM e) SELECT category, count(*) AS n, string_agg(filename || ':' || page_number, ',' ORDER BY r) FILTER (r <= 5) AS first_pages, greatest(count(*) - 5, 0) AS n_more FROM r GROUP BY category")
def coverage_report(spark, d):
    """Categories with their first five pages."""
    out = coverage.coverage_report(diagnosed(spark, d))
    return out.select("category", "n", F.array_join("pages", ",").alias("first_pages"), "n_more")


@query(f"WITH {O.QUALITY}, {_FILES} SELECT filename, CAST(page_count AS VARCHAR) AS pages, printf('%.1f%%', quality_score * 100) AS quality, engine FROM fl")
def summary_table(spark, d):
    files = rollups.file_rollup(_engine(quality(spark, d))).withColumns({"quality_score": rounded("quality_score", 6), "success": F.lit(True)})
    return rollups.summary_table(files)


@query(None)
def page_selection(spark, d):
    """Difficult and regression pages by file, their total, and the coverage counts, as one JSON record."""
    pages = diagnosed(spark, d)
    chosen = coverage.page_selection(coverage.difficult_pages(pages), coverage.regression_pages(pages), coverage.category_coverage(pages))
    return chosen.select(F.to_json(F.struct("*")).alias("json"))


@query(f"WITH {O.TOKENS}, words AS (SELECT l, count(*) AS n FROM (SELECT lower(w) AS l FROM iss WHERE t = 'consonant_cluster') GROUP BY l) SELECT l AS word, n FROM words ORDER BY n DESC, l LIMIT 20")
def top_clusters(spark, d):
    """The twenty commonest tokens with a run of consonants (a top-k report)."""
    pages = sources.document_pages(spark, d).where(~T.too_short(F.col("text")))
    each = pages.select(F.explode(T.tokens(F.col("text"))).alias("t")).select(T.cleaned(F.col("t")).alias("w")).where(T.issue(F.col("w")) == "consonant_cluster")
    return each.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20)
