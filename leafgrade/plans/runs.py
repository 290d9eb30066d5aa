"""Queries over files and runs: the driver's tables are written as files in the shared folder, and read back.

Each function takes (spark, sf_dir) like those of queries.py, and is registered there.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import pipeline, service, sinks, sources
from ..config import RunConfig
from ..engines import form_feed_reader, read_pages
from ..functions import transforms as X
from ..functions.numbers import rounded
from ..images import image_quality as measured
from ..images import mean_dpi, skew_of_lines
from ..operators import batching, coverage, rollups, signals
from ..scratch import scratch, stored
from . import oracle as O
from .queries import KEY, ORACLE_SQL, _dictionary, _vocab, diagnosed, quality, query


def _page_files(spark, d: str) -> str:
    """A folder with a file for each source: its pages in order, separated by form feeds."""
    folder = scratch(spark, "page-files")
    pages = sources.document_pages(spark, d).where("filename IS NOT NULL")
    pages = pages.select(F.concat("filename", F.lit(".txt")).alias("path"), "page_number", F.translate("text", "\f", " ").alias("text"))
    sinks.write_joined(pages, folder).write.format("noop").mode("overwrite").save()
    return folder


_FILE = "filename || '.txt'"


@query(f"WITH {O.PAGES}, p AS (SELECT *, count(*) OVER (PARTITION BY filename) AS n FROM pages_) SELECT {_FILE} AS filename, filename AS stem, '.txt' AS suffix, page_number, n AS page_count, md5(replace(text, chr(12), ' ')) AS text_md5 FROM p")
def files_read_back(spark, d):
    """Pages of files in path order with their counts, and the parts of their names."""
    found, _ = sources.discovered(spark, _page_files(spark, d), "*.txt")
    pages = stored(read_pages(found.orderBy("path"), form_feed_reader), "read-pages").where("error IS NULL")
    counts = pages.groupBy("path").agg(F.count("page_number").alias("page_count"))
    return pages.join(counts, "path").select("filename", sources.file_stem("path").alias("stem"), sources.file_suffix("path").alias("suffix"), "page_number", "page_count", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {O.PAGES} SELECT {_FILE} AS filename, CAST(count(*) AS BIGINT) AS page_count, md5(string_agg(replace(text, chr(12), ' '), chr(10) ORDER BY page_number)) AS text_md5, true AS found FROM pages_ WHERE filename IN ('src1', 'src7') GROUP BY filename UNION ALL SELECT 'gone.txt', NULL, NULL, false")
def listed_file_texts(spark, d):
    """Whole texts of the files named, and the names without a file."""
    found, missing = sources.discovered(spark, _page_files(spark, d), "*.txt", names=["src7.txt", "src1.txt", "gone.txt"])
    texts = sources.file_text(read_pages(found, form_feed_reader)).select("filename", "page_count", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.lit(True).alias("found"))
    return texts.unionAll(spark.createDataFrame([(x, None, None, False) for x in missing], "filename string, page_count long, text_md5 string, found boolean"))


@query(f"""WITH {O.QUALITY}, r AS (SELECT {_FILE} AS filename, count(*) AS page_count, round(avg(score), 6) AS quality_score, count(*) FILTER (flagged AND score < 0.85) AS flagged_pages, CASE WHEN bool_and(flagged) THEN 'surya' WHEN bool_or(flagged) THEN 'mixed' ELSE 'existing' END AS engine FROM q GROUP BY filename)
SELECT *, true AS success FROM r""")
def run_files(spark, d):
    """A whole run with a second engine that reads what was there: flagged pages lose the flag if only a floor set it."""
    out = scratch(spark, "run")
    files, _ = pipeline.run(spark, RunConfig(_page_files(spark, d), out, extract_text=True, diagnostics=True), _vocab(spark, d), make_engine=lambda: lambda pages: pages)
    return files.select("filename", "page_count", rounded("quality_score", 6).alias("quality_score"), "flagged_pages", "engine", "success")


@query(f"WITH {O.QUALITY}, g AS (SELECT filename, bool_or(flagged) AS bad FROM q GROUP BY filename) SELECT filename || '.txt' AS filename, page_number, CASE WHEN bad THEN 'tesseract' ELSE 'existing' END AS engine, flagged FROM q JOIN g USING (filename)")
def first_engine_pages(spark, d):
    """A run whose first engine reads files with a bad page again (and finds the same)."""
    _, pages = pipeline.run(spark, RunConfig(_page_files(spark, d), scratch(spark, "run")), _vocab(spark, d), first_engine=form_feed_reader)
    return pages.select("filename", "page_number", "engine", "flagged")


@query(f"WITH {O.QUALITY} SELECT filename, bool_and(NOT flagged) AS accepted, false AS accepted_if_forced FROM q GROUP BY filename")
def first_engine_gate(spark, d):
    """Files that need no engine, and none if it is forced."""
    q = quality(spark, d).withColumn("path", F.col("filename"))
    return pipeline.accepted(q).join(pipeline.accepted(q, True).withColumnRenamed("accepted", "accepted_if_forced"), "path").withColumnRenamed("path", "filename")


@query("WITH b AS (SELECT user_id, event_id // 7 AS sub_batch, value FROM events), s AS (SELECT sub_batch, sum(value) AS spent, count(*) AS n FROM b GROUP BY sub_batch), e AS (SELECT user_id, sub_batch, count(*) AS k FROM b GROUP BY ALL) SELECT CAST(user_id AS VARCHAR) AS path, CAST(sum(k) AS BIGINT) AS pages, round(sum(spent * k / n), 4) AS seconds FROM e JOIN s USING (sub_batch) GROUP BY user_id")
def batch_timings(spark, d):
    """Time of batches shared out to the files whose pages were in them."""
    e = sources.table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.floor(F.col("event_id") / 7).alias("sub_batch"), F.col("value").alias("seconds"))
    return pipeline.batch_seconds(e).withColumn("seconds", rounded("seconds", 4))


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'failed' END AS status FROM events WHERE event_id % 3 <> 0 AND epoch((SELECT max(ts) FROM events)) - epoch(ts) > 3600")
def expired_jobs(spark, d):
    """Events taken as jobs: those that are over for more than an hour at the time of the last."""
    e = sources.table(spark, d, "events")
    status = F.when(F.col("event_id") % 3 == 0, "running").when(F.col("event_id") % 3 == 1, "completed").otherwise("failed")
    jobs = e.select(F.col("event_id").alias("id"), status.alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    last = jobs.agg(F.max("us").alias("us")).first().us
    return service.expired_jobs(jobs.withColumn("created", F.col("us") / 1e6), last / 1e6).select("id", "status")


_WIDTH = 64


@query(f"""WITH p AS (SELECT doc_id, octet_length(encode(text)) // {_WIDTH} AS h, hex(encode(text)) AS x FROM documents),
v AS (SELECT doc_id, h, list_transform(range(CASE WHEN h >= 2 THEN h * {_WIDTH} ELSE 0 END), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS INT)) AS v FROM p),
l AS (SELECT doc_id, h, v, list_transform(range(len(v)), lambda i: v[CASE WHEN i < {_WIDTH} THEN i + {_WIDTH} ELSE i - {_WIDTH} END + 1] + v[CASE WHEN i >= (h - 1) * {_WIDTH} THEN i - {_WIDTH} ELSE i + {_WIDTH} END + 1] + v[CASE WHEN i % {_WIDTH} = 0 THEN i + 1 ELSE i - 1 END + 1] + v[CASE WHEN i % {_WIDTH} = {_WIDTH - 1} THEN i - 1 ELSE i + 1 END + 1] - 4 * v[i + 1]) AS l FROM v)
SELECT doc_id, round(list_aggregate(v, 'stddev_pop') / 255, 4) AS contrast, round(list_aggregate(l, 'var_pop'), 2) AS blur_score FROM l""")
def image_quality(spark, d):
    """Contrast and blur of each text's bytes, taken as a grey image of 64 pixels a row; fewer than two rows have none."""
    raw = F.encode("text", "utf-8")
    docs = sources.table(spark, d, "documents").select("doc_id", F.lit(_WIDTH).alias("width"), F.floor(F.length(raw) / _WIDTH).cast("int").alias("height"), raw.alias("pixels"))
    large = measured(docs.where("height >= 2")).select("doc_id", "contrast", "blur_score")
    return large.unionByName(docs.where("height IS NULL OR height < 2").select("doc_id"), allowMissingColumns=True)


@query("WITH l AS (SELECT source, n_chars % 97 - 48 AS x, doc_id % 41 - 20 AS y FROM documents), a AS (SELECT source, degrees(atan2(CAST(y AS DOUBLE), CAST(x AS DOUBLE))) AS a FROM l WHERE x <> 0) SELECT source AS filename, round(median(a), 2) AS skew_angle, count(*) AS n_lines FROM a WHERE abs(a) < 45 GROUP BY source")
def skew_by_file(spark, d):
    """Median angle of line segments made from lengths and ids."""
    z = F.lit(0)
    docs = sources.table(spark, d, "documents")
    return skew_of_lines(docs.select(F.col("source").alias("filename"), z.alias("x1"), z.alias("y1"), (F.col("n_chars") % 97 - 48).alias("x2"), (F.col("doc_id") % 41 - 20).alias("y2")), ["filename"])


@query("SELECT order_key AS id, round(avg(x) FILTER (x > 0), 2) AS dpi FROM (SELECT l_orderkey AS order_key, CAST(l_quantity AS DOUBLE) - 10 AS x FROM lineitem) GROUP BY order_key")
def resolution_by_order(spark, d):
    """Mean of the positive values of each order's quantities less ten, as resolutions of a page's images."""
    rows = sources.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_quantity").cast("double") - 10).alias("xres"))
    return rows.select("id", mean_dpi("xres").alias("dpi"))


_CLEANED = """u AS (SELECT doc_id AS id, nfc_normalize(replace(replace(replace(replace(replace(replace(text, chr(64256), 'ff'), chr(64257), 'fi'), chr(64258), 'fl'), chr(64259), 'ffi'), chr(64260), 'ffl'), chr(173), '')) AS t, len(regexp_extract_all(text, '[\\x{FB00}-\\x{FB04}\\x{AD}]')) AS n1 FROM documents),
h0 AS (SELECT id, n1, regexp_replace(regexp_replace(t, '(?i)(^|[^\\w])(?:(merleau)-\\n(ponty)|(sartre)-\\n(beauvoir)|(buber)-\\n(rosenzweig))\\b', '\\1\\2\\4\\6-\\3\\5\\7', 'g'), '(^|[^\\w])([A-Z]\\w*)-\\n([A-Z]\\w*)', '\\1\\2-\\3', 'g') AS t FROM u),
h AS (SELECT id, n1, regexp_replace(t, '(\\w+)-\\n(\\w+)', '\\1\\2', 'g') AS t, len(regexp_extract_all(t, '(\\w+)-\\n(\\w+)')) AS n2 FROM h0),
b AS (SELECT id, unnest(regexp_split_to_array(t, '\\n\\n+')) AS blk, generate_subscripts(regexp_split_to_array(t, '\\n\\n+'), 1) AS bi FROM h),
l AS (SELECT id, bi, unnest(string_split(blk, chr(10))) AS line, generate_subscripts(string_split(blk, chr(10)), 1) AS li FROM b),
p AS (SELECT *, lag(line) OVER (PARTITION BY id, bi ORDER BY li) AS prev, count(*) OVER (PARTITION BY id, bi) AS n FROM l),
k AS (SELECT *, regexp_matches(line, '^[ \\t]') AS indented, length(trim(prev)) < 60 AND regexp_matches(rtrim(line), '^\\p{Lu}') AS begins FROM p),
k2 AS (SELECT *, CASE WHEN n = 1 THEN line WHEN li = 1 THEN rtrim(line) WHEN indented THEN chr(10) || line WHEN begins THEN chr(10) || rtrim(line) ELSE ' ' || rtrim(line) END AS piece, CASE WHEN n = 1 OR li = 1 OR indented OR begins THEN 0 ELSE 1 END AS j FROM k),
g AS (SELECT id, bi, string_agg(piece, '' ORDER BY li) AS blk, sum(j) AS j FROM k2 GROUP BY id, bi),
j AS (SELECT id, string_agg(blk, chr(10) || chr(10) ORDER BY bi) AS t, sum(j) AS n3 FROM g GROUP BY id),
s1 AS (SELECT id, n3, t AS t0, regexp_replace(t, '\\s+([.,;:!?])', '\\1', 'g') AS t1 FROM j), s2 AS (SELECT *, regexp_replace(t1, '  +', ' ', 'g') AS t2 FROM s1), s3 AS (SELECT *, regexp_replace(t2, '[ \\t]+(\\n)', '\\1', 'g') AS t3 FROM s2),
done AS (SELECT h.id AS doc_id, regexp_replace(t3, '[ \\t]+$', '', 'g') AS text, CAST(n1 AS INT) AS unicode_normalizations, CAST(n2 AS INT) AS dehyphenations, CAST(n3 AS INT) AS paragraph_joins, CAST(len(regexp_extract_all(t0, '\\s+[.,;:!?]')) + len(regexp_extract_all(t1, '  +')) + len(regexp_extract_all(t2, '[ \\t]+\\n')) + len(regexp_extract_all(t3, '[ \\t]+$')) AS INT) AS punctuation_fixes FROM h JOIN s3 ON h.id = s3.id)"""
_COUNTS = ("unicode_normalizations", "dehyphenations", "paragraph_joins", "punctuation_fixes")

#: The whole-table form of the clean-up steps, each stated on its own in queries.py.
ORACLE_SQL["postprocess_documents"] = f"WITH {_CLEANED} SELECT doc_id, sha256(text) AS text_sha256, {', '.join(_COUNTS)} FROM done"


@query(f"WITH {_CLEANED} SELECT source AS filename, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _COUNTS)} FROM done JOIN documents USING (doc_id) GROUP BY source")
def cleanup_by_file(spark, d):
    """What the clean-up of its pages changed, by file."""
    docs = sources.table(spark, d, "documents")
    counts = X.postprocess(F.col("text"))[1]
    return docs.select(F.col("source").alias("filename"), *[c.alias(k) for k, c in counts.items()]).groupBy("filename").agg(*[F.sum(k).cast("long").alias(k) for k in counts])


@query("SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[greatest(1, len(string_split(text, chr(10))) - 2):], chr(10))) AS end_md5 FROM documents")
def last_lines_of_documents(spark, d):
    """The last three lines of each document."""
    return sources.table(spark, d, "documents").select("doc_id", F.md5(X.last_lines(F.col("text"), 3).cast("binary")).alias("end_md5"))


@query("WITH t AS (SELECT doc_id, regexp_replace(text, '[.] ', chr(10) || '---' || chr(10), 'g') AS t, doc_id % 4 AS n FROM documents), r AS (SELECT *, regexp_split_to_array(t, '\\n-{3,}\\n') AS r, regexp_split_to_array(t, '\\n{3,}') AS b FROM t) SELECT doc_id, md5(array_to_string(CASE WHEN n <= 0 THEN [] WHEN n = 1 THEN [t] WHEN len(r) >= n THEN r[1:n] WHEN len(b) >= n THEN b[1:n] ELSE list_concat([t], list_transform(range(n - 1), lambda x: '')) END, '|')) AS parts_md5 FROM r")
def split_documents(spark, d):
    """Documents with rules for full stops, split into 0 to 3 pages."""
    t = F.regexp_replace("text", "[.] ", "\n---\n")
    return sources.table(spark, d, "documents").select("doc_id", F.md5(F.array_join(X.split_markdown(t, (F.col("doc_id") % 4).cast("int")), "|").cast("binary")).alias("parts_md5"))


@query("SELECT doc_id, md5(nfc_normalize(replace(text, chr(173), ''))) AS out_md5 FROM documents")
def unicode_documents(spark, d):
    """Every document with its ligatures, soft hyphens and composed letters in order."""
    return sources.table(spark, d, "documents").select("doc_id", F.md5(X.normalize_unicode(F.col("text"))[0].cast("binary")).alias("out_md5"))


_STATUS = "CASE WHEN flagged THEN 'flagged' ELSE 'good' END"
_ENGINE = "CASE WHEN score < 0.8 THEN 'surya' WHEN page_number % 2 = 0 THEN 'tesseract' ELSE 'existing' END"


@query(f"WITH {O.QUALITY} SELECT filename, page_number, to_json({{page_number: page_number, status: {_STATUS}, quality_score: round(score, 6), engine: {_ENGINE}, flagged: flagged}}) AS json FROM q")
def page_records(spark, d):
    """Each page's record as JSON."""
    from .queries import _engine

    q = _engine(quality(spark, d)).withColumns({"quality_score": rounded("score", 6), "status": F.when(F.col("flagged"), "flagged").otherwise("good")})
    return rollups.page_json(q).select("filename", "page_number", "json")


ORACLE_SQL["result_json"] = f"""WITH {O.QUALITY}, r AS (SELECT *, round(score, 6) AS s, {_ENGINE} AS e FROM q)
SELECT filename, to_json({{filename: filename, page_count: count(*), quality_score: round(avg(score), 6), flagged_pages: count(*) FILTER (flagged), engine: CASE WHEN count(DISTINCT e) = 1 THEN min(e) ELSE 'mixed' END, success: true, pages: list({{page_number: page_number, status: {_STATUS}, quality_score: s, engine: e, flagged: flagged}} ORDER BY page_number)}}) AS json FROM r GROUP BY filename"""

_BY_FILE = "(SELECT map_from_entries(list({{k: filename, v: l}} ORDER BY filename)) FROM (SELECT filename, list(page_number ORDER BY page_number) AS l FROM {0} GROUP BY filename))"
ORACLE_SQL["page_selection"] = f"""WITH d AS ({ORACLE_SQL['difficult_pages']}), r AS ({ORACLE_SQL['regression_pages']}), c AS ({ORACLE_SQL['category_coverage']})
SELECT to_json({{difficult: {_BY_FILE.format('d')}, regression: {_BY_FILE.format('r')}, total_pages: (SELECT count(*) FROM d) + (SELECT count(*) FROM r), coverage_summary: (SELECT map_from_entries(list({{k: category, v: n_pages}} ORDER BY category)) FROM c)}}) AS json"""


_CONF = "CAST((length(ws[i]) * 7 + (i - 1) * 13) % 101 AS INT)"


@query(f"""WITH {O.QUALITY}, cw AS (SELECT filename, page_number, {_CONF} AS conf, greatest(1, length(ws[i])) AS g FROM (SELECT filename, page_number, ws, unnest(range(1, len(ws) + 1)) AS i FROM tok WHERE page_number % 3 = 0)),
cu AS (SELECT filename, page_number, sum(conf * g) / sum(g) / 100 AS c FROM cw WHERE conf > 0 GROUP BY ALL),
x AS (SELECT q.*, CASE WHEN page_number % 3 = 0 THEN coalesce(c, 0.5) END AS c FROM q LEFT JOIN cu USING (filename, page_number)),
y AS (SELECT *, 0.4 * garbled_score + 0.3 * dictionary_score + 0.3 * c AS b FROM x),
z AS (SELECT *, CASE WHEN c IS NULL THEN score WHEN c > 0.95 THEN greatest(b, 0.9) WHEN c < 0.2 THEN least(b, 0.3) ELSE b END AS s FROM y)
SELECT filename, page_number, round(c, 6) AS confidence_score, round(s, 6) AS score, s < 0.85 OR garbled_score < 0.5 OR dictionary_score < 0.4 OR coalesce(c < 0.3, false) AS flagged FROM z""")
def composite_with_words(spark, d):
    """Word confidences of every third page, put beside the pages; the others do without that signal."""
    from ..functions import tokens as T

    conf = lambda x, i: F.struct(x.alias("text"), ((F.length(x) * 7 + i * 13) % 101).cast("int").alias("conf"))
    pages = sources.document_pages(spark, d).select(*KEY, "text")
    words = pages.where("page_number % 3 = 0").select(*KEY, F.transform(T.tokens(F.col("text")), conf).alias("words"))
    both = signals.with_words(pages, words, KEY)
    marked = signals.garbled(both).drop("text", "sample_issues", "sample_context").join(_dictionary(spark, d), KEY).withColumns(signals.confidence(F.col("words")))
    return signals.scored(marked).select(*KEY, rounded("confidence_score", 6).alias("confidence_score"), rounded("score", 6).alias("score"), "flagged")


@query(f"WITH {O.QUALITY}, m AS (SELECT DISTINCT filename, CAST(substr(filename, 4) AS INT) AS k FROM q) SELECT filename AS id, page_number, CASE WHEN k % 2 = 0 THEN round(score, 6) END AS quality_score, CASE WHEN k % 2 = 0 THEN flagged END AS flagged FROM q JOIN m USING (filename) WHERE k % 2 = 0 UNION ALL SELECT filename, NULL, NULL, NULL FROM m WHERE k % 2 = 1")
def stored_diagnostics(spark, d):
    """A manifest of all files meets the diagnostics that were written for every second one; the others have none."""
    folder = scratch(spark, "corpus")
    q = diagnosed(spark, d)
    names = q.select("filename").distinct()
    docs = names.select(F.struct(F.col("filename").alias("id"), F.col("filename").alias("title")).alias("d")).agg(F.collect_list("d").alias("documents"))
    docs.select(F.to_json(F.struct("documents")).alias("value")).coalesce(1).write.text(f"{folder}/manifest")
    even = q.where(F.substring("filename", 4, 9).cast("int") % 2 == 0).withColumns({"path": F.col("filename"), "engine": F.lit("existing"), "score": rounded("score", 6)})
    sinks.write_diagnostics(even, f"{folder}/lines", {})
    lines = spark.read.text(f"{folder}/lines").select(F.concat(F.get_json_object("value", "$.filename"), F.lit(".diagnostics.json")).alias("path"), F.encode("value", "utf-8").alias("content"))
    sinks.copy_files(lines, f"{folder}/sidecars").write.format("noop").mode("overwrite").save()
    found, without = sources.sidecars(spark, f"{folder}/sidecars", sources.manifest(spark, f"{folder}/manifest"))
    return found.select("id", F.col("page_number").cast("long").alias("page_number"), "quality_score", "flagged").unionByName(without.select("id"), allowMissingColumns=True)


@query(f"WITH {O.QUALITY} SELECT filename, page_number, CASE WHEN filename <> 'src3' THEN 'in/' || filename || '.txt' END AS input_path FROM q WHERE flagged")
def flagged_paths(spark, d):
    """Flagged pages with the path of their file; those of one file that is not there have none."""
    q = quality(spark, d)
    files = q.select("filename").distinct().where("filename <> 'src3'").withColumn("path", F.concat(F.lit("in/"), "filename", F.lit(".txt")))
    found, without = batching.with_paths(signals.bad_pages(q, KEY), files)
    return found.select(*KEY, "input_path").unionByName(without.select(*KEY), allowMissingColumns=True)


@query(f"WITH {O.PAGES}, g AS (SELECT filename, list(page_number ORDER BY page_number) FILTER (doc_id % 7 = 0 AND filename <> 'src2') AS l FROM pages_ GROUP BY filename) SELECT filename AS id, coalesce(array_to_string(l, ','), '') AS pages FROM g")
def ground_truth(spark, d):
    """Pages of each document that have a ground truth in its record (one document has no such map)."""
    pages = sources.document_pages(spark, d)
    entry = F.when((F.col("doc_id") % 7 == 0) & (F.col("filename") != "src2"), F.struct(F.col("page_number").cast("string").alias("k"), F.col("doc_id").cast("string").alias("v")))
    docs = pages.groupBy(F.col("filename").alias("id")).agg(F.collect_list(entry).alias("e")).select("id", F.when(F.size("e") > 0, F.map_from_entries("e")).alias("ground_truth_pages"))
    return sources.ground_truth_pages(docs).select("id", F.array_join("pages", ",").alias("pages"))


@query("SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_split_to_array(text, '[^a-zA-Z]+')) AS w FROM documents) WHERE w <> ''")
def word_list_read_back(spark, d):
    """A word list file with blank lines, capitals and repeats, made of the words of all documents."""
    path = scratch(spark, "words")
    words = sources.table(spark, d, "documents").select(F.explode(F.split("text", "[^a-zA-Z]+")).alias("value"))
    words.select(F.concat(F.lit(" "), "value", F.lit("  ")).alias("value")).write.text(path)
    return sources.word_list(spark, path)


@query(f"WITH {O.STRUGGLE}, d AS ({ORACLE_SQL['difficult_pages']}) SELECT filename, array_to_string(list(page_number ORDER BY page_number), ',') AS pages, (SELECT count(*) FROM d) AS total FROM d GROUP BY filename")
def selected_by_file(spark, d):
    """Selected pages grouped by file, and their total."""
    chosen = stored(coverage.difficult_pages(diagnosed(spark, d)), "selected")
    return coverage.pages_by_file(chosen).select("filename", F.array_join("pages", ",").alias("pages"), F.lit(chosen.count()).cast("long").alias("total"))
