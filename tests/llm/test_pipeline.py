"""Each stage of the pipeline judged on its own input, and the whole on planted cases."""

import random

import corpus_pipeline
import pytest

from test_operators import plain_components, plain_contamination, plain_cover, prose


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(12)
    texts, toxic = [], []
    for i in range(300):
        t = prose(rng, rng.randint(20, 150))
        bad = i % 6 == 0
        texts.append(t + ". " + rng.choice(["vilewort", "badling"]) + " " + t[:20] if bad else t)
        toxic.append(int(bad))
    item = prose(rng, 30)
    passage = prose(rng, 120)
    plain = len(texts)
    texts += [texts[1], texts[1] + " more", passage + prose(rng, 60), prose(rng, 60) + passage, prose(rng, 20) + " " + item, None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return tmp_path, texts, toxic, item, plain


def test_stages(spark, folder):
    path, texts, toxic, item, plain = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "ngram_jaccard", "suffix_array", "decontamination", "sentencepiece"]

    kept = steps["toxicity"](spark, docs, str(path))
    assert kept.columns == columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert sum(i in ids for i, y in enumerate(toxic) if y) <= 3 and sum(i not in ids for i, y in enumerate(toxic) if not y) <= 3
    assert {plain + 5, plain + 6} <= ids

    one = steps["ngram_jaccard"](spark, docs, str(path))
    assert one.columns == columns
    groups = plain_components(texts)
    assert sorted(r.doc_id for r in one.select("doc_id").collect()) == sorted(i for i, (_, c) in groups.items() if i == c)

    cut = {r.doc_id: r for r in steps["suffix_array"](spark, docs, str(path)).collect()}
    raw = [(t or "").encode() for t in texts]
    cover = plain_cover(raw, corpus_pipeline.PASSAGE_BYTES)
    for i, b in enumerate(raw):
        left = bytes(x for p, x in enumerate(b) if p not in cover[i]).decode()
        assert cut[i].text == left and cut[i].n_chars == len(left)

    clean = {r.doc_id for r in steps["decontamination"](spark, docs, str(path)).collect()}
    assert clean == {i for i, (*_, bad) in plain_contamination(texts, [(0, item)]).items() if not bad}


def test_run(spark, folder):
    path, texts, toxic, item, plain = folder
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(path)).collect()}
    assert plain not in got and plain + 4 not in got and plain + 5 in got
