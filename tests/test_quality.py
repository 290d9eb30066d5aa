"""Page signals against goldens and an independent plain-Python reading of the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafgrade.functions import lexicon as L
from leafgrade.functions import tokens as T
from leafgrade.operators import diagnostics, signals

CLEAN = "The quick brown fox jumps over the lazy dog near the river bank. " * 20
GARBLED = "xkjhgfdq bcdfghjkl ###@@@ qwrtpsdfg zxcvbnmk " * 20


def page_rows(spark, texts):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "filename string, page_number long, text string")


def plain_issue(word):
    lower = word.lower()
    if len(word) < 2 or lower in L.VALID_SHORT:
        return None
    for pattern, cased, free in L.REFERENCE_PATTERNS:
        if re.match("^" + pattern + ("" if free else "$"), word, 0 if cased else re.I):
            return None
    if lower in L.VALID_TERMS:
        return None
    if len(word) > 4 and sum(c.isalpha() for c in word) / len(word) < 0.3:
        return "low_alpha"
    if re.search("[bcdfghjklmnpqrstvwxz]{6,}", word, re.I) and not lower.endswith(tuple(L.GERMAN_SUFFIXES)):
        return "consonant_cluster"
    if re.search(r"[^\w\s.,;:!?'\"\-–—…*()]{3,}", word):
        return "symbol_run"
    if re.search(r"\b[A-Z][a-z]+[A-Z][a-z]*\b", word):
        return "weird_case"
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", word):
        return "control_char"
    return None


def plain_valid(word):
    w = word.lower()
    if len(w) < 2:
        return True
    vowels = sum(c in L.VOWELS for c in w) / len(w)
    bad = (vowels < 0.1 and len(w) > 3) or (vowels > 0.9 and len(w) > 4) or re.search(r"(.)\1{3,}", w) or re.search(r"(..)\1{2,}", w) or (len(w) > 6 and len(set(w)) / len(w) < 0.3)
    return not bad


def random_words(n):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZ0123456789éüß#@§.-–()[]\x7f"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(n)] + ["McDonald", "Bewusstsein", "ISBN978", "pp.12", "12-34", "xviii", "A12", "1.2x", "AB1z", "strngthskeit", "###", "1973", "§12"]


def test_issue_rules_match_a_plain_reading(spark):
    words = [w.strip(L.EDGE_PUNCTUATION) for w in random_words(3000)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.issue(F.col("w")).alias("t")).collect()
    assert {(r.w, r.t) for r in rows} == {(w, plain_issue(w)) for w in words}


def test_structural_validity_matches_a_plain_reading(spark):
    words = random_words(3000) + ["aaaab", "ababab", "banana", "mississippi", "aaaaaaab"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.structurally_valid(F.col("w")).alias("v")).collect()
    assert {(r.w, r.v) for r in rows} == {(w, plain_valid(w)) for w in words}


def test_garbled_scores(spark):
    rows = {r.page_number: r for r in signals.garbled(page_rows(spark, [CLEAN, GARBLED, "", None, "short", "... !!! " * 40])).collect()}
    assert rows[0].garbled_score == 1.0 and rows[0].garbled_count == 0
    assert rows[1].garbled_score < 0.3 and rows[1].total_words == 100
    assert [(rows[i].garbled_score, rows[i].total_words) for i in (2, 3, 4)] == [(1.0, 0)] * 3
    assert rows[5].garbled_count == 0 and len(rows[1].sample_issues) == 10


def test_context_is_five_tokens_either_side(spark):
    words = [f"word{chr(97 + i % 26)}" for i in range(30)]
    words[8] = "bcdfghjklm"
    got = signals.garbled(page_rows(spark, [" ".join(words)]), signals.QualityConfig(collect_context=True)).first()
    assert got.sample_issues == ["bcdfghjklm (consonant_cluster)"]
    assert got.sample_context == ["..." + " ".join(words[3:14]) + "..."]


def test_dictionary_counts(spark):
    vocab = spark.createDataFrame([("known",), ("words",)], "word string")
    got = {r.page_number: r for r in signals.dictionary(page_rows(spark, ["Known words, xkcdqrtz plausible 123 ab", "", "12 34"]), vocab, ["filename", "page_number"]).collect()}
    assert (got[0].known, got[0].structured, got[0].unknown, got[0].scored) == (2, 1, 1, 4)
    assert got[0].dictionary_score == pytest.approx(0.625) and got[1].dictionary_score == 1.0 and got[2].dictionary_score == 1.0


def test_confidence(spark):
    rows = spark.createDataFrame([(0, [("word", 90)] * 50), (1, []), (2, None), (3, [("abcd", 80), ("x", 20), (" ", 99), ("zero", 0)])], "id int, w array<struct<text:string,conf:int>>")
    got = {r.id: r for r in rows.withColumns(signals.confidence(F.col("w"))).collect()}
    assert got[0].confidence_score == pytest.approx(0.9) and got[1].confidence_score == 0.5 and got[2].confidence_score is None
    assert got[3].confidence_score == pytest.approx((80 * 4 + 20) / 5 / 100) and got[3].low_words == ["x"] and got[3].min_conf == 20


def test_composite_and_flags(spark):
    rows = spark.createDataFrame([(0, 1.0, 1.0, 0.1), (1, 0.2, 0.2, 0.99), (2, 0.9, 0.8, None), (3, 1.0, 0.39, None)], "id int, g double, d double, c double")
    score = signals.composite(F.col("g"), F.col("d"), F.col("c"))
    got = {r.id: r for r in rows.withColumn("s", score).withColumn("f", signals.is_flagged(F.col("s"), F.col("g"), F.col("d"), F.col("c"))).collect()}
    assert got[0].s == 0.3 and got[0].f and got[1].s == 0.9 and got[1].f
    assert got[2].s == pytest.approx(0.855) and not got[2].f and got[3].f


def test_struggles_and_disagreement(spark):
    rows = spark.createDataFrame([(0, 0.5, 0.9, 0.84, None), (1, 0.9, 0.3, 0.6, 0.8), (2, 0.5, 0.3, 0.4, None), (3, 0.3, 0.9, 0.5, 0.2)], "id int, g double, d double, s double, c double")
    got = {r.id: list(r.x) for r in rows.withColumn("x", diagnostics.struggles(F.col("s"), F.col("g"), F.col("d"), F.col("c"))).collect()}
    assert got[0] == ["character_confusion", "signal_disagreement", "gray_zone"]
    assert got[1] == ["vocabulary_miss", "layout_error", "signal_disagreement"]
    assert got[2] == ["language_confusion"] and got[3] == ["bad_scan", "character_confusion", "signal_disagreement"]
    pairs = rows.withColumn("p", diagnostics.disagreements({"garbled": F.col("g"), "dictionary": F.col("d"), "confidence": F.col("c")})).where("id = 1").first().p
    assert [(list(p.signals), p.magnitude) for p in pairs] == [(["garbled", "dictionary"], 0.6), (["garbled", "confidence"], 0.1), (["dictionary", "confidence"], 0.5)]


def test_word_diff():
    assert diagnostics.word_diff("a b c", "a x c d") == {"additions": ["d"], "deletions": [], "substitutions": [{"old": "b", "new": "x"}]}
    assert diagnostics.word_diff(None, "a") == {"additions": ["a"], "deletions": [], "substitutions": []}


def test_the_search_before_the_rules_loses_nothing(spark):
    rng = random.Random(11)
    words = random_words(2000) + ["".join(rng.choice("ab.,-A#") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(w,) for w in words if w.split() == [w]], "w string")
    assert rows.where(T.issue(T.cleaned(F.col("w"))).isNotNull() & ~F.col("w").rlike(T.SUSPECT)).count() == 0
