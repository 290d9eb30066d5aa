"""Page signals: garbled tokens, dictionary share, word confidence, and their composite."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import tokens as T
from ..functions.numbers import rounded
from ..scratch import stored


@dataclass
class QualityConfig:
    threshold: float = 0.85
    max_samples: int = 10
    collect_context: bool = False
    floors: dict[str, float] = field(default_factory=lambda: dict(L.FLOORS))


def garbled(pages: DataFrame, config: QualityConfig | None = None) -> DataFrame:
    """Adds garbled_score, garbled_count, total_words, sample_issues and sample_context to pages."""
    c = config or QualityConfig()
    short = T.too_short(F.col("text"))
    words = F.when(short, F.array().cast("array<string>")).otherwise(T.tokens(F.col("text")))
    out = pages.withColumn("words__", words)
    # The struct's fields: cleaned word, issue, place. Only tokens with an issue stay.
    placed = F.filter(F.transform("words__", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x.w.rlike(T.SUSPECT))
    found = F.filter(F.transform(placed, lambda x: F.struct(T.cleaned(x.w).alias("w"), T.issue(T.cleaned(x.w)).alias("t"), x.i.alias("i"))), lambda x: x.t.isNotNull())
    out = out.withColumn("found__", found)
    total, bad = F.size("words__"), F.size("found__")
    samples = F.slice("found__", 1, c.max_samples)
    # A window of five words on either side.
    context = F.transform(samples, lambda x: F.concat(F.lit("..."), F.array_join(F.slice(F.col("words__"), F.greatest(x.i - 4, F.lit(1)), x.i + 6 - F.greatest(x.i - 5, F.lit(0))), " "), F.lit("...")))
    return out.withColumns({
        "garbled_count": bad,
        "total_words": total,
        "garbled_score": F.when(total == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - 2.0 * bad / total)),
        "sample_issues": F.transform(samples, lambda x: F.concat(x.w, F.lit(" ("), x.t, F.lit(")"))),
        "sample_context": context if c.collect_context else F.array().cast("array<string>"),
    }).drop("words__", "found__")


#: Judged tokens up to which every task gets them all (some 60 bytes each).
BROADCAST_WORDS = 2_000_000
#: Beyond that, tokens that make up more than one in so many of the (page, token) pairs go to every task.
HOT_SHARE = 100_000


def token_words(tokens: DataFrame) -> DataFrame:
    """Rows (token, word) of the distinct tokens of a column `token` whose word counts."""
    return tokens.select("token").distinct().withColumn("word", T.dictionary_word(F.col("token"))).where(T.is_scored(F.col("word")))


def judged_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows (token, known, valid) of the distinct tokens that count: in the vocabulary, or built like a word."""
    listed = vocab.select(F.col("word").alias("lower__")).distinct().withColumn("known", F.lit(True))
    each = token_words(tokens).withColumn("lower__", F.lower("word")).join(listed, "lower__", "left")
    known = F.coalesce("known", F.lit(False))
    return each.select("token", known.alias("known"), (known | T.structurally_valid(F.col("word"))).alias("valid"))


def dictionary(pages: DataFrame, vocab: DataFrame, key: list[str]) -> DataFrame:
    """Rows key + (known, structured, unknown, scored, dictionary_score) for every page.

    Distinct tokens are judged once and meet the pages' tokens again by a broadcast of checked size. A larger
    table is split: its commonest tokens (a bounded number) are broadcast, the others meet the counted tokens
    of each page by a shuffle in which no token is hot.
    """
    tokens = pages.select(*key, F.explode(T.tokens(F.col("text"))).alias("token"))
    judged = stored(judged_tokens(tokens, vocab), "judged-tokens")
    if judged.count() <= BROADCAST_WORDS:
        marked = tokens.join(F.broadcast(judged), "token").withColumn("n", F.lit(1).cast("long"))
    else:
        counted = stored(tokens.groupBy(*key, "token").agg(F.count("*").alias("n")), "page-tokens")
        hot = counted.groupBy("token").agg(F.count("*").alias("pages")).where(F.col("pages") > counted.count() // HOT_SHARE).select("token")
        hot = stored(judged.join(hot, "token"), "hot-tokens")  # HOT_SHARE rows at most
        marked = counted.join(F.broadcast(hot), "token").unionByName(counted.join(F.broadcast(hot), "token", "left_anti").join(judged, "token"))
    known, valid, n = F.col("known"), F.col("valid"), F.col("n")
    share = lambda which: F.sum(F.when(which, n).otherwise(0))
    counts = marked.groupBy(*key).agg(share(known).alias("known"), share(~known & valid).alias("structured"), share(~valid).alias("unknown"), F.sum(n).alias("scored"))
    joined = pages.select(*key).join(counts, key, "left").na.fill(0, ["known", "structured", "unknown", "scored"])
    score = F.when(F.col("scored") == 0, 1.0).otherwise(rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("known") + 0.5 * F.col("structured")) / F.col("scored"))), 4))
    return joined.withColumn("dictionary_score", score)


def confidence(words: Column) -> dict[str, Column]:
    """Columns of the confidence signal for an array of (text, conf): weighted by word length.

    A null array means no such data; an array without a usable word scores 0.5.
    """
    usable = F.filter(words, lambda w: (w.conf > 0) & (T.stripped(w.text) != ""))
    weight = F.aggregate(usable, F.lit(0).cast("long"), lambda s, w: s + F.greatest(F.lit(1), F.length(w.text)))
    total = F.aggregate(usable, F.lit(0).cast("long"), lambda s, w: s + w.conf * F.greatest(F.lit(1), F.length(w.text)))
    none = F.size(usable) == 0
    return {
        "confidence_score": F.when(words.isNull(), None).when(none, 0.5).otherwise(total / weight / 100),
        "word_count": F.when(words.isNull(), None).otherwise(F.size(usable)),
        "mean_conf": F.when(~none, rounded(total / weight, 2)),
        "min_conf": F.when(~none, F.array_min(F.transform(usable, lambda w: w.conf))),
        "low_words": F.slice(F.transform(F.filter(usable, lambda w: w.conf < 30), lambda w: w.text), 1, 20),
    }


def with_words(pages: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """Pages with the word confidences (a column `words`) that were read for them; null where none were."""
    return pages.join(words.select(*key, "words"), key, "left")


def composite(garbled_score: Column, dictionary_score: Column, confidence_score: Column | None = None) -> Column:
    """The weighted mean of the signals that are there, with the limits of very high and very low confidence."""
    a, b = L.WEIGHTS_WITHOUT_CONFIDENCE, L.WEIGHTS_WITH_CONFIDENCE
    without = (a["garbled"] * garbled_score + a["dictionary"] * dictionary_score) / (a["garbled"] + a["dictionary"])
    if confidence_score is None:
        return without
    mixed = (b["garbled"] * garbled_score + b["dictionary"] * dictionary_score + b["confidence"] * confidence_score) / sum(b.values())
    limited = F.when(confidence_score > 0.95, F.greatest(mixed, F.lit(0.9))).when(confidence_score < 0.2, F.least(mixed, F.lit(0.3))).otherwise(mixed)
    return F.when(confidence_score.isNull(), without).otherwise(limited)


def is_flagged(score: Column, garbled_score: Column, dictionary_score: Column, confidence_score: Column | None = None, config: QualityConfig | None = None) -> Column:
    """Below the threshold, or any signal below its floor."""
    c = config or QualityConfig()
    low = (score < c.threshold) | (garbled_score < c.floors["garbled"]) | (dictionary_score < c.floors["dictionary"])
    return low if confidence_score is None else low | F.coalesce(confidence_score < c.floors["confidence"], F.lit(False))


def in_gray_zone(score: Column, threshold: float = 0.85) -> Column:
    return F.abs(score - threshold) < 0.05


def page_quality(pages: DataFrame, vocab: DataFrame, key: list[str], config: QualityConfig | None = None, words: str | None = None) -> DataFrame:
    """All signals of every page, the composite score and the flag; `words` names a confidence column."""
    c = config or QualityConfig()
    out = garbled(pages, c).join(dictionary(pages, vocab, key), key)
    if words is not None:
        out = out.withColumns(confidence(F.col(words)))
    return scored(out, c)


def scored(signalled: DataFrame, config: QualityConfig | None = None) -> DataFrame:
    """Adds score and flagged to rows with garbled_score, dictionary_score and, where known, confidence_score."""
    conf = F.col("confidence_score") if "confidence_score" in signalled.columns else None
    out = signalled.withColumn("score", composite(F.col("garbled_score"), F.col("dictionary_score"), conf))
    return out.withColumn("flagged", is_flagged(F.col("score"), F.col("garbled_score"), F.col("dictionary_score"), conf, config))


def bad_pages(scored: DataFrame, key: list[str]) -> DataFrame:
    return scored.where("flagged").select(*key)


def vocabulary(documents: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """Words of at least `least` documents of good quality."""
    good = documents.join(labels.where("quality = 1").select("doc_id"), "doc_id")
    tokens = good.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    words = tokens.select("doc_id", F.lower(T.dictionary_word(F.col("token"))).alias("word")).where(T.is_scored(F.col("word")))
    return words.distinct().groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word")
