"""Token and page-signal expressions. Everything here is a built-in expression over a row: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

#: White space as str.split sees it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def cleaned(token: Column) -> Column:
    """The token without punctuation at its ends."""
    return F.btrim(token, F.lit(L.EDGE_PUNCTUATION))


def reference_pattern(ignore_case: str = "(?iu:{})") -> str:
    """One alternation for all reference patterns, anchored at the token's start."""
    parts = []
    for pattern, cased, free in L.REFERENCE_PATTERNS:
        body = pattern.replace(r"\d", r"\p{Nd}")
        body = body if cased else ignore_case.format(body)
        parts.append(body if free else body + "$")
    return "^(?:" + "|".join(parts) + ")"


CONSONANTS, SYMBOLS, WEIRD_CASE, CONTROL = L.CONSONANT_RUN, L.SYMBOL_RUN, L.WEIRD_CASE, L.CONTROL_CHARACTER
SUFFIXES = "(?:" + "|".join(L.GERMAN_SUFFIXES) + ")$"


#: What a token with an issue must hold: a run of consonants, a capital after a small letter, a sign
#: that is neither letter, full stop nor comma, or two of those in a row. One search spares most tokens the rules.
SUSPECT = "(?iu:" + CONSONANTS + r")|[a-z][A-Z]|[^\p{L}.,]|[.,]{2}"


def issue(word: Column) -> Column:
    """What is wrong with a cleaned token: an issue type, or null. Skipped tokens have none."""
    lower = F.lower(word)
    skipped = (F.length(word) < 2) | lower.isin(L.VALID_SHORT) | word.rlike(reference_pattern()) | lower.isin(L.VALID_TERMS)
    alpha = F.regexp_count(word, F.lit(r"\p{L}"))
    return (
        F.when(skipped, None)
        .when((F.length(word) > 4) & (alpha / F.length(word) < 0.3), "low_alpha")
        .when(word.rlike("(?iu)" + CONSONANTS) & ~lower.rlike(SUFFIXES), "consonant_cluster")
        .when(word.rlike(SYMBOLS), "symbol_run")
        .when(word.rlike(WEIRD_CASE), "weird_case")
        .when(word.rlike(CONTROL), "control_char")
    )


def too_short(text: Column) -> Column:
    """Pages of fewer than 100 characters are not judged."""
    return text.isNull() | (F.length(stripped(text)) < 100)


def dictionary_word(token: Column) -> Column:
    return stripped(F.translate(token, L.DELETED_PUNCTUATION, ""))


def is_scored(word: Column) -> Column:
    return (F.length(word) >= 3) & word.rlike(r"\p{L}")


def structurally_valid(word: Column) -> Column:
    lower = F.lower(word)
    n = F.length(lower)
    vowels = F.regexp_count(lower, F.lit(f"[{L.VOWELS}]")) / F.greatest(n, F.lit(1))
    bad = (
        ((vowels < 0.1) & (n > 3))
        | ((vowels > 0.9) & (n > 4))
        | lower.rlike(r"(.)\1{3,}")
        | lower.rlike(r"(..)\1{2,}")
        | ((n > 6) & (F.size(F.array_distinct(F.split(lower, ""))) / F.greatest(n, F.lit(1)) < 0.3))
    )
    return (n < 2) | ~bad
