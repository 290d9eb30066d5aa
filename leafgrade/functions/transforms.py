"""Text clean-up as column expressions, each with a count of what it changed."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon as L
from .tokens import SPACE, stripped


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def normalize_unicode(text: Column) -> tuple[Column, Column]:
    """Ligatures spelled out, soft hyphens dropped, NFC. The count leaves NFC out.

    NFC has no built-in form, so that part is an Arrow UDF.
    """
    out = text
    for ligature, letters in L.LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    count = F.regexp_count(text, F.lit("[" + "".join(L.LIGATURES) + L.SOFT_HYPHEN + "]"))
    return _nfc(F.replace(out, F.lit(L.SOFT_HYPHEN), F.lit(""))), count


_PAIR = r"(?U)(\w+)-\n(\w+)"
_CHAIN = r"(?U)\w-\n\w+-\n\w"
_CAPITALS = r"(?U)(?<!\w)(\p{Lu}\w*)-\n(\p{Lu}\w*)"
_NAMES = "(?iuU)(?<!\\w)(?:" + "|".join("({})-\\n({})(?!\\w)".format(*n.split("-")) for n in L.HYPHENATED_NAMES) + ")"


def _join_pair(m: re.Match) -> str:
    left, right = m[1], m[2]
    keep = f"{left}-{right}".lower() in L.HYPHENATED_NAMES or (left[0].isupper() and right[0].isupper())
    return f"{left}-{right}" if keep else left + right


@F.pandas_udf(StringType())
def _dehyphenate_chains(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else re.sub(r"(\w+)-\n(\w+)", _join_pair, x))


def dehyphenate(text: Column, chains: bool = False) -> tuple[Column, Column]:
    """Words broken by a hyphen at a line end are joined; known names and pairs of capitals keep the hyphen.

    The built-in form is exact unless a word is broken twice in a row; `chains` takes the form for that.
    """
    names = F.regexp_replace(text, _NAMES, "$1$3$5-$2$4$6")
    kept = F.regexp_replace(names, _CAPITALS, "$1-$2")
    if chains:
        out = _dehyphenate_chains(text)
        lost = F.length(text) - F.length(out) - F.regexp_count(text, F.lit(r"(?U)\w-\n(?=\w)")) + F.regexp_count(out, F.lit(r"(?U)\w-\n(?=\w)"))
        return out, lost
    return F.regexp_replace(kept, _PAIR, "$1$2"), F.regexp_count(kept, F.lit(_PAIR))


def has_hyphen_chain(text: Column) -> Column:
    return text.rlike(_CHAIN)


def _rstrip(x: Column) -> Column:
    return F.regexp_replace(x, f"{SPACE}$", "")


def join_paragraphs(text: Column) -> tuple[Column, Column]:
    """Single line breaks inside a paragraph become spaces. A line stays a line of its own if it is
    indented, or if it begins with a capital and the line before has fewer than 60 characters."""

    def kind(lines: Column, line: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        return (
            F.when(i == 0, 0)
            .when(line.rlike("^[ \\t]"), 1)
            .when((F.length(stripped(before)) < 60) & _rstrip(line).rlike(r"^\p{Lu}"), 2)
            .otherwise(3)
        )

    def block(b: Column) -> Column:
        lines = F.split(b, "\n")
        joined = F.array_join(F.transform(lines, lambda x, i: F.when(kind(lines, x, i) == 0, _rstrip(x)).when(kind(lines, x, i) == 1, F.concat(F.lit("\n"), x)).when(kind(lines, x, i) == 2, F.concat(F.lit("\n"), _rstrip(x))).otherwise(F.concat(F.lit(" "), _rstrip(x)))), "")
        return F.when(F.size(lines) == 1, b).otherwise(joined)

    def joins(b: Column) -> Column:
        lines = F.split(b, "\n")
        return F.size(F.filter(lines, lambda x, i: kind(lines, x, i) == 3))

    blocks = F.split(text, "\n\n+")
    count = F.aggregate(F.transform(blocks, joins), F.lit(0), lambda s, x: s + x)
    return F.array_join(F.transform(blocks, block), "\n\n"), count


_PUNCTUATION = [(r"(?U)[\s\x1c-\x1f]+([.,;:!?])", "$1"), ("  +", " "), (r"[ \t]+(\n)", "$1"), (r"[ \t]+$", "")]


def normalize_punctuation(text: Column) -> tuple[Column, Column]:
    """No space before punctuation, single spaces, none at line ends; counted step by step."""
    count = F.lit(0)
    for pattern, new in _PUNCTUATION:
        count = count + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, new)
    return text, count


def postprocess(text: Column, chains: bool = False) -> tuple[Column, dict[str, Column]]:
    """All four steps in order, with their counts."""
    a, unicode_ = normalize_unicode(text)
    b, hyphens = dehyphenate(a, chains)
    c, joins = join_paragraphs(b)
    d, fixes = normalize_punctuation(c)
    return d, {"unicode_normalizations": unicode_, "dehyphenations": hyphens, "paragraph_joins": joins, "punctuation_fixes": fixes}


def cleaned_columns(rows: DataFrame, text: str) -> DataFrame:
    """The steps after normalize_unicode on a column of rows, with their counts as columns.

    The same as in postprocess; every step is a column of its own, so that none is evaluated again by the next.
    """
    rows = rows.withColumns(dict(zip((text, "dehyphenations"), dehyphenate(F.col(text)), strict=True)))
    rows = rows.withColumns(dict(zip((text, "paragraph_joins"), join_paragraphs(F.col(text)), strict=True))).withColumn("punctuation_fixes", F.lit(0))
    for pattern, new in _PUNCTUATION:
        rows = rows.withColumns({"punctuation_fixes": F.col("punctuation_fixes") + F.regexp_count(text, F.lit(pattern)), text: F.regexp_replace(text, pattern, new)})
    return rows


#: A page that begins so is not drawn to the page before by any step. It is for texts as they were, so it looks
#: past soft hyphens, which go, and counts the Greek question mark, which NFC makes a semicolon.
BEGINS_ANEW = r"(?U)^[\s\x1c-\x1f\xad]*[^\s\x1c-\x1f\xad.,;:!?\u037e]"


def split_markdown(text: Column, pages: Column) -> Column:
    """Exactly `pages` parts: at rules, else at runs of three line breaks, else all in the first."""
    rules, breaks = F.split(text, "\n-{3,}\n"), F.split(text, "\n{3,}")
    return (
        F.when(pages <= 0, F.array().cast("array<string>"))
        .when(pages == 1, F.array(text))
        .when(F.size(rules) >= pages, F.slice(rules, F.lit(1), F.greatest(pages, F.lit(0))))
        .when(F.size(breaks) >= pages, F.slice(breaks, F.lit(1), F.greatest(pages, F.lit(0))))
        .otherwise(F.concat(F.array(text), F.array_repeat(F.lit(""), F.greatest(pages - 1, F.lit(0)))))
    )


def last_lines(text: Column, keep: int = 9) -> Column:
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - keep + 1, F.lit(1)), keep), "\n")
