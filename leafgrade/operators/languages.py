"""Language codes of the two engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L


def resolve_languages(codes: list[str]) -> tuple[str, str]:
    """Comma-separated codes of both engines; none asked for means the defaults; unknown ones raise ValueError."""
    known = {iso: (a, b) for iso, a, b in L.LANGUAGES}
    missing = [c for c in codes if c not in known]
    if missing:
        raise ValueError(f"unknown language {missing[0]!r}; known are {', '.join(sorted(known))}")
    wanted = codes or L.DEFAULT_LANGUAGES
    return ",".join(known[c][0] for c in wanted), ",".join(known[c][1] for c in wanted)


def first_engine_codes(codes: list[str]) -> str:
    """Joined by a plus sign; unknown codes pass through."""
    known = {iso: a for iso, a, _ in L.LANGUAGES}
    return "+".join(known.get(c, c) for c in codes)


def resolved(rows: DataFrame) -> DataFrame:
    """Rows (id, first_codes, second_codes, plus) for an array column `codes`."""
    first = F.create_map(*[F.lit(x) for iso, a, _ in L.LANGUAGES for x in (iso, a)])
    second = F.create_map(*[F.lit(x) for iso, _, b in L.LANGUAGES for x in (iso, b)])
    wanted = F.when(F.size("codes") == 0, F.array(*[F.lit(c) for c in L.DEFAULT_LANGUAGES])).otherwise(F.col("codes"))
    code = lambda m: F.array_join(F.transform(wanted, lambda c: F.coalesce(m[c], F.raise_error(F.concat(F.lit("unknown language "), c)).cast("string"))), ",")
    return rows.select("id", code(first).alias("first_codes"), code(second).alias("second_codes"), F.array_join(F.transform("codes", lambda c: F.coalesce(first[c], c)), "+").alias("plus"))
