"""A cleaning pipeline over `documents`: five stages, each one operator, each stored before the next.

Every stage but the last returns the columns it was given. Rows whose score, group, spans or windows
decide against them leave in that stage; the suffix-array stage shortens texts and keeps every row.

Defined cases: an empty table stays empty; null and empty texts score 0, are like nothing, lose nothing
and stay; repeated rows are copies, of which one stays; rows of one doc_id and different texts are judged
each by its own text; rows with a null doc_id are never labelled, and of similar texts the row with a
known doc_id stays before them; very long texts are read whole, one at a time; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrade.llm import decontaminate, jaccard, sentencepiece_bpe, suffix_dedup, toxicity
from leafgrade.llm.common import delete, passing_tables, scratch, stored

#: Bytes from which a repeated string is cut. A passage of 51 words of the test tables has 235 to 400 bytes.
PASSAGE_BYTES = 200
#: Words that a worker remembers in the last stage; workers also hold what earlier stages left.
CACHED_WORDS = 400_000


def _packed(docs: DataFrame) -> DataFrame:
    """All columns but text as one struct, so that no added column clashes with one of them."""
    return docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("rest__"), "doc_id", "text")


def _unpacked(df: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    return df.select(*[F.col(text).alias("text") if c == "text" else F.col(f"rest__.`{c}`").alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; texts without words score 0 and stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weight = toxicity.fit(docs, labels, ~toxicity.held_out())
    scored = toxicity.score(_packed(docs), weight, keep=["rest__", "text"])
    return _unpacked(scored.where(F.col("score") < toxicity.THRESHOLD), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts: that of the least doc_id. Texts without words all stay."""
    rows = stored(docs.select(F.struct(*docs.columns).alias("row__"), F.monotonically_increasing_id().alias("at__")), "pipeline-rows", last=True)
    # A group is named after its first row in this order, so a row stays if it names its group.
    rank = F.struct(F.col("row__.doc_id").isNull().alias("unknown"), F.col("row__.doc_id").alias("doc_id"), F.col("at__").alias("at"))
    groups = jaccard.jaccard_components(rows.select(rank.alias("doc_id"), F.col("row__.text").alias("text")), count_links=False)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id.at").alias("at__"))
    return rows.join(gone, "at__", "left_anti").select("row__.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeated passages cover (no part of a character stays); n_chars follows."""
    cut = suffix_dedup.without_repeats(_packed(docs), keep=["rest__"], length=PASSAGE_BYTES)
    out = _unpacked(cut, docs.columns, "kept_text")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than the contamination share."""
    found = decontaminate.find_contamination(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["rest__", "text"])
    return _unpacked(found.where(~F.col("contaminated")), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of what is left."""
    import public_tokenizers

    return sentencepiece_bpe.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), cached=CACHED_WORDS).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("suffix_array", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Training, signature joins and tokenizers have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        with passing_tables():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
