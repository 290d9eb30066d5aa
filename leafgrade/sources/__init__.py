"""Scans: tables, page views, files, word lists, manifests and sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import placed
from ..scratch import derived


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as pages (filename, page_number from 0, text, doc_id): a source is a file, doc_id (a key) gives the order.

    Numbers come from the narrow columns alone; texts move once, by doc_id, when the table is made.
    """

    def make() -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        numbers = placed(docs.select("source", "doc_id"), ["source"], ["doc_id"], "page_number")
        # A named number of parts, which no later step joins, so that reading the table is spread as well.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return docs.select("doc_id", "text").repartition(parts, "doc_id").join(numbers.repartition(parts, "doc_id"), "doc_id").select(F.col("source").alias("filename"), "page_number", "text", "doc_id")

    return derived(spark, [f"{sf_dir}/documents.parquet"], "pages", make)


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """Files of a folder (path, filename, length) in path order; contents are read only where selected later."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(folder).select("path", file_name("path").alias("filename"), "length").orderBy("path")


def file_name(path: str | Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def file_stem(path: str | Column) -> Column:
    """The name without its last suffix; a name that only begins with a dot keeps it."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^./]*$", "")


def file_suffix(path: str | Column) -> Column:
    return F.regexp_extract(file_name(path), r"(?<=.)(\.[^./]+)$", 1)


def listed_files(found: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The found files that are named, in the order of the names, and the names without a file."""
    spark = found.sparkSession
    wanted = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, filename string")
    return wanted.join(found, "filename").orderBy("pos"), wanted.join(found, "filename", "left_anti").orderBy("pos").select("filename")


def discovered(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False, names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Files (path, content) of a folder, all or those named, and the names that have no file.

    A name must have the pattern's suffix, in any case of letters.
    """
    reader = spark.read.format("binaryFile")
    reader = reader.option("recursiveFileLookup", "true") if recursive else reader
    suffix = pattern.rpartition(".")[2].lower() if "." in pattern else ""
    if not names:
        return reader.option("pathGlobFilter", pattern).load(folder).select("path", "content"), []
    found = reader.load(folder).where(file_name("path").isin(names))
    if suffix:
        found = found.where(F.lower(file_suffix("path")) == f".{suffix}")
    there = {r.name for r in found.select(file_name("path").alias("name")).distinct().collect()}  # of the names given
    return found.select("path", "content"), [n for n in names if n not in there]


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """One word a line: trimmed, lower-cased, blank lines dropped, distinct."""
    word = F.lower(F.trim("value"))
    return spark.read.text(path).select(word.alias("word")).where("word <> ''").distinct()


def with_custom_words(vocab: DataFrame, custom: DataFrame) -> DataFrame:
    return vocab.select("word").union(custom.select(F.lower(F.trim("word")).alias("word"))).where("word <> ''").distinct()


MANIFEST = "documents array<struct<id:string,title:string,author:string,language:array<string>,page_count:int,selected_pages:struct<difficult:array<int>,regression:array<int>>,ground_truth_pages:map<string,string>>>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a document of a corpus manifest; a missing file has no documents."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], MANIFEST).select(F.explode("documents").alias("d")).select("d.*")
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.*")


SIDECAR = "version string, filename string, generated_at string, pages array<struct<page_number:int,quality_score:double,engine:string,flagged:boolean,status:string,diagnostics:struct<struggle_categories:array<string>,has_signal_disagreement:boolean>>>"


def sidecars(spark: SparkSession, path: str, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of the documents' diagnostics files (matched by file stem), and the documents without one."""
    pages = spark.read.schema(SIDECAR).json(path, multiLine=True).withColumn("id", F.regexp_replace(file_stem(F.col("_metadata.file_path")), r"\.diagnostics$", ""))
    joined = documents.select("id").join(pages, "id", "left")
    found = joined.where(F.col("pages").isNotNull()).select("id", F.explode("pages").alias("p")).select("id", "p.*")
    return found, joined.where(F.col("pages").isNull()).select("id")


def document_by_id(documents: DataFrame, wanted: str) -> DataFrame:
    """The document with an id; raises LookupError without one."""
    found = documents.where(F.col("id") == wanted).limit(1)
    if found.isEmpty():
        raise LookupError(f"no document {wanted!r}")
    return found


def ground_truth_pages(documents: DataFrame) -> DataFrame:
    keys = F.transform(F.map_keys("ground_truth_pages"), lambda k: k.cast("int"))
    return documents.select("id", F.coalesce(F.array_sort(keys), F.array().cast("array<int>")).alias("pages"))


def wanted_pages(documents: DataFrame, wanted: str, pages: list[int] | None = None) -> DataFrame:
    """Rows (id, page_number) to draw of one document: the pages named, or all that the manifest selected; LookupError without the document."""
    found = document_by_id(documents, wanted)
    numbers = F.lit(pages).cast("array<int>") if pages is not None else F.array_union(F.coalesce("selected_pages.difficult", F.array().cast("array<int>")), F.coalesce("selected_pages.regression", F.array().cast("array<int>")))
    return found.select("id", F.explode(F.array_sort(F.array_distinct(numbers))).alias("page_number"))


def file_text(pages: DataFrame) -> DataFrame:
    """Whole texts by file: pages in order, joined by a line break."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p.text)
    return pages.groupBy("filename").agg(F.array_join(ordered, "\n").alias("text"), F.count("*").alias("page_count"))
