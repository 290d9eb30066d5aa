"""Command line: score a folder of form-feed separated text files and print a table or JSON.

Exit codes: 0 if every file succeeded, 1 if one failed or a setting is wrong, 130 if interrupted.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from . import __version__, sources
from .config import LeafgradeError, RunConfig
from .events import to_log
from .operators import rollups
from .pipeline import run
from .readiness import Needs, choose_device, memory_gb, validate


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafgrade", description=__doc__)
    p.add_argument("input_dir", nargs="?", default=".")
    p.add_argument("output_dir", nargs="?", default=None, help="default: leafgrade_output in the input folder")
    p.add_argument("--vocabulary", required=True, help="text file, a word a line")
    p.add_argument("--custom-vocabulary", help="more words, a word a line")
    p.add_argument("--pattern", default="*.txt", help="names of the files to read")
    p.add_argument("--threshold", type=float, default=0.85)
    p.add_argument("--samples", type=int, default=20, help="issues kept of each page")
    p.add_argument("--languages", default="", help="ISO codes, comma-separated")
    p.add_argument("--files", nargs="*", default=[])
    p.add_argument("--workers", type=int, default=os.cpu_count() or 4, help="files that the first engine reads at a time")
    for flag, text in (
        ("recursive", "also files of folders below"),
        ("force", "the first engine reads every file"),
        ("force-second", "the second engine reads every page"),
        ("strict-device", "fail where the device can't be used"),
        ("extract-text", "write cleaned texts"),
        ("copy-sources", "copy the files read"),
        ("diagnostics", "write each page's diagnostics"),
        ("keep-intermediates", "keep the tables of the stages"),
        ("json", "print the record of the batch"),
        ("debug", "print each flagged page with its first issues"),
        ("verbose", "log events"),
    ):
        p.add_argument(f"--{flag}", action="store_true", help=text)
    p.add_argument("--version", action="version", version=f"leafgrade {__version__}")
    return p


def _run(a: argparse.Namespace) -> int:
    if a.verbose:
        logging.basicConfig(level=logging.INFO)
    validate(Needs())
    device = choose_device(strict=a.strict_device)
    spark = SparkSession.builder.appName("leafgrade").getOrCreate()
    config = RunConfig(
        a.input_dir,
        a.output_dir or f"{a.input_dir.rstrip('/')}/leafgrade_output",
        quality_threshold=a.threshold,
        force_first=a.force,
        force_second=a.force_second,
        max_samples=a.samples,
        languages=[c for c in a.languages.split(",") if c],
        max_workers=a.workers,
        files=a.files,
        pattern=a.pattern,
        recursive=a.recursive,
        memory_gb=memory_gb(device.name),
        device=device.name,
        strict_device=a.strict_device,
        extract_text=a.extract_text,
        copy_sources=a.copy_sources,
        diagnostics=a.diagnostics,
        keep_intermediates=a.keep_intermediates,
    )
    config.engine_languages()
    vocab = sources.word_list(spark, a.vocabulary)
    if a.custom_vocabulary:
        vocab = sources.with_custom_words(vocab, spark.read.text(a.custom_vocabulary).withColumnRenamed("value", "word"))
    files, pages = run(spark, config, vocab, receivers=to_log() if a.verbose else None)
    if a.debug:
        pages.where("flagged").orderBy("path", "page_number").select("filename", "page_number", "score", "sample_issues").show(1000, truncate=False)
    if a.json:
        print(rollups.batch_json(files).first().json)
    else:
        rollups.summary_table(files).orderBy("filename").show(1000, truncate=False)
    return int(rollups.batch_summary(files).first().error_count > 0)


def main(argv: list[str] | None = None) -> int:
    try:
        return _run(parser().parse_args(argv))
    except KeyboardInterrupt:
        return 130
    except (LeafgradeError, ValueError) as e:
        print(f"leafgrade: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
