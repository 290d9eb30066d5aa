"""Engines that turn files or page images into text: the interface, stubs, and how failures become rows.

An engine takes a batch and never fails the task: what it raises becomes the `error` of its rows, so one
broken file costs that file alone. Real recognisers plug in here; none is part of this repository.
"""

from __future__ import annotations

import codecs
import hashlib
import time
import traceback
from collections.abc import Callable, Iterator
from typing import BinaryIO, Protocol
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import EngineError
from .events import worker_log
from .functions.transforms import last_lines
from .models import shelf

EXTRACTED = "path string, filename string, page_number long, text string, words array<struct<text:string,conf:int>>, error string, seconds double"
RECOGNISED = "sub_batch long, idx_in_batch long, new_text string, error string, seconds double, load_seconds double"


class PageReader(Protocol):
    """The pages of a file: texts, and word confidences or None."""

    def __call__(self, content: bytes) -> list[tuple[str, list[tuple[str, int]] | None]]: ...


class PageEngine(Protocol):
    """Texts of the pages of one batch, in order."""

    def __call__(self, pages: list[str]) -> list[str]: ...


def form_feed_reader(content: bytes) -> list[tuple[str, list[tuple[str, int]] | None]]:
    """A reader for plain text files whose pages are separated by form feeds."""
    return [(t, None) for t in content.decode("utf-8").split("\f")]


def _form_feed_stream(file: BinaryIO) -> Iterator[tuple[str, None]]:
    decoder, rest = codecs.getincrementaldecoder("utf-8")(), []
    while block := file.read(2**20):
        *whole, last = decoder.decode(block).split("\f")
        for text in whole:
            yield "".join([*rest, text]), None
            rest = []
        rest.append(last)
    decoder.decode(b"", True)
    yield "".join(rest), None


#: A reader may have this as well: the same pages from an open file, one by one.
form_feed_reader.stream = _form_feed_stream


def _opened(path: str) -> BinaryIO:
    fs, name = pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return fs.open_input_stream(name, compression=None)


def _can_stream(files: DataFrame) -> bool:
    """Whether all rows are files of a store that pyarrow opens, so that contents needn't come as rows."""
    try:
        schemes = {p.partition(":")[0]: p for p in files.inputFiles()}
        return bool(schemes) and all(pyarrow.fs.FileSystem.from_uri(p) for p in schemes.values())
    except (pa.ArrowException, OSError):
        return False


#: Characters of text that a streamed read hands on at a time.
HANDED_ON = 4_000_000


def _streamed(path: str, stream: Callable) -> Iterator[list[tuple]]:
    """Rows of a file's pages, some at a time. The file is read through once before, as a broken one has no page."""
    name, began, n = path.rsplit("/", 1)[-1], time.perf_counter(), 0
    try:
        with _opened(path) as file:
            for _ in stream(file):
                n += 1
    except Exception as e:  # noqa: BLE001 - the error is the result
        worker_log().warning("%s can't be read: %s", path, e)
        yield [(path, name, None, None, None, traceback.format_exc(), time.perf_counter() - began)]
        return
    spent = time.perf_counter() - began
    if not n:
        yield [(path, name, None, None, None, None, spent)]
    rows, size = [], 0
    with _opened(path) as file:
        for i, (text, words) in enumerate(stream(file)):
            rows.append((path, name, i, text, words, None, 0.0 if i else spent))
            size += len(text)
            if size > HANDED_ON:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def read_pages(files: DataFrame, reader: PageReader) -> DataFrame:
    """Page rows of files (path, content). A file that can't be read is one row with an error and no page.

    `error` holds the last lines of what was raised; `seconds` is the file's time, on its first row. If the
    reader has a `stream` and the store can be opened, files are read by pieces and no row holds a whole one.
    """
    stream = getattr(reader, "stream", None)
    names = ["path", "filename", "page_number", "text", "words", "error", "seconds"]
    if stream is not None and _can_stream(files):

        def run_streams(batches):
            for batch in batches:
                for path in batch["path"]:
                    for rows in _streamed(path, stream):
                        yield pd.DataFrame(rows, columns=names).astype({"page_number": "Int64"})

        return files.select("path").mapInPandas(run_streams, EXTRACTED).withColumn("error", last_lines(F.rtrim("error")))

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name, began = path.rsplit("/", 1)[-1], time.perf_counter()
                try:
                    pages = reader(content)
                    spent = time.perf_counter() - began
                    rows += [(path, name, i, t, w, None, 0.0 if i else spent) for i, (t, w) in enumerate(pages)]
                    if not pages:
                        rows.append((path, name, None, None, None, None, spent))
                except Exception as e:  # noqa: BLE001 - the error is the result
                    worker_log().warning("%s can't be read: %s", path, e)
                    rows.append((path, name, None, None, None, traceback.format_exc(), time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=names).astype({"page_number": "Int64"})

    return files.select("path", "content").mapInPandas(run, EXTRACTED).withColumn("error", last_lines(F.rtrim("error")))


def with_fallback(engine: PageEngine, second: PageEngine | None, strict: bool = False, name: str = "engine") -> PageEngine:
    """On RuntimeError the second engine (the same on another device) is tried; strict raises EngineError instead."""

    def run(pages: list[str]) -> list[str]:
        try:
            return engine(pages)
        except RuntimeError as e:
            if strict or second is None:
                raise EngineError(name, str(e)) from e
            return second(pages)

    return run


def recognise(batches: DataFrame, make: Callable[[], PageEngine], name: str = "second") -> DataFrame:
    """Texts of batched pages (sub_batch, idx_in_batch, text): a group is a batch, sized by the caller.

    `make` builds the engine once in each Python worker, which keeps it for a limited time. A batch that
    fails keeps its old texts (new_text null) and carries the error. `seconds` and `load_seconds` are the
    batch's, on its first row.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("idx_in_batch")
        loaded, began = 0.0, time.perf_counter()
        try:
            engine, loaded = shelf().get(own, make)
            began = time.perf_counter()
            texts = engine(batch["text"].tolist())
            if len(texts) != len(batch):
                raise EngineError(name, f"{len(texts)} texts for {len(batch)} pages")
            error = None
        except Exception as e:  # noqa: BLE001 - the error is the result
            texts, error = [None] * len(batch), f"{type(e).__name__}: {e}"
            worker_log().warning("batch %s keeps its texts: %s", batch["sub_batch"].iloc[0], error)
        spent = time.perf_counter() - began
        first = [1.0] + [0.0] * (len(batch) - 1)
        return pd.DataFrame({"sub_batch": batch["sub_batch"], "idx_in_batch": batch["idx_in_batch"], "new_text": texts, "error": error, "seconds": [spent * x for x in first], "load_seconds": [loaded * x for x in first]})

    own = f"{name}-{hashlib.sha1(CloudPickleSerializer().dumps(make)).hexdigest()}"  # what a worker keeps it by
    return batches.select("sub_batch", "idx_in_batch", F.coalesce("text", F.lit("")).alias("text")).groupBy("sub_batch").applyInPandas(run, RECOGNISED)
