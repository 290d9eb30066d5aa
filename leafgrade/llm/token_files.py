"""Token-id files of a corpus: encode, write in document order, read back.

Texts are tokenized by the tokenizers library a word at a time (its vocabulary drops white space, so
no token spans a space or a line break) with a bounded cache of words; special tokens written out in a
text are cut out first, as the library does. An end id closes each document. Documents are
range-partitioned by doc_id and place in the table, so one doc_id may fill many tasks; each task writes
its files of at most FILE_TOKENS tokens under names of its own attempt, and a manifest of the attempts
that succeeded. Only the files that the manifest names are read back.

Defined cases: null and empty texts are the end id alone; null doc_ids come first; rows of equal doc_id
are in the order of the table; repeated rows repeat; an empty table writes no file and gives no row; a
very long text is encoded whole and may make its file longer; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rans
from .common import bound_batches, caches, scratch, shuffle_partitions, stored, text_batches

FILE_TOKENS = 3_000_000
CACHE_WORDS = 1_300_000


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A comma or full stop that follows a letter and ends a word is a pre-token of its own; where none
#: follows anything else, plain replacement finds them.
_STOP = re.compile(rb"(?<=[a-z])([,.])(?= )")
_OTHER_STOP = re.compile(rb"[^a-z][,.] ")
#: A word that no text's word holds as a part unless it is encoded alone; its ids mark where words end.
_MARK = "\x01"
_BETWEEN = b" " + _MARK.encode() + b" "


class WordTokenizer:
    """encode(texts) equals the library's encode of each whole text, for vocabularies that drop spaces and
    lower-case letters and whose pre-tokens are runs of letters, single numbers and runs of other signs."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # Words are lower-cased before they are coded, and must not become special tokens by that.
        self.library.encode_special_tokens = True
        special = self.library.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in special.values()):
            raise ValueError("special tokens with conditions are not supported")
        names = sorted((t.content.encode() for t in special.values()), key=len, reverse=True)
        self.special = re.compile(b"(" + b"|".join(map(re.escape, names)) + b")") if names else None
        self.sign = os.path.commonprefix(names)  # spares most texts the search
        #: A special token's key has a space before it, as no word has.
        self.always = {b"": b"", **{b" " + t.content.encode(): np.array([i], np.uint32).tobytes() for i, t in special.items()}}
        self.mark = self.library.encode(_MARK, add_special_tokens=False).ids
        self.cache: dict[bytes, bytes] = dict(self.always)

    def _learn(self, new: list[bytes]) -> None:
        alone = [w for w in new if b"\x01" in w]
        many = [w for w in new if b"\x01" not in w] if len(self.mark) == 1 else []
        if len(self.mark) != 1:
            alone = new
        groups = [many[at : at + 200] for at in range(0, len(many), 200)]
        joined = [_BETWEEN.join(some).decode("utf-8", "replace") for some in groups]
        for some, coded in zip(groups, self.library.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark[0])
            if len(cut) + 1 != len(some):
                alone += some
                continue
            raw = ids.tobytes()
            begin, end = np.append(0, 4 * (cut + 1)).tolist(), np.append(4 * cut, len(raw)).tolist()
            self.cache.update(zip(some, [raw[i:j] for i, j in zip(begin, end, strict=True)], strict=True))
        for w in alone:
            self.cache[w] = np.array(self.library.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32).tobytes()

    def _words(self, raw: bytes) -> list[bytes]:
        if self.special is not None and self.sign in raw and len(parts := self.special.split(raw)) > 1:
            return [w for k, part in enumerate(parts) for w in ([b" " + part] if k % 2 else self._words(part))]
        raw = raw.translate(_LOWER).replace(b"\n", b" ")
        raw = _STOP.sub(rb" \1", raw) if _OTHER_STOP.search(raw) else raw.replace(b", ", b" , ").replace(b". ", b" . ")
        return raw.split(b" ")

    def encode(self, texts: list[str] | list[bytes]) -> list[np.ndarray]:
        if len(self.cache) > CACHE_WORDS:
            self.cache = dict(self.always)
        words, at = [], [0]
        for t in texts:
            words += self._words(t if isinstance(t, bytes) else t.encode("utf-8", "replace"))
            at.append(len(words))
        got = list(map(self.cache.get, words))
        missing = [k for k, ids in enumerate(got) if ids is None]
        if missing:
            self._learn(list({words[k] for k in missing}))
            for k in missing:
                got[k] = self.cache[words[k]]
        return [np.frombuffer(b"".join(got[i:j]), np.uint32) for i, j in zip(at, at[1:], strict=False)]


_tokenizers: dict[str, WordTokenizer] = {}


def _forget() -> None:
    for t in _tokenizers.values():
        t.cache = dict(t.always)


caches["words"] = _forget


def tokenizer_at(path: str) -> WordTokenizer:
    """One tokenizer, with its cache, for each Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Write files below folder (a URI that pyarrow.fs opens on every executor); rows (part, file, n_docs, n_tokens, bytes)."""
    bound_batches(docs.sparkSession)
    n = partitions or shuffle_partitions(docs.sparkSession)
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("at"))
    ordered = placed.repartitionByRange(n, F.asc_nulls_first("doc_id"), "at").sortWithinPartitions(F.asc_nulls_first("doc_id"), "at").select("doc_id", "text")
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        tokenizer = tokenizer_at(tokenizer_path)
        end = np.array([end_id], np.uint32)
        docs, sizes, ids, count, before, k = [], [], [], 0, 0, 0

        def flush():
            nonlocal docs, sizes, ids, count, before, k
            name = f"part-{part:06d}-{k:05d}-{attempt}.rans"
            data = rans.write(docs, np.array(sizes), np.concatenate(ids), before)
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(data)
            row = pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_docs": len(docs), "n_tokens": count, "bytes": len(data)}])
            before, k = before + count, k + 1
            docs, sizes, ids, count = [], [], [], 0
            return row.select(["part", "file", "n_docs", "n_tokens", "bytes"])

        for rows, buf, off in text_batches(batches, most=1 << 20, cache="words"):
            raw = buf.tobytes()
            for d, e in zip(rows.column(0).to_pylist(), tokenizer.encode([raw[i:j] for i, j in zip(off, off[1:], strict=False)]), strict=True):
                docs.append(d)
                sizes.append(len(e) + 1)
                ids += [e, end]
                count += len(e) + 1
                if count >= FILE_TOKENS:
                    yield flush()
        if docs:
            yield flush()

    return stored(ordered.mapInArrow(run, "part long, file string, n_docs long, n_tokens long, bytes long"), "token-manifest")


def read_token_files(spark, folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files, decoded and verified."""
    sizes = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("files")).orderBy("part").collect()  # a row for each part
    base, total = {}, 0
    for r in sizes:
        base[r.part] = total
        total += r.n
    starts = spark.sparkContext.broadcast(base)
    files = manifest.select("part", "file").repartition(max(1, sum(r.files for r in sizes)))

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}") as f:
                    docs, sizes, ids, before = rans.read(f.read())
                at = np.append(0, np.cumsum(sizes))
                little = ids.astype("<u4")
                crc = [zlib.crc32(little[at[i] : at[i + 1]]) for i in range(len(docs))]
                cols = [pa.array(docs, pa.int64()), pa.array(starts.value[part] + before + at[:-1]), pa.array(sizes), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "token-files")
    manifest = write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), 1)
    return read_token_files(spark, folder, manifest)
