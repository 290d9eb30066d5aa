"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of `window` words (an item of fewer words is one window). A window is
a set of shingles of up to three words; shingles are ordered by rarity over all documents, and as
containment must be complete the necessary prefix of a window is its rarest shingle alone. A document
joins a window only where that shingle occurs; the positional bound (the window must lie inside the
document at the shingle's offset) and the length bound (it has the window's number of words) go
before the exact comparison of the whole run of words.

Windows are broadcast in blocks of whole items whose size is bounded by max_block_bytes; a larger
benchmark takes one pass over the documents for each block. The documents are then stored once with
a number for each row, and the passes are merged by it.

Defined cases: null, empty and word-free texts have n_words 0 and are clean; items without words
have no window; equal items each count; items with a null id count like others, together as one null
at the end of the ids; ids of any type are taken as strings; an empty benchmark marks nothing; other
columns are ignored; every row gives a row of its own, whether or not its doc_id is null or repeated; an
empty table gives no row; a very long text is matched whole, in a step of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, bound_batches, chain, mix, passing_tables, starts_of, stored, text_batches, words


@dataclass
class DecontaminateConfig:
    window: int = 13
    shingle: int = 3
    #: An item's words that are hit make a document contaminated from this share of its words: 1 / share.
    share: int = 20
    max_block_bytes: int = 32 << 20


_ROW_BYTES = 300


def _run_text(low: bytes) -> str:
    """Words of mapped bytes (0 between words), joined by one space."""
    return b" ".join(low.replace(b"\0", b" ").split()).decode("utf-8", "surrogateescape")


def item_windows(benchmark: DataFrame, config: DecontaminateConfig) -> DataFrame:
    """Rows (item, size, window, words, shingles): each item's distinct windows with the hashes of their shingles in order."""

    def run(batches):
        for part, buf, off in text_batches(batches):
            h, start, end, row = words(buf, off, ALNUM_WORDS)
            low = ALNUM_WORDS[buf].tobytes()
            at = starts_of(row, len(off) - 1)
            ids = part.column(0).to_pylist()
            out = []
            for i, item in enumerate(ids):
                w = h[at[i] : at[i + 1]]
                size = min(config.window, len(w))
                if not size:
                    continue
                k = min(config.shingle, size)
                whole, small = chain(w, size), chain(w, k)
                for p in np.sort(np.unique(whole, return_index=True)[1]):
                    text = _run_text(low[start[at[i] + p] : end[at[i] + p + size - 1]])
                    out.append((item, size, int(whole[p].view(np.int64)), text, small[p : p + size - k + 1].view(np.int64).tolist()))
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], kinds)

    names = ("item", "size", "window", "words", "shingles")
    kinds = pa.schema(list(zip(names, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64())), strict=True)))
    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "item string, size int, window long, words string, shingles array<long>")


class _Probe:
    """Membership of hashes in a small sorted set, by a bit table and then a search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are keys, and which."""
        p = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[p]), max(len(self.keys) - 1, 0))
        ok = self.keys[k] == h[p] if len(self.keys) else np.zeros(0, bool)
        return p[ok], k[ok]


def shingle_counts(docs: DataFrame, shingles: np.ndarray, sizes: list[int]) -> dict[int, int]:
    """How often each of `shingles` (a bounded block) occurs over all documents; summed in each task first."""
    shared = docs.sparkSession.sparkContext.broadcast(_Probe(shingles))

    def run(batches):
        probe = shared.value
        total = np.zeros(len(probe.keys), np.int64)
        for _, buf, off in text_batches(batches):
            h, _, _, row = words(buf, off, ALNUM_WORDS)
            for k in sizes:
                c = chain(h, k)
                p, which = probe.find(c)
                p, which = p[row[p] == row[p + k - 1]], which[row[p] == row[p + k - 1]]
                total += np.bincount(which, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(probe.keys[seen].view(np.int64)), pa.array(total[seen])], ["h", "n"])

    return {r.h: r.n for r in docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()}


class _Index:
    """The windows of one block by their rarest shingle."""

    def __init__(self, rows: list, counts: dict[int, int], config: DecontaminateConfig):
        owners: dict[tuple[int, int], list[int]] = {}
        prefix: dict[tuple[int, int], tuple[int, int]] = {}
        for r in rows:
            key = (r.size, r.window, r.words)
            owners.setdefault(key, []).append(r.item)
            if key not in prefix:
                at = min(range(len(r.shingles)), key=lambda i: (counts.get(r.shingles[i], 0), r.shingles[i], i))
                prefix[key] = (r.shingles[at], at)
        keys = sorted(prefix, key=lambda k: np.int64(prefix[k][0]).view(np.uint64))
        self.size = np.array([k[0] for k in keys], np.int64)
        self.window = np.array([k[1] for k in keys], np.int64).view(np.uint64)
        self.words = [k[2] for k in keys]
        self.offset = np.array([prefix[k][1] for k in keys], np.int64)
        rare = np.array([prefix[k][0] for k in keys], np.int64).view(np.uint64)
        self.probe = _Probe(rare)
        self.first = np.searchsorted(rare, self.probe.keys)
        self.last = np.searchsorted(rare, self.probe.keys, side="right")
        self.item_at = np.append(0, np.cumsum([len(owners[k]) for k in keys])).astype(np.int64)
        self.items = np.array([x for k in keys for x in owners[k]], object)
        self.shingle_sizes = sorted({int(min(config.shingle, s)) for s in set(self.size.tolist())})
        self.sizes = sorted(set(self.size.tolist()))

    def match(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of each occurrence, by hash."""
        starts, found = [], []
        for k in self.shingle_sizes:
            p, which = self.probe.find(chain(h, k))
            n = self.last[which] - self.first[which]
            cand = np.repeat(self.first[which] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
            begin = np.repeat(p, n) - self.offset[cand]
            end = begin + self.size[cand] - 1
            ok = (begin >= 0) & (end < len(h))
            begin, end, cand = begin[ok], end[ok], cand[ok]
            ok = row[begin] == row[end]
            begin, cand = begin[ok], cand[ok]
            for size in self.sizes:
                if min(size, k) != k:
                    continue
                of = self.size[cand] == size
                b, c = begin[of], cand[of]
                runs = h[b[:, None] + np.arange(size)]
                v = runs[:, 0] + np.uint64(size)
                for j in range(1, size):
                    v = v * np.uint64(0x2545F4914F6CDD1D) + runs[:, j]
                    v ^= v >> np.uint64(29)
                same = mix(v) == self.window[c]
                starts.append(b[same])
                found.append(c[same])
        if not starts:
            e = np.zeros(0, np.int64)
            return e, e
        return np.concatenate(starts), np.concatenate(found)


def _pass(docs: DataFrame, shared: Broadcast, keep: list[str]) -> DataFrame:
    source = docs.select(*keep, F.col("text").alias("text__"))

    def run(batches):
        x = shared.value
        for part, buf, off in text_batches(batches, "text__"):
            n = len(off) - 1
            h, start, end, row = words(buf, off, ALNUM_WORDS)
            at = starts_of(row, n)
            begin, which = x.match(h, row)
            if len(begin):
                low = ALNUM_WORDS[buf]
                same = [_run_text(low[start[b] : end[b + x.size[w] - 1]].tobytes()) == x.words[w] for b, w in zip(begin.tolist(), which.tolist(), strict=True)]
                begin, which = begin[same], which[same]
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + x.size[which], -1)
            hit = np.append(0, np.cumsum(np.cumsum(edge)[:-1] > 0))
            n_hit = hit[at[1:]] - hit[at[:-1]]
            spans: list[list[int]] = [[] for _ in range(n)]
            items: list[set[str]] = [set() for _ in range(n)]
            for b, w in zip(begin.tolist(), which.tolist(), strict=True):
                r = int(row[b])
                spans[r] += [b - int(at[r]), b - int(at[r]) + int(x.size[w])]
                items[r].update(x.items[x.item_at[w] : x.item_at[w + 1]].tolist())
            cols = [part.column(part.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(at).astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([_ordered(s) for s in items], pa.list_(pa.string())), pa.array([_merged(s) for s in spans], pa.list_(pa.int64()))], [*keep, "n_words", "n_hit", "items", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    return source.mapInArrow(run, schema + ", n_words long, n_hit long, items array<string>, spans array<long>")


def _ordered(items: set) -> list:
    return sorted(items, key=lambda x: (x is None, x or ""))


def _merged(flat: list[int]) -> list[int]:
    """Begin and end pairs of word positions, overlaps and neighbours joined."""
    out: list[int] = []
    for b, e in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and b <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [b, e]
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, config: DecontaminateConfig | None = None, keep: list[str] | None = None) -> DataFrame:
    """For each row of docs: columns `keep`, n_words, n_hit, items (ids with an occurring window), spans
    (begin and end word positions, flat) and contaminated."""
    config = config or DecontaminateConfig()
    keep = keep or ["doc_id"]
    spark = docs.sparkSession
    bound_batches(spark)
    windows = item_windows(benchmark, config)
    sized = windows.agg(F.coalesce(F.sum(F.size("shingles") * 8 + _ROW_BYTES), F.lit(0)).alias("b")).first().b
    blocks = max(1, -(-int(sized) // config.max_block_bytes))

    def block_index(docs: DataFrame, block: int) -> Broadcast:
        some = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block) if blocks > 1 else windows
        rows = sorted(some.collect(), key=lambda r: (r.item is None, r.item or "", r.window))  # bounded by max_block_bytes
        every = np.array(sorted({s for r in rows for s in r.shingles}), np.int64).view(np.uint64)
        counts = shingle_counts(docs, every, sorted({min(config.shingle, r.size) for r in rows})) if rows else {}
        return spark.sparkContext.broadcast(_Index(rows, counts, config))

    if blocks == 1:
        out = _pass(docs, block_index(docs, 0), keep)
    else:
        with passing_tables():
            docs = stored(docs.select(*dict.fromkeys([*keep, "text"])).withColumn("row__", F.monotonically_increasing_id()), "decontaminate-docs", last=True)
            hits, sizes = None, None
            for block in range(blocks):
                shared = block_index(docs, block)
                found = _pass(docs, shared, ["row__"])
                # The first pass is kept whole, for the number of words of every row.
                found = stored(found if block == 0 else found.where("n_hit > 0"), "decontaminate-hits")
                shared.destroy()
                sizes = found.select("row__", "n_words") if sizes is None else sizes
                found = found.where("n_hit > 0").select("row__", "items", "spans")
                hits = found if hits is None else hits.unionAll(found)

            def merge(batches):
                for batch in batches:
                    got = batch.to_pydict()
                    spans = [_merged([x for s in many for x in s]) for many in got["spans"]]
                    items = [_ordered({x for s in many for x in s}) for many in got["items"]]
                    hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))], ["row__", "n_hit", "items", "spans"])

            merged = hits.groupBy("row__").agg(F.collect_list("items").alias("items"), F.collect_list("spans").alias("spans")).mapInArrow(merge, "row__ long, n_hit long, items array<string>, spans array<long>")
            none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
            merged = sizes.join(merged, "row__", "left").select("row__", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), none("items", "array<string>"), none("spans", "array<long>"))
            merged = stored(merged, "decontaminate-merged", last=True)
        out = docs.join(merged, "row__").select(*keep, "n_words", "n_hit", "items", "spans")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(config.share) * F.col("n_hit") >= F.col("n_words")))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = find_contamination(docs, benchmark)
    joined = F.array_join(F.array_sort("items"), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "contaminated")
