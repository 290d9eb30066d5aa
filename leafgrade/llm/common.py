"""Shared pieces: Arrow text buffers, word hashing in numpy, scratch tables and connected components.

Word hashes are polynomial over the bytes modulo 2**64 and finished by a bijective mixer, so a
word has the same hash in every batch and on every executor.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import delete, scratch

#: Bytes of text that one numpy step handles at a time; a longer single text is a step of its own.
STEP_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


#: For each passing_tables block that is open, the scratch tables made in it.
_passing: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def passing_tables() -> Iterator[None]:
    """Tables that `stored` makes inside the block are deleted at its end, but those stored with last=True."""
    _passing.append([])
    try:
        yield
    finally:
        for spark, path in _passing.pop():
            delete(spark, path)


def stored(df: DataFrame, name: str, last: bool = False) -> DataFrame:
    """The rows of df as a Parquet table in the shared scratch folder: lineage ends there.

    A `last` table outlives the passing_tables block around it; the block outside that one owns it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    owners = _passing[:-1] if last else _passing
    if owners:
        owners[-1].append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def steps(off: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes add up to at most `most`, or one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; release() forgets those that a very long text needed."""
    if len(_powers.get("up", ())) < n:
        size = max(n, STEP_BYTES + 1024)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


#: A fixed random 64-bit number for each byte value.
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_table(separators: bytes) -> np.ndarray:
    """Byte map for words(): 0 for separators, A-Z to lower case, any other byte itself."""
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    lut[list(separators)] = 0
    return lut


#: Words of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
SPACE_WORDS = word_table(bytes([0x20, *range(0x09, 0x0E)]))
ALNUM_WORDS = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: NUL is a word byte of the first kind; the map needs a value other than 0 for it.
SPACE_WORDS[0] = 0x20


def words(buf: np.ndarray, off: np.ndarray, lut: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hash, start byte, end byte and row of every word, in text order; words never cross rows.

    With `prefixes`, a fifth array holds a hash of the first k bytes of each word for each k, or 0
    where the word is not longer than k.
    """
    n = len(buf)
    if n == 0:
        e = np.zeros(0, np.int64)
        return (np.zeros(0, np.uint64), e, e, e) + ((np.zeros((len(prefixes), 0), np.uint64),) if prefixes else ())
    m = lut[buf]
    inside = m > 0
    first = np.zeros(n + 1, bool)
    first[off[off <= n]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[first[:n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[first[1:]] = False
    end = np.flatnonzero(inside & ~after) + 1
    up, down = powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_CODE[m] * up, out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    row = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))
    if not prefixes:
        return h, start, end, row
    first = np.zeros((len(prefixes), len(start)), np.uint64)
    for k, size in enumerate(prefixes):
        long = end - start > size
        s = start[long]
        first[k, long] = mix((total[s + size] - total[s]) * down[s] + np.uint64(size << 32))
    return h, start, end, row, first


def chain(w: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive word hashes (runs may cross rows; callers mask)."""
    if len(w) < size:
        return np.zeros(0, np.uint64)
    n = len(w) - size + 1
    h = w[:n] + np.uint64(size)
    for j in range(1, size):
        h = h * np.uint64(0x2545F4914F6CDD1D) + w[j : j + n]
        h ^= h >> np.uint64(29)
    return mix(h)


def starts_of(row: np.ndarray, rows: int) -> np.ndarray:
    """Offsets of each row's items in a sorted row-number column."""
    return np.searchsorted(row, np.arange(rows + 1))


#: What empties each operator's cache in this Python worker; workers serve one operator after the other.
caches: dict[str, Callable[[], None]] = {}


#: mallopt's names for the sizes from which memory is mapped on its own, and from which the heap's end is given back.
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3
_settled = False


def _settle() -> None:
    """Let this process give large arrays back when they are freed: the allocator would raise its limit with each."""
    global _settled
    _settled = True
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(_MMAP_THRESHOLD, 4 << 20)
        libc.mallopt(_TRIM_THRESHOLD, 16 << 20)
    except (OSError, AttributeError):  # another C library
        pass


def release(keep: str = "") -> None:
    """Empty the caches of other operators and give free memory back to the system."""
    if not _settled:
        _settle()
    for name, clear in caches.items():
        if name != keep:
            clear()
    if len(_powers.get("up", ())) > STEP_BYTES + 1024:
        _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_batches(batches, text: str = "text", most: int = STEP_BYTES, cache: str = ""):
    """(part of a record batch, bytes, offsets) for bounded parts of Arrow batches.

    A task begins with it, so the caches of other operators than `cache` go first.
    """
    release(cache)
    for batch in batches:
        buf, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
        for i, j in steps(off, most):
            yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows where the session has Spark's default: texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def within_bytes(sample: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """Rows of a bounded sample, in `order` for each value of `by`, until their texts add up to `most` bytes."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return sample.withColumn("sum__", F.sum(size).over(Window.partitionBy(by).orderBy(*order)) - size).where(F.col("sum__") < most).drop("sum__")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_filter(keys: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of one hash over a column of longs (of any kind), of at most 8 MB whatever the input; it only
    spares later shuffles rows, so false positives (many, once it is full) cost time and not results."""
    bits = 1 << min(26, max(16, int(16 * max(count, 1)).bit_length()))
    block = 1 << 13

    def run(batches):
        have = np.zeros(bits // 8, np.uint8)
        for b in batches:
            p = (mix(b.column(0).to_numpy().view(np.uint64)) >> np.uint64(20)) & np.uint64(bits - 1)
            np.bitwise_or.at(have, (p >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)))
        used = [i for i in range(0, len(have), block) if have[i : i + block].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([have[i : i + block].tobytes() for i in used], pa.binary())], ["at", "bits"])

    def join(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]
        return pa.table({"at": table.column("at").slice(0, 1), "bits": pa.array([np.bitwise_or.reduce(rows).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for r in keys.mapInArrow(run, "at int, bits binary").groupBy("at").applyInArrow(join, "at int, bits binary").toArrow().to_pylist():
        out[r["at"] : r["at"] + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a key_filter lets each key (64 bits) through."""
    p = (mix(keys.view(np.uint64)) >> np.uint64(20)) & np.uint64(8 * len(bits) - 1)
    return ((bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Rows (node, root): root is the least node that edges (a, b) of longs reach from node.

    Contracts stars on stored edge tables until every node hangs from its root, so the work is joins
    and grouped minima over the edges; minima of hot nodes are pre-aggregated before the shuffle.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = stored(e, name)
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        # Each node, and each of its neighbours, hooks to the least node among it and its neighbours.
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").select(F.col("b").alias("x"), "m")
        small = least.select(F.col("a").alias("x"), "m")
        new = large.unionAll(small).where("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()
        # A star forest: every node has one edge, and no root is itself below another.
        new = stored(new, name)
        done = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and new.join(new.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        e = new
        if done:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
