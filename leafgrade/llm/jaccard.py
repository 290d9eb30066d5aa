"""Exact n-gram Jaccard join by PartEnum signatures.

A text's set holds the hashes of its distinct 5-word shingles. Two sets of sizes a <= b with Jaccard
similarity of at least 0.8 have b <= 1.25 a and differ in at most (a + b) / 9 <= a / 4 elements. The
element domain is dealt to bins by a hash; sets whose sizes lie in one size band use the same bins,
and bands overlap so that every possible pair shares one. A set signs each of its first
e(n) = n // 4 + 1 + m(n) bins with the contents of that bin. Of a similar pair's common signed bins
at most n // 4 differ, so at least 1 + m(n) of them are equal: enumerating the bins one by one finds
every pair. m(n) exceeds the empty bins that a set usually has, so empty bins need a signature only
in the rare sets with more of them, and the guarantee stays without them.

In the bands of the smallest sets (up to 12 elements, k = 1 or 2 differences) enumerating subsets takes no
more signatures and makes each far more telling: the elements are dealt to k + 2 second-level partitions,
of which a pair agrees on two at least, so the contents of every subset of two are signed (3 or 6
signatures, each of 2 / 3 or 1 / 2 of the set). Where a subset is empty the set is dealt again by another
hash and signs that dealing as well: a pair that agrees on an empty subset alone does so in both sets, so
both go on, to the last of DEALINGS dealings, which signs its empty subsets too.

More is known of the larger bands than that: of the 1 + m(a) equal bins of a pair no more are empty than either set has
empty bins. A set of n elements may be the larger one, and its partner has at least 4n / 5 elements,
so it shares at least need(n) = 1 + m(ceil(4n / 5)) - empty signatures with any partner. A set of
which fewer than `need` signatures occur in any other set has no partner and is peeled off before
pairs are made; texts that merely share a line or a passage go this way.

Signatures leave each task packed by bucket (6 bytes each); there are as many buckets as the corpus needs. Equal sets collapse to one key first, so
copies are never paired; a bucket yields distinct lists of keys that share a signature. Short lists
give their pairs, long ones give pairs of chunks (a few hundred sets each) whose sets are compared
inside one task, which emits a count of links for each key and a spanning forest of them. Every pair
is compared once, on exact sets, so the counts are whole. Links feed distributed connected components.

Where links need no counting, lists are verified in two rounds. First each key is compared with the
key that leads most of its lists. Then only lists whose keys are still in different components count.

Defined cases: null and word-free texts have an empty set, link with nothing and are their own
component; texts of one to four words are one shingle; repeated rows and copies share a component;
every row returns, whatever its doc_id repeats; a component of rows without doc_id has the id null; an
empty table gives no row; a very long text is a step of its own, its whole set compared; other columns
are ignored. Element hashes have 64 bits, compared in
verification by their upper 48.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, bound_batches, chain, components, key_filter, may_hold, mix, passing_tables, release, shuffle_partitions, starts_of, stored, text_batches, words

SHINGLE = 5
#: Similarity as a fraction; the bounds of the module text hold for these.
NUMERATOR, DENOMINATOR = 80, 100
_FLUSH = 600_000


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and each row's offset among them."""
    n = len(off) - 1
    h, _, _, row = words(buf, off, SPACE_WORDS)
    at = starts_of(row, n)
    c = chain(h, SHINGLE)
    parts = []
    size = np.zeros(n, np.int64)
    for i in range(n):
        k = at[i + 1] - at[i]
        if k >= SHINGLE:
            s = np.sort(c[at[i] : at[i + 1] - SHINGLE + 1])
            s = s[np.append(True, s[1:] != s[:-1])]
        elif k:
            s = chain(h[at[i] : at[i + 1]], int(k))
        else:
            continue
        parts.append(s)
        size[i] = len(s)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.append(0, np.cumsum(size))


def set_keys(elements: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash for each set; 0 for empty ones."""
    total = np.append(np.uint64(0), np.cumsum(mix(elements ^ np.uint64(0x5851F42D4C957F2D))))
    key = mix((total[at[1:]] - total[at[:-1]]) ^ mix(np.diff(at).astype(np.uint64)))
    key[np.diff(at) == 0] = 0
    return key


def _bands(most: int = 1 << 31) -> tuple[np.ndarray, np.ndarray]:
    low, high = [4], [6]
    while high[-1] < most:
        low.append(-(-4 * (high[-1] + 1) // 5))
        high.append(max(low[-1] * 25 // 16, high[-1] + 1))
    return np.array(low, np.int64), np.array(high, np.int64)


BAND_LOW, BAND_HIGH = _bands()


def _spare(n):
    return 2 + n // 20 + np.sqrt(n).astype(np.int64) // 2


def _signed(n):
    """Bins that a set of n elements signs."""
    return n // 4 + 1 + _spare(n)


#: Times that the subsets of a small set are dealt at most.
DEALINGS = 4


def _differences(band: int) -> int:
    """The elements that two similar sets of a band may differ in, at most."""
    return int(2 * BAND_HIGH[band]) // 9


def _subset_bands() -> int:
    """The first bands, in which all subsets of two of k + 2 partitions are no more than single bins."""
    band = 0
    while (k := _differences(band)) and (k + 2) * (k + 1) // 2 <= _signed(BAND_HIGH[band : band + 1])[0]:
        band += 1
    return band


SUBSET_BANDS = _subset_bands()


def _subset_signatures(elements: np.ndarray, start: np.ndarray, n: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets at start (of n elements each) in a band of small sets, and which set has each."""
    parts = _differences(band) + 2
    one, two = np.triu_indices(parts, 1)
    sigs, rows = [], []
    left = np.arange(len(start))
    for deal in range(DEALINGS):
        m = n[left]
        owner = np.repeat(np.arange(len(left)), m)
        e = elements[np.repeat(start[left] - np.append(0, np.cumsum(m))[:-1], m) + np.arange(m.sum())]
        own = mix(e ^ mix(np.array([1 + band * DEALINGS + deal], np.uint64)))
        cell = owner * parts + ((own >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(len(left) * parts, np.uint64)
        np.add.at(total, cell, own)
        total = total.reshape(-1, parts)
        filled = np.bincount(cell, minlength=total.size).reshape(-1, parts) > 0
        # What a subset holds, told apart by the place in it.
        held = mix(total[:, one]) + np.uint64(3) * mix(total[:, two] ^ np.uint64(0x5DEECE66D))
        tag = mix(np.uint64(1 << 62) + np.uint64((band * DEALINGS + deal) << 8) + np.arange(len(one), dtype=np.uint64))
        empty = ~(filled[:, one] | filled[:, two])
        at, subset = np.nonzero(~empty if deal + 1 < DEALINGS else np.ones_like(empty))
        sigs.append(mix(held[at, subset] + tag[subset]))
        rows.append(left[at])
        left = left[empty.any(axis=1)]
        if not len(left):
            break
    return np.concatenate(sigs), np.concatenate(rows)


def signatures(elements: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature and row, for every row and band, and each row's least need over its bands; sets of
    fewer than 4 elements equal or match nothing."""
    size = np.diff(at)
    lo = np.searchsorted(BAND_HIGH, size)
    hi = np.searchsorted(BAND_LOW, size, side="right") - 1
    sigs, rows = [], []
    need = np.full(len(size), 65535, np.int64)
    for small in range(SUBSET_BANDS):
        use = np.flatnonzero((size >= 4) & (lo <= small) & (small <= hi))
        if len(use):
            s, r = _subset_signatures(elements, at[use], size[use], small)
            sigs.append(s)
            rows.append(use[r])
            need[use] = 1
    for extra in range(4):
        use = np.flatnonzero((size >= 4) & (lo + extra <= hi) & (lo + extra >= SUBSET_BANDS))
        if not len(use):
            continue
        band = lo[use] + extra
        n = size[use]
        bins = _signed(BAND_HIGH[band])
        signed = np.minimum(_signed(n), bins)
        first = np.append(0, np.cumsum(bins))
        idx = np.repeat(at[use] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
        e = elements[idx]
        own = mix(e ^ np.repeat(mix(band.astype(np.uint64) + np.uint64(77)), n))
        where = (((own >> np.uint64(32)) * np.repeat(bins, n).astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + np.repeat(first[:-1], n)
        total = np.zeros(first[-1], np.uint64)
        np.add.at(total, where, own)
        filled = np.bincount(where, minlength=first[-1]) > 0
        place = np.arange(first[-1]) - np.repeat(first[:-1], bins)
        owner = np.repeat(np.arange(len(use)), bins)
        inside = place < signed[owner]
        empty = np.bincount(owner[inside & ~filled], minlength=len(use))
        least = _spare(-(-4 * n // 5))
        loud = empty > least
        need[use] = np.minimum(need[use], np.where(loud, 1, 1 + least - empty))
        out = np.flatnonzero(inside & (filled | loud[owner]))
        tag = mix((band[owner[out]].astype(np.uint64) << np.uint64(40)) + place[out].astype(np.uint64))
        sigs.append(mix(total[out] + tag))
        rows.append(use[owner[out]])
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), need
    return np.concatenate(sigs), np.concatenate(rows), need


def pack(bucket: np.ndarray, key: np.ndarray, need: np.ndarray, value: np.ndarray):
    """A record batch with a row for each bucket: its keys, their needs (255 at most), how many values
    each has, and the lower 6 bytes of the values. A key with over 255 values there is repeated."""
    order = np.lexsort((key, bucket))
    bucket, key, need, value = bucket[order], key[order], np.minimum(need[order], 255), value[order]
    low = value.view(np.uint8).reshape(-1, 8)[:, :6]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    out = ([], [], [], [], [])
    for i, j in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
        k = np.flatnonzero(np.append(True, key[i + 1 : j] != key[i : j - 1]))
        n = np.diff(np.append(k, j - i))
        if n.max() > 255:
            k = np.concatenate([np.arange(a, a + m, 255) for a, m in zip(k, n, strict=True)])
            n = np.diff(np.append(k, j - i))
        out[0].append(int(bucket[i]))
        out[1].append(key[i + k].tobytes())
        out[2].append(n.astype(np.uint8).tobytes())
        out[3].append(low[i:j].tobytes())
        out[4].append(need[i + k].astype(np.uint8).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], ["bucket", "keys", "counts", "sigs", "needs"])


def _bucket_signatures(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        held = []
        for _, buf, off in text_batches(batches):
            elements, at = shingle_sets(buf, off)
            keys = set_keys(elements, at)
            s, r, need = signatures(elements, at)
            held.append((s, keys[r], need[r]))
            if sum(len(x[0]) for x in held) >= _FLUSH:
                yield _flush(held, buckets)
                held = []
        if any(len(x[0]) for x in held):
            yield _flush(held, buckets)

    return docs.select("text").mapInArrow(run, "bucket int, keys binary, counts binary, sigs binary, needs binary")


def _flush(held: list, buckets: int):
    s, k, need = (np.concatenate(x) for x in zip(*held, strict=True))
    bucket = ((s >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((k, s))
    s, k, need, bucket = s[order], k[order], need[order], bucket[order]
    new = np.append(True, (s[1:] != s[:-1]) | (k[1:] != k[:-1]))  # copies in one task sign once
    return pack(bucket[new], k[new], need[new], s[new])


def _shared_lists(table: pa.Table) -> pa.Table:
    """The distinct lists of two or more keys that share a signature of this bucket, each with the number of such signatures."""
    get = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    counts = get("counts", np.uint8)
    key = np.concatenate([np.repeat(k, c) for k, c in zip(get("keys", np.uint64), counts, strict=True)])
    need = np.concatenate([np.repeat(k, c) for k, c in zip(get("needs", np.uint8), counts, strict=True)])
    low = np.concatenate(get("sigs", np.uint8)).reshape(-1, 6)
    sig = np.zeros((len(low), 8), np.uint8)
    sig[:, :6] = low
    sig = sig.reshape(-1).view(np.uint64)
    # Most signatures occur once; they go before the sort by both columns.
    order = np.argsort(sig, kind="stable")
    sig, key, need = sig[order], key[order], need[order]
    same = sig[1:] == sig[:-1]
    many = np.append(same, False) | np.append(False, same)
    sig, key, need = sig[many], key[many], need[many]
    order = np.lexsort((key, sig))
    sig, key, need = sig[order], key[order], need[order]
    new = np.append(True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])) if len(sig) else np.zeros(0, bool)
    sig, key, need = sig[new], key[new], need[new]
    cut = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(cut, len(sig)))
    total = np.append(np.uint64(0), np.cumsum(mix(key)))
    name = mix((total[cut + size] - total[cut]) + size.astype(np.uint64)) if len(cut) else np.zeros(0, np.uint64)
    name[size < 2] = 0
    kept, where, times = np.unique(name, return_index=True, return_counts=True)
    where, times = where[kept != 0], times[kept != 0]
    lists = [key[cut[w] : cut[w] + size[w]].view(np.int64) for w in where]
    needs = [need[cut[w] : cut[w] + size[w]].astype(np.int32) for w in where]
    return pa.table({"name": pa.array(name[where].view(np.int64)), "times": pa.array(times.astype(np.int64)), "members": pa.array(lists, pa.list_(pa.int64())), "needs": pa.array(needs, pa.list_(pa.int32()))})


def _peeled(lists: DataFrame, name: str) -> DataFrame:
    """The lists without keys that occur in fewer shared signatures than they need."""
    each = lists.select("name", "times", F.explode(F.arrays_zip("members", "needs")).alias("x")).select("name", "times", F.col("x.members").alias("key"), F.col("x.needs").alias("need"))
    able = each.groupBy("key").agg(F.sum("times").alias("n"), F.min("need").alias("need")).where("n >= need").select("key")
    left = each.join(able, "key", "left_semi").groupBy("name").agg(F.first("times").alias("times"), F.array_sort(F.collect_list(F.struct("key", "need"))).alias("x")).where(F.size("x") > 1)
    left = left.select("times", F.col("x.key").alias("members"), F.col("x.need").alias("needs"))
    return stored(left.groupBy(F.xxhash64("members").alias("name")).agg(F.sum("times").alias("times"), F.first("members").alias("members"), F.first("needs").alias("needs")), name)


def _wanted_sets(docs: DataFrame, bloom: np.ndarray) -> DataFrame:
    """Rows (key, elements): one packed set for each distinct key that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches):
        bits = shared.value
        for _, buf, off in text_batches(batches):
            elements, at = shingle_sets(buf, off)
            key = set_keys(elements, at)
            hit = np.flatnonzero(may_hold(bits, key))
            hit = hit[np.unique(key[hit], return_index=True)[1]]
            # The upper 48 bits of sorted hashes.
            data = [elements[at[i] : at[i + 1]].view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for i in hit]
            yield pa.RecordBatch.from_arrays([pa.array(key[hit].view(np.int64)), pa.array(data, pa.binary())], ["key", "elements"])

    return docs.select("text").mapInArrow(run, "key long, elements binary").dropDuplicates(["key"])


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _linked(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar; every pair is compared on whole sets."""
    pairs = stored(pairs, f"{name}-pairs") if name.endswith("2") else pairs
    if pairs.isEmpty():
        return pairs
    keys = pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct()
    keys = stored(keys, f"{name}-keys")
    sets = stored(_wanted_sets(docs, key_filter(keys, keys.count())).join(keys, "key", "left_semi"), f"{name}-sets")
    one = pairs.join(sets.select(F.col("key").alias("b"), F.col("elements").alias("eb")), "b")
    both = one.join(sets.select(F.col("key").alias("a"), F.col("elements").alias("ea")), "a").select("a", "b", "ea", "eb")

    def run(batches):
        last, held = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = []
            for i in range(len(a)):
                if a[i] != last:
                    last, held = a[i], _unpack(batch.column(2)[i].as_py())
                other = _unpack(batch.column(3)[i].as_py())
                n, m = len(held), len(other)
                if DENOMINATOR * min(n, m) < NUMERATOR * max(n, m):
                    continue
                small, large = (held, other) if n <= m else (other, held)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int(np.count_nonzero(large[at] == small))
                if DENOMINATOR * common >= NUMERATOR * (n + m - common):
                    ok.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in ok], pa.int64()), pa.array([b[i] for i in ok], pa.int64())], ["a", "b"])

    return stored(both.mapInArrow(run, "a long, b long"), f"{name}-links")


#: Lists of up to so many keys give pairs; longer ones are compared in chunks of about CHUNK sets or CHUNK_BYTES.
SHORT, CHUNK, CHUNK_BYTES = 6, 4096, 8 << 20
#: Sets, and distinct elements, of one matrix inside such a comparison.
_TILE, _WIDTH = 1024, 4096


def _torn(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """Lists (name, times, m: [(key, root)]) that touch several components."""
    each = lists.select("name", "times", F.explode("members").alias("key"))
    each = each.join(groups.select(F.col("node").alias("key"), "root"), "key", "left").select("name", "times", "key", F.coalesce("root", "key").alias("root"))
    return each.groupBy("name").agg(F.first("times").alias("times"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.array_sort(F.collect_list(F.struct("key", "root"))).alias("m")).where("lo <> hi").select("name", "times", "m")


def _short_pairs(torn: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            a, b = [], []
            for m in batch.column(0).to_pylist():
                for i in range(1, len(m)):
                    for j in range(i):
                        if m[i]["root"] != m[j]["root"]:
                            a.append(m[j]["key"])
                            b.append(m[i]["key"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return torn.where(F.size("m") <= SHORT).select("m").mapInArrow(run, "a long, b long").distinct()


def _tiles(begin: int, end: int) -> list[tuple[int, int]]:
    return [(i, min(i + _TILE, end)) for i in range(begin, end, _TILE)]


def _near(owner: np.ndarray, element: np.ndarray, top: int, size: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> np.ndarray:
    """Which of the sets i0 to i1 and j0 to j1 are similar; owner and element list the shared elements by element."""
    common = np.zeros((i1 - i0, j1 - j0), np.float32)
    mine, other = (owner >= i0) & (owner < i1), (owner >= j0) & (owner < j1)
    # Only elements that occur on both sides count.
    both = np.flatnonzero((np.bincount(element[mine], minlength=top) > 0) & (np.bincount(element[other], minlength=top) > 0))
    number = np.full(top, -1)
    number[both] = np.arange(len(both))
    x = number[element]
    mine, other = np.flatnonzero(mine & (x >= 0)), np.flatnonzero(other & (x >= 0))
    for at in range(0, len(both), _WIDTH):
        width = min(_WIDTH, len(both) - at)
        sides = []
        for places, first, n in ((mine, i0, i1 - i0), (other, j0, j1 - j0)):
            p, q = np.searchsorted(x[places], [at, at + width])
            some = np.zeros((n, width), np.float32)
            some[owner[places[p:q]] - first, x[places[p:q]] - at] = 1
            sides.append(some)
        common += sides[0] @ sides[1].T
    return DENOMINATOR * common >= NUMERATOR * (size[i0:i1, None] + size[None, j0:j1] - common)


def _block_links(table: pa.Table) -> pa.Table:
    """The similar pairs of one chunk, or those between it and smaller ones: the number of rows that each key is linked
    with (a, n), and links (a, b) as far as they join components."""
    release()
    order = np.lexsort((table.column("key").to_numpy(), table.column("side").to_numpy()))
    key, root, side, copies = (table.column(x).to_numpy()[order] for x in ("key", "root", "side", "copies"))
    sets = [_unpack(table.column("elements")[int(i)].as_py()) for i in order]
    # Rows are the first side, columns the second; a chunk alone is both.
    rows = int(np.count_nonzero(side == 0))
    alone = rows == len(key)
    left = 0 if alone else rows
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[element] > 1
    owner, element = owner[shared], element[shared]
    element = np.unique(element, return_inverse=True)[1]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    top = int(element[-1]) + 1 if len(element) else 0
    linked = np.zeros(len(sets), np.int64)
    parent = {int(r): int(r) for r in root}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for i0, i1 in _tiles(0, rows):
        for j0, j1 in _tiles(i0 if alone else left, len(sets)):
            near = _near(owner, element, top, size, i0, i1, j0, j1)
            if alone and i0 == j0:
                np.fill_diagonal(near, False)
            linked[i0:i1] += near @ copies[j0:j1]
            if i0 != j0:
                linked[j0:j1] += copies[i0:i1] @ near
            near &= root[i0:i1, None] != root[None, j0:j1]
            for i, j in zip(*np.nonzero(near), strict=True):
                x, y = find(int(root[i0 + i])), find(int(root[j0 + j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(key[i0 + i])
                    b.append(key[j0 + j])
    some = np.flatnonzero(linked)
    return pa.table({"a": pa.array([*a, *key[some]], pa.int64()), "b": pa.array([*b, *[None] * len(some)], pa.int64()), "n": pa.array([*[None] * len(a), *linked[some].tolist()], pa.int64())})


def _chunk_links(torn: DataFrame, docs: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Of long lists: what _block_links finds, each key's chunk, and the pairs (x, y) of chunks that were compared."""
    long = torn.where(F.size("m") > SHORT)
    each = stored(long.select("name", F.explode("m").alias("x")).select("name", F.col("x.key").alias("key"), F.col("x.root").alias("root")), "jaccard-long")
    if each.isEmpty():
        return each.select(F.col("key").alias("a"), F.col("key").alias("b"), F.col("key").alias("n")), None, None
    keys = stored(each.select("key", "root").distinct(), "jaccard-long-keys")
    sets = stored(_wanted_sets(docs, key_filter(keys.select("key"), keys.count())).join(keys, "key").join(copies, "key"), "jaccard-long-sets")
    # A key's hub is the least key that it shares a list with. Four steps from hub
    # to hub name its family; they are not followed to their end, so families don't chain up.
    hub = each.join(long.select("name", F.element_at("m.key", 1).alias("hub")), "name").groupBy("key").agg(F.min("hub").alias("hub"))
    hub = stored(hub, "jaccard-hubs")
    family = hub.withColumn("family", F.col("hub"))
    for _ in range(2):
        further = family.select(F.col("key").alias("family"), F.col("family").alias("next"))
        family = stored(family.join(further, "family", "left").select("key", "hub", F.coalesce("next", "family").alias("family")), "jaccard-family")
    # Chunks of a large family keep the keys of one hub together.
    extent = sets.select("key", F.length("elements").alias("bytes")).join(family, "key").groupBy("family").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("bytes") / CHUNK_BYTES)).alias("chunks"))
    chunk = stored(family.join(extent, "family").select("key", F.xxhash64("family", F.pmod(F.xxhash64("hub"), F.col("chunks"))).alias("chunk")), "jaccard-chunks")
    held = each.join(chunk, "key").groupBy("name").agg(F.array_sort(F.collect_set("chunk")).alias("c")).select("c").distinct()
    pairs = stored(held.select(F.posexplode("c").alias("i", "x"), "c").select("x", F.explode(F.slice("c", F.col("i") + 1, F.size("c"))).alias("y")).distinct(), "jaccard-chunk-pairs")
    placed = stored(sets.join(chunk, "key"), "jaccard-chunk-sets")
    sizes = placed.groupBy("chunk").agg(F.count("*").alias("n"), F.sum(F.length("elements")).alias("bytes"))
    # A chunk meets its smaller partners a task's worth at a time, so it travels once for many of them.
    cross = pairs.where("x <> y").join(sizes.select(F.col("chunk").alias("x"), F.struct("n", "bytes", F.col("chunk").alias("id")).alias("p")), "x").join(sizes.select(F.col("chunk").alias("y"), F.struct("n", "bytes", F.col("chunk").alias("id")).alias("q")), "y")
    cross = cross.select(F.greatest("p", "q").id.alias("large"), F.least("p", "q").alias("small"))
    bins = cross.groupBy("large").agg(F.greatest(F.ceil(F.sum("small.n") / CHUNK), F.ceil(F.sum("small.bytes") / CHUNK_BYTES), F.lit(1)).alias("bins"))
    cross = stored(cross.join(bins, "large").select(F.xxhash64("large", F.pmod(F.xxhash64("small.id"), F.col("bins"))).alias("task"), "large", F.col("small.id").alias("small")), "jaccard-tasks")
    alone = pairs.where("x = y").select(F.xxhash64("x", F.lit(-1)).alias("task"), F.col("x").alias("chunk"), F.lit(0).alias("side"))
    sides = alone.unionAll(cross.select("task", F.col("large").alias("chunk"), F.lit(0).alias("side")).distinct()).unionAll(cross.select("task", "small", F.lit(1)))
    work = sides.join(placed, "chunk").select("task", "side", "key", "root", "copies", "elements")
    return stored(work.groupBy("task").applyInArrow(_block_links, "a long, b long, n long"), "jaccard-chunk-links"), chunk, pairs


def _every_link(lists: DataFrame, docs: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join all similar keys, and for each key (k, n) the rows of other keys similar to it."""
    alone = stored(lists.select("name", F.transform("members", lambda k: F.struct(k.alias("key"), k.alias("root"))).alias("m")), "jaccard-alone")
    found, chunk, compared = _chunk_links(alone, docs, copies)
    pairs = _short_pairs(alone)
    if chunk is not None:  # pairs that lie in compared chunks were counted there
        pairs = pairs.join(chunk.select(F.col("key").alias("a"), F.col("chunk").alias("p")), "a", "left").join(chunk.select(F.col("key").alias("b"), F.col("chunk").alias("q")), "b", "left")
        pairs = pairs.withColumn("x", F.least("p", "q")).withColumn("y", F.greatest("p", "q")).join(compared, ["x", "y"], "left_anti").select("a", "b")
    links = _linked(pairs, docs, "jaccard-2")
    ends = links.select(F.col("a").alias("k"), F.col("b").alias("key")).unionAll(links.select(F.col("b").alias("k"), F.col("a").alias("key")))
    counts = ends.join(copies, "key").select("k", F.col("copies").alias("n")).unionAll(found.where("b IS NULL").select(F.col("a").alias("k"), "n"))
    return links.unionAll(found.where("b IS NOT NULL").select("a", "b")), counts.groupBy("k").agg(F.sum("n").alias("n"))


def jaccard_components(docs: DataFrame, count_links: bool = True) -> DataFrame:
    """Rows (doc_id, n_shingles, set_key, n_links, component_id) for every row of docs.

    n_links is the number of other rows whose sets are similar or equal to the row's. It takes the
    comparison of all candidate pairs; without count_links the column is left out and only pairs that
    may join components are compared.
    """
    bound_batches(docs.sparkSession)
    with passing_tables():
        return _components(docs.select("doc_id", "text"), count_links)


#: Signatures that one bucket holds, about; each is 6 bytes and its share of a key.
BUCKET_SIGNATURES = 1 << 21


def _components(source: DataFrame, count_links: bool) -> DataFrame:
    def describe(batches):
        for part, buf, off in text_batches(batches):
            elements, at = shingle_sets(buf, off)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(set_keys(elements, at).view(np.int64))], ["doc_id", "n_shingles", "set_key"])

    rows = stored(source.mapInArrow(describe, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_key long"), "jaccard-docs", last=True)
    # A set signs about a third of its elements in each of its one or two bands.
    signed = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first().n // 2
    buckets = max(shuffle_partitions(source.sparkSession), -(-int(signed) // BUCKET_SIGNATURES))
    lists = _bucket_signatures(source, buckets).groupBy("bucket").applyInArrow(_shared_lists, "name long, times long, members array<long>, needs array<int>")
    lists = stored(lists.groupBy("name").agg(F.sum("times").alias("times"), F.first("members").alias("members"), F.first("needs").alias("needs")), "jaccard-lists")
    lists = _peeled(_peeled(lists, "jaccard-peeled-1"), "jaccard-peeled-2")
    known = stored(rows.where("n_shingles > 0").groupBy(F.col("set_key").alias("key")).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "jaccard-known")
    copies = known.select("key", "copies")
    if count_links:
        links, counts = _every_link(lists, source, copies)
        groups = components(links)
    else:
        # The first pair of a key is that with the first key of the lists that hold most of its signatures.
        each = lists.select("times", F.element_at("members", 1).alias("a"), F.explode(F.slice("members", F.lit(2), F.size("members"))).alias("b"))
        star = each.groupBy("a", "b").agg(F.sum("times").alias("n")).groupBy("b").agg(F.min_by("a", F.struct(-F.col("n"), "a")).alias("a")).select("a", "b")
        star = stored(star, "jaccard-star")
        links = _linked(star, source, "jaccard-1")
        groups = stored(components(links), "jaccard-groups")
        torn = stored(_torn(lists, groups), "jaccard-torn")
        found = _chunk_links(torn, source, copies)[0].where("b IS NOT NULL").select("a", "b")
        more = _linked(_short_pairs(torn).join(star, ["a", "b"], "left_anti"), source, "jaccard-2").unionAll(found)
        groups = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
    named = known.join(groups, known.key == groups.node, "left").select(F.col("key").alias("set_key"), "least", "copies", F.coalesce("root", "key").alias("root"))
    if count_links:
        named = named.join(counts, named.set_key == counts.k, "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("n", F.lit(0))).drop("k", "n")
    named = stored(named, "jaccard-named")
    roots = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "jaccard-roots")
    extra = ["n_links"] if count_links else []
    named = stored(named.join(roots, "root").select("set_key", "component_id", *extra), "jaccard-components", last=True)
    return rows.join(named, "set_key", "left").select("doc_id", "n_shingles", "set_key", *(F.coalesce(x, F.lit(0)).alias(x) for x in extra), F.coalesce("component_id", "doc_id").alias("component_id"))


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "n_links")
