"""Repeated-passage removal by the common-prefix interval tree of an enhanced suffix array.

The tree itself (maximal_repeats) takes the bytes of some fragments, sorts their suffixes, derives the
common-prefix lengths of neighbours, and scans them with a stack. Where fragments are little longer than
`length`, the array is sparse: it holds the suffixes whose first `length` bytes occur twice (by hash),
which are sorted by that prefix and the bytes after it; else all suffixes by prefix doubling.
An interval whose suffixes are preceded by different bytes (or by a fragment's start) is a maximal
repeat, given with all its occurrences. Neighbours with the same preceding byte are folded before the
scan, as no interval inside such a run can be left-diverse.

To spread a corpus over tasks, each string of `length` bytes gets an anchor that depends on its bytes
alone: the k-gram of least hash in it (winnowing). Equal strings share their anchor, so an anchor that
occurs once has no repeat around it. Around repeated anchors, fragments with equal bytes are repeats
of each other without more work; only fragments that differ (at the ends of passages and at edits) are
fetched, dealt by anchor and searched with the suffix array. An anchor with more than HOT different
fragments is resolved by the hashes of its strings instead, dealt by hash.

No group holds all occurrences of a hot anchor, fragment or string: each task sorts what it has before it
is dealt, sends on two of equal fragments (or strings), which are spans by then, and sends anchors that
are hot already in the task by another way, spread over all tasks, with a mark to their own group. There
are as many groups as the bytes ask for.

Defined cases: null texts are empty; texts shorter than `length` bytes keep every byte; overlapping
repeats inside one text count; rows are told apart by a number, so repeated rows repeat each other and
rows of one doc_id, or none, have their own result; an empty table gives no row; a very long text is one
step and its spans one array; other columns are ignored. Anchors and fragments are compared by 64-bit
hashes; the suffix array compares bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, bound_batches, key_filter, may_hold, mix, passing_tables, powers, release, shuffle_partitions, stored, text_batches

LENGTH = 400
GRAM = 32
#: Different fragments of one anchor up to which the suffix array takes them together.
HOT = 500
#: Steps of the distance between an anchor and a string's begin, for the contexts.
CONTEXTS = 8
#: Bytes of fragments that one suffix array holds, about.
ARRAY_BYTES = 1 << 17
_FLUSH, _FLUSH_STRINGS = 150_000, 600_000
#: Bytes of packed anchors, or strings, of one group, about; an anchor has 68, a string 24.
GROUP_BYTES = 8 << 20
#: Rows of equal fragments, or strings, that one flush sends on to their group.
_TWICE = 2


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each run of w values, by block prefixes and suffixes."""
    op = np.minimum if least else np.maximum
    n = len(x)
    rows = -(-n // w) + 1
    padded = np.full(rows * w, np.iinfo(np.uint64).max if least else 0, np.uint64)
    padded[:n] = x
    grid = padded.reshape(rows, w)
    ahead = op.accumulate(grid, axis=1).reshape(-1)
    back = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(back[: n - w + 1], ahead[w - 1 : n])


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, position, bytes to the left and right, anchor hash, fragment hash and context hashes of every anchor.

    Two equal strings around one anchor agree on L bytes to its left and R to its right with
    L + R >= length - gram. If L lies in the i-th of CONTEXTS steps they share at least the bytes from
    the step's begin on the left to length - gram less the step's end on the right: context i. An
    occurrence none of whose contexts occurs elsewhere has no repeat around it.
    """
    w = length - gram + 1
    n = len(buf)
    e = np.zeros(0, np.int64)
    if n < length or not (np.diff(off) >= length).any():
        return e, e, e, e, e.astype(np.uint64), e.astype(np.uint64), np.zeros((0, CONTEXTS), np.uint32)
    up, down = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_CODE[buf] * up[:n], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9FB21C651E98DF25)
    h |= np.uint64(1)
    least = _sliding(h, w, True)
    size = np.diff(off)
    end = np.repeat(off[1:], size)[: len(least)]
    least[np.arange(len(least)) + length > end] = 0  # strings never cross rows
    reach = np.zeros(len(h) + w - 1, np.uint64)
    reach[w - 1 : w - 1 + len(least)] = least
    p = np.flatnonzero(_sliding(reach, w, False) == h)
    row = np.searchsorted(off, p, side="right") - 1
    left = np.minimum(p - off[row], w - 1)
    right = np.minimum(off[row + 1] - p - gram, w - 1)
    begin, stop = p - left, p + gram + right
    fragment = mix((total[stop] - total[begin]) * down[begin] + mix(((left << 20) + right).astype(np.uint64)))
    contexts = np.zeros((len(p), CONTEXTS), np.uint32)
    steps = np.linspace(0, w, CONTEXTS + 1).astype(np.int64)
    for i in range(CONTEXTS):
        far = w - steps[i + 1]
        ok = np.flatnonzero((left >= steps[i]) & (right >= far))
        b, t = p[ok] - steps[i], p[ok] + gram + far
        contexts[ok, i] = np.maximum(mix((total[t] - total[b]) * down[b] + np.uint64(i)) >> np.uint64(32), np.uint64(1)).astype(np.uint32)
    return row, p - off[row], left, right, mix(h[p]), fragment, contexts


def _suffix_array(text: np.ndarray, owner_end: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and the common prefix of each suffix with the one before it, neither looking past
    a fragment's end (owner_end: the end of each position's fragment)."""
    n = len(text)
    room = owner_end - np.arange(n)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text
    head = np.zeros(n, np.uint64)
    for j in range(8):
        part = wide[j : j + n]
        head |= np.where(room > j, part + np.uint64(0), np.uint64(0)) << np.uint64(8 * (7 - j))
    # Equal heads of different lengths (a NUL against an end) are told apart by the room.
    order = np.lexsort((np.minimum(room, 8), head))
    a, r = head[order], np.minimum(room, 8)[order]
    new = np.append(False, (a[1:] != a[:-1]) | (r[1:] != r[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) + 1
    levels = [(8, rank)]
    h = 8
    while h < deep and rank.max() < n:
        follow = np.zeros(n, np.int64)
        follow[:-h or None] = np.where(room[: n - h] > h, rank[h:], 0) if n > h else 0
        key = rank * (n + 2) + follow
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, k[1:] != k[:-1])) + 1
        h *= 2
        levels.append((h, rank))
    if h == 8:
        order = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    x, y = order[:-1].copy(), order[1:].copy()
    depth = np.zeros(n - 1, np.int64)
    live = np.arange(n - 1)
    for size, ranks in reversed(levels):
        i, j = x[live] + depth[live], y[live] + depth[live]
        ok = (depth[live] < room[x[live]]) & (depth[live] < room[y[live]])
        same = np.zeros(len(live), bool)
        same[ok] = ranks[i[ok]] == ranks[j[ok]]
        # Equal ranks mean equal bytes up to `size` or to a common end.
        got = np.minimum(size, np.minimum(room[x[live]], room[y[live]]) - depth[live])
        depth[live[same]] += got[same]
    for _ in range(8):
        i, j = x + depth, y + depth
        ok = (depth < room[x]) & (depth < room[y])
        more = np.zeros(n - 1, bool)
        more[ok] = text[i[ok]] == text[j[ok]]
        if not more.any():
            break
        depth[more] += 1
    lcp[1:] = depth
    return order, lcp


def maximal_repeats(fragments: list[bytes], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length of the repeat, [(fragment, offset), ...]) for every maximal repeat of at least `length` bytes."""
    return [(size, list(zip(which.tolist(), at.tolist(), strict=True))) for size, which, at in _repeats(fragments, length)]


def _sparse_array(text: np.ndarray, begins: np.ndarray, sizes: np.ndarray, places: np.ndarray | None, length: int, rest: int) -> tuple[np.ndarray, np.ndarray]:
    """The order and common prefixes of the suffixes whose first `length` bytes occur twice.

    places names the origin of each byte: of suffixes of one origin, that with most bytes behind it stays.
    """
    n = len(text)
    starts = np.maximum(sizes - length + 1, 0)
    at = np.repeat(begins - np.append(0, np.cumsum(starts))[:-1], starts) + np.arange(starts.sum())
    room = np.repeat(begins + sizes, starts) - at
    up, down = powers(n + 1)
    total = np.append(np.uint64(0), np.cumsum(BYTE_CODE[text] * up[:n]))
    if places is not None and len(at):
        order = np.lexsort((-room, places[at]))
        kept = order[np.append(True, places[at[order]][1:] != places[at[order]][:-1])]
        at, room = at[kept], room[kept]
    h = (total[at + length] - total[at]) * down[at]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    order = order[np.append(same, False) | np.append(False, same)] if len(h) else order
    if not len(order):
        return order, order
    at, room, h = at[order], room[order] - length, h[order]
    # Groups of equal prefixes are sorted a batch at a time, so that memory holds the bytes of one batch.
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h))))
    padded = np.append(text, np.zeros(length + rest, np.uint8))
    behind = np.lib.stride_tricks.sliding_window_view(padded, rest)
    out_at, out_lcp = [], []
    i = 0
    while i < len(at):
        j = int(head[min(np.searchsorted(head, i + _BATCH), len(head) - 1)])
        j = len(at) if j <= i else j
        a, c = _sorted_batch(behind, at[i:j], room[i:j], group[i:j], length, rest)
        out_at.append(a)
        out_lcp.append(c)
        i = j
    return np.concatenate(out_at), np.concatenate(out_lcp)


_BATCH = 1 << 13


def _sorted_batch(behind: np.ndarray, at: np.ndarray, room: np.ndarray, group: np.ndarray, length: int, rest: int) -> tuple[np.ndarray, np.ndarray]:
    width = -(-rest // 8) * 8 + 8
    rows = np.zeros((len(at), 8 + width), np.uint8)
    rows[:, :8] = (group + 1).astype(">u8").view(np.uint8).reshape(-1, 8)
    rows[:, 8 : 8 + rest] = behind[at + length]
    rows[:, 8 : 8 + rest] *= np.arange(rest) < room[:, None]
    order = np.argsort(rows.view(f"S{8 + width}").reshape(-1), kind="stable")
    at, room, group, words = at[order], room[order], group[order], rows[order, 8:].copy().view(np.uint64)
    unequal = words[1:] != words[:-1]
    word = np.where(unequal.any(axis=1), unequal.argmax(axis=1), width // 8 - 1)
    i = np.arange(len(word))
    a, b = (words.view(np.uint8).reshape(len(at), -1, 8)[k, word] for k in (i + 1, i))
    differ = a != b
    common = 8 * word + np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
    lcp = np.zeros(len(at), np.int64)
    lcp[1:] = np.where(group[1:] == group[:-1], length + np.minimum(common, np.minimum(room[1:], room[:-1])), 0)
    return at, lcp


def _repeats(fragments: list[bytes], length: int, origin: np.ndarray | None = None, offset: np.ndarray | None = None):
    """(size, fragments, offsets) of every maximal repeat. With origin and offset, bytes of equal origin
    and place are one byte, so overlapping fragments of a text don't repeat each other."""
    sizes = np.array([len(f) for f in fragments], np.int64)
    text = np.frombuffer(b"".join(fragments), np.uint8)
    n = len(text)
    if n < 2 or not (sizes >= length).any():
        return
    ends = np.cumsum(sizes)
    begins = ends - sizes
    owner = np.repeat(np.arange(len(fragments)), sizes)
    rest = int(sizes.max()) - length
    places = None
    if origin is not None:
        _, number = np.unique(origin, return_inverse=True)
        places = (number[owner].astype(np.int64) << 40) + offset[owner] + np.arange(n) - begins[owner]
    if places is not None or (rest <= 512 and (text != 0).all()):
        order, lcp = _sparse_array(text, begins, sizes, places, length, max(rest, 1))
    else:
        order, lcp = _suffix_array(text, ends[owner], int(sizes.max()))
    if len(order) < 2:
        return
    before = np.where(order == begins[owner[order]], -1 - owner[order], text[order - 1].astype(np.int64))
    # Positions 1..n-1 of lcp join neighbours. Kept are the joins of unlike neighbours and, of the joins
    # between two of them, those lower than all on one side: no other join bounds a left-diverse interval.
    long = lcp >= length
    unlike = np.append(False, before[1:] != before[:-1])
    run_start = np.flatnonzero(long & ~np.append(False, long[:-1]))
    run_stop = np.flatnonzero(long & ~np.append(long[1:], False)) + 1
    for s, e in zip(run_start.tolist(), run_stop.tolist(), strict=True):
        at = s + np.flatnonzero(unlike[s:e])
        if not len(at):
            continue
        keep = unlike[s:e].copy()
        for i, j in zip([s, *(at + 1).tolist()], [*at.tolist(), e], strict=True):
            if j - i > 0:
                x = lcp[i:j]
                ahead, back = np.minimum.accumulate(x), np.minimum.accumulate(x[::-1])[::-1]
                keep[i - s] = keep[j - 1 - s] = True
                keep[i - s + 1 : j - s] |= ahead[1:] < ahead[:-1]
                keep[i - s : j - 1 - s] |= back[:-1] < back[1:]
        place = s + np.flatnonzero(keep)
        stack: list[list] = []  # [value, first join, has an unlike join]
        previous = s - 1
        for p, v, mixed in [*zip(place.tolist(), lcp[place].tolist(), unlike[place].tolist(), strict=True), (e, 0, False)]:
            first, carried = previous + 1, False
            while stack and stack[-1][0] > v:
                size, first, own = stack.pop()
                carried |= own
                if carried:
                    where = order[first - 1 : p]
                    yield size, owner[where], where - begins[owner[where]]
            if stack and stack[-1][0] == v:
                stack[-1][2] |= mixed | carried
            elif v:
                stack.append([v, first, mixed | carried])
            previous = p


def _spans(rows: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for b, e in sorted(rows):
        if out and b <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [b, e]
    return out


def _anchor_buckets(source: DataFrame, buckets: int, length: int, gram: int, hot: int, flush: int) -> DataFrame:
    """Packed anchors by bucket: a row for each bucket and batch of a task."""

    def run(batches):
        held, count = [], 0
        for part, buf, off in text_batches(batches, most=1 << 19):
            row, p, left, right, a, f, c = anchors(buf, off, length, gram)
            rid = part.column(0).to_numpy(zero_copy_only=False).view(np.int64)
            held.append((a, f, rid[row], p, left, right, c))
            count += len(p)
            if count >= flush:
                yield _packed(held, buckets, length, gram, hot)
                held, count = [], 0
        if count:
            yield _packed(held, buckets, length, gram, hot)

    return source.mapInArrow(run, "bucket int, a binary, f binary, r binary, x binary, c binary")


def _rank(*keys: np.ndarray) -> np.ndarray:
    """How many rows before each one (in a stable order) are equal to it in all keys."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    head = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
    return out


def _by_bucket(bucket: np.ndarray, names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket: the bytes of its rows in every column."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    at = list(zip(cut, np.append(cut[1:], len(bucket)), strict=True)) if len(bucket) else []
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), *(pa.array([v[i:j].tobytes() for i, j in at], pa.binary()) for v in (c[order] for c in columns))], ["bucket", *names])


#: In groups of a negative number, which are spread over all tasks: rows that are spans, and fragments of hot anchors.
_SPAN, _FETCH = 1, 2


def _packed(held: list, buckets: int, length: int, gram: int, most: int) -> pa.RecordBatch:
    a, f, r, p, left, right, c = (np.concatenate(x) for x in zip(*held, strict=True))
    x = np.stack([p, left, right], 1).astype(np.int32)
    whole = left + right + gram >= length
    bucket = ((a >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    # Anchors of more than `most` different fragments here leave a mark (a row of no text) in their group.
    rank = _rank(f, a)
    kinds, different = np.unique(a[rank == 0], return_counts=True)
    hot = kinds[different > most]
    is_hot = np.isin(a, hot)
    again = ~is_hot & (rank >= _TWICE)
    stay, send = ~is_hot & ~again, (is_hot | again) & whole
    n = len(hot)
    nothing = np.zeros(n, np.int64)
    mark = np.full((n, 3), -1, np.int32)
    columns = [
        np.concatenate([a[stay], hot, a[send]]),
        np.concatenate([f[stay], hot, np.where(is_hot[send], _FETCH, _SPAN).astype(np.uint64)]),
        np.concatenate([r[stay], nothing, r[send]]),
        np.concatenate([x[stay], mark, x[send]]),
        np.concatenate([c[stay], np.zeros((n, CONTEXTS), np.uint32), np.zeros((int(send.sum()), CONTEXTS), np.uint32)]),
    ]
    # What is sent is one row, in a group that the flush draws, so flushes spread it over all tasks.
    drawn = -1 - int(mix(r[:1].view(np.uint64))[0] % np.uint64(buckets))
    to = np.concatenate([bucket[stay], ((hot >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), np.full(int(send.sum()), drawn, np.int32)])
    return _by_bucket(to, ["a", "f", "r", "x", "c"], columns)


def _found(rid, begin, size, anchor, is_span, n) -> pa.Table:
    return pa.table({"rid": pa.array(rid), "begin": pa.array(begin.astype(np.int64)), "size": pa.array(size.astype(np.int64)), "anchor": pa.array(anchor.view(np.int64), mask=is_span), "n": pa.array(n.astype(np.int64))})


def _shared_anchors(length: int, gram: int, hot: int):
    def run(table: pa.Table) -> pa.Table:
        """Spans of fragments that occur twice or more (anchor null), and fragments to be fetched."""
        get = lambda c, kind: np.concatenate([np.frombuffer(v, kind) for v in table.column(c).to_pylist()])
        a, f, r, x, c = get("a", np.uint64), get("f", np.uint64), get("r", np.int64), get("x", np.int32).reshape(-1, 3), get("c", np.uint32).reshape(-1, CONTEXTS)
        w = length - gram + 1
        if table.column("bucket")[0].as_py() < 0:
            size = x[:, 1] + x[:, 2] + gram
            return _found(r, x[:, 0] - x[:, 1], size, a, f == _SPAN, np.where(f == _SPAN, 0, hot + 1))
        marked = np.unique(a[x[:, 0] < 0])
        keep = x[:, 0] >= 0
        a, f, r, x, c = a[keep], f[keep], r[keep], x[keep], c[keep]
        known = np.isin(a, marked)  # hot in some task, so hot everywhere
        size = x[known, 1] + x[known, 2] + gram
        ok = size >= length
        sent = _found(r[known][ok], (x[known, 0] - x[known, 1])[ok], size[ok], a[known][ok], np.zeros(ok.sum(), bool), np.full(ok.sum(), hot + 1))
        a, f, r, x, c = a[~known], f[~known], r[~known], x[~known], c[~known]
        order = np.argsort(a, kind="stable")
        a = a[order]
        many = np.append(a[1:] == a[:-1], False) | np.append(False, a[1:] == a[:-1]) if len(a) else np.zeros(0, bool)
        order, a = order[many], a[many]
        f, r, x, c = f[order], r[order], x[order], c[order]
        steps = np.linspace(0, w, CONTEXTS + 1).astype(np.int64)
        near = np.zeros(len(a), bool)
        far_left, far_right = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for i in range(CONTEXTS):
            at = np.flatnonzero(c[:, i])
            v = mix(a[at] + c[at, i].astype(np.uint64))
            by = np.argsort(v, kind="stable")
            same = v[by[1:]] == v[by[:-1]]
            hit = at[np.union1d(by[1:][same], by[:-1][same])]
            near[hit] = True
            far_left[hit] = np.maximum(far_left[hit], steps[i + 1])
            far_right[hit] = np.maximum(far_right[hit], w - steps[i])
        a, f, r, x, far_left, far_right = a[near], f[near], r[near], x[near], far_left[near], far_right[near]
        order = np.lexsort((x[:, 0], r, f, a))
        a, f, r, x, far_left, far_right = a[order], f[order], r[order], x[order], far_left[order], far_right[order]
        head = np.append(True, (a[1:] != a[:-1]) | (f[1:] != f[:-1])) if len(a) else np.zeros(0, bool)
        group = np.cumsum(head) - 1
        times = np.bincount(group) if len(a) else np.zeros(0, int)
        first = np.flatnonzero(head)
        kinds = np.unique(a[first], return_inverse=True, return_counts=True)
        distinct = kinds[2][kinds[1]][group] if len(a) else np.zeros(0, int)
        whole = x[:, 1] + x[:, 2] + gram >= length
        twice = times[group] > 1 if len(a) else np.zeros(0, bool)
        span = np.flatnonzero(twice & whole)
        fetch = np.flatnonzero(head & (distinct > 1) & whole)
        i = np.concatenate([span, fetch])
        # What is fetched reaches no further than the contexts that occur elsewhere.
        left, right = x[i, 1].astype(np.int64), x[i, 2].astype(np.int64)
        cut = np.arange(len(i)) >= len(span)
        left[cut], right[cut] = np.minimum(left, far_left[i])[cut], np.minimum(right, far_right[i])[cut]
        is_span = np.arange(len(i)) < len(span)
        n = np.concatenate([np.zeros(len(span)), distinct[fetch]])
        return pa.concat_tables([sent, _found(r[i], x[i, 0] - left, left + right + gram, a[i], is_span, n)])

    return run


def _fragment_repeats(length: int):
    def run(table: pa.Table) -> pa.Table:
        """Spans of one bucket's fragments that maximal repeats cover."""
        data, rid, begin = table.column("data").to_pylist(), table.column("rid").to_numpy(), table.column("begin").to_numpy()
        r, b, s = [], [], []
        for size, which, at in _repeats(data, length, rid, begin):
            r.append(rid[which])
            b.append(begin[which] + at)
            s.append(np.full(len(which), size))
        if not r:
            return pa.table({"rid": pa.array([], pa.int64()), "begin": pa.array([], pa.int64()), "size": pa.array([], pa.int64())})
        # Spans of one text that overlap are joined before they leave.
        r, b, e = np.concatenate(r), np.concatenate(b), np.concatenate(b) + np.concatenate(s)
        order = np.lexsort((b, r))
        r, b, e = r[order], b[order], e[order]
        base = np.cumsum(np.append(False, r[1:] != r[:-1])).astype(np.int64) << 40
        reach = np.maximum.accumulate(base + e)
        new = np.append(True, (base + b)[1:] > reach[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(b)) - 1
        return pa.table({"rid": pa.array(r[at]), "begin": pa.array(b[at]), "size": pa.array((reach[last] - base[last]) - b[at])})

    return run


def _string_hashes(length: int, buckets: int, flush: int):
    def packed(held: list) -> pa.RecordBatch:
        h, r, p = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((p, r, h))
        h, r, p = h[order], r[order], p[order]
        new = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]) | (p[1:] != p[:-1]))  # a string of two fragments counts once
        h, r, p = h[new], r[new], p[new]
        # Places beyond the second of a string are of a repeat already; they go as one row, to a group that the flush draws.
        drawn = -1 - int(mix(r[:1].view(np.uint64))[0] % np.uint64(buckets))
        bucket = np.where(_rank(h) < _TWICE, ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), drawn)
        return _by_bucket(bucket.astype(np.int32), ["h", "r", "p"], [h, r, p])

    def run(batches):
        """Hashes of all strings of `length` bytes in fragments, packed by bucket."""
        held, count = [], 0
        for batch in batches:
            data = batch.column(2).to_pylist()
            rid, begin = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k, x in enumerate(data):
                v = np.frombuffer(x, np.uint8)
                up, down = powers(len(v) + 1)
                total = np.append(np.uint64(0), np.cumsum(BYTE_CODE[v] * up[: len(v)]))
                m = len(v) - length + 1
                held.append((mix((total[length:] - total[:-length]) * down[:m]), np.full(m, rid[k]), begin[k] + np.arange(m)))
                count += m
                if count >= flush:
                    yield packed(held)
                    held, count = [], 0
        if count:
            yield packed(held)

    return run


def _equal_strings(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Places of strings that occur twice, packed by a bucket of their text."""
        get = lambda c, kind: np.concatenate([np.frombuffer(v, kind) for v in table.column(c).to_pylist()])
        h, r, p = get("h", np.uint64), get("r", np.int64), get("p", np.int64)
        if table.column("bucket")[0].as_py() >= 0:
            order = np.lexsort((p, r, h))
            h, r, p = h[order], r[order], p[order]
            new = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]) | (p[1:] != p[:-1]))
            h, r, p = h[new], r[new], p[new]
            many = np.append(h[1:] == h[:-1], False) | np.append(False, h[1:] == h[:-1])
            r, p = r[many], p[many]
        text = (mix(r.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        return pa.Table.from_batches([_by_bucket(text, ["r", "p"], [r, p])]).rename_columns(["texts", "r", "p"])

    return run


def _joined_places(length: int):
    def run(table: pa.Table) -> pa.Table:
        """Spans of the texts of one bucket: strings that touch are one span."""
        get = lambda c: np.concatenate([np.frombuffer(v, np.int64) for v in table.column(c).to_pylist()])
        r, p = get("r"), get("p")
        order = np.lexsort((p, r))
        r, p = r[order], p[order]
        new = np.append(True, (r[1:] != r[:-1]) | (p[1:] > p[:-1] + length))
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(r)) - 1
        return pa.table({"rid": pa.array(r[at]), "begin": pa.array(p[at]), "size": pa.array(p[last] + length - p[at])})

    return run


def repeated_spans(source: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows (rid, spans): begin and size of byte spans that repeats of `length` bytes or more cover.

    source has columns rid (a long that tells texts apart) and text.
    """
    spark = source.sparkSession
    bound_batches(spark)
    source = source.select("rid", "text")
    sized = int(source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b)

    def groups(bytes_: int, each: int) -> int:
        return max(each * shuffle_partitions(spark), -(-bytes_ // GROUP_BYTES))

    # An anchor is expected in every half window.
    buckets = groups(sized * 2 // (length - gram + 2) * 68, 4)
    found = _anchor_buckets(source, buckets, length, gram, HOT, _FLUSH).groupBy("bucket").applyInArrow(_shared_anchors(length, gram, HOT), "rid long, begin long, size long, anchor long, n long")
    found = stored(found, "suffix-anchors")
    spans = found.where("anchor IS NULL").select("rid", "begin", "size")
    wanted = found.where("anchor IS NOT NULL")
    total = wanted.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first().b
    if total:
        asked = wanted.groupBy("rid").agg(F.collect_list(F.struct("begin", "size", "anchor", "n")).alias("asked"))
        rids = stored(wanted.select("rid").distinct(), "suffix-rids")
        bloom = spark.sparkContext.broadcast(key_filter(rids, rids.count()))

        def sift(batches):
            release()
            for batch in batches:
                yield batch.filter(pa.array(may_hold(bloom.value, batch.column(0).to_numpy(zero_copy_only=False).view(np.int64))))

        texts = source.mapInArrow(sift, "rid long, text string")

        def cut(batches):
            release()
            for batch in (b.slice(i, 200) for b in batches for i in range(0, len(b), 200)):
                rid, text, many = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
                out = ([], [], [], [], [])
                for k in range(len(rid)):
                    raw = text[k].as_py().encode()
                    for q in many[k]:
                        for c, v in zip(out, (rid[k], q["begin"], raw[q["begin"] : q["begin"] + q["size"]], q["anchor"], q["n"]), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["rid", "begin", "data", "anchor", "n"])

        # The merge join keeps both Python steps in stages of their own, so a task has one worker.
        fragments = texts.join(asked.hint("merge"), "rid").select("rid", "text", "asked").mapInArrow(cut, "rid long, begin long, data binary, anchor long, n long")
        arrays = max(1, int(total) // ARRAY_BYTES)
        cool = fragments.where(F.col("n") <= HOT).groupBy(F.pmod(F.xxhash64("anchor"), F.lit(arrays)).alias("array")).applyInArrow(_fragment_repeats(length), "rid long, begin long, size long")
        spans = spans.unionAll(stored(cool, "suffix-repeats"))
        strings = wanted.where(F.col("n") > HOT).agg(F.coalesce(F.sum(F.col("size") - length + 1), F.lit(0)).alias("n")).first().n
        if strings:
            # Every group may have places in every group of texts, so there are no more than the bytes ask for.
            buckets = groups(24 * int(strings), 1)
            hot = fragments.where(F.col("n") > HOT).select("rid", "begin", "data").mapInArrow(_string_hashes(length, buckets, _FLUSH_STRINGS), "bucket int, h binary, r binary, p binary")
            equal = hot.groupBy("bucket").applyInArrow(_equal_strings(buckets), "texts int, r binary, p binary")
            spans = spans.unionAll(stored(equal.groupBy("texts").applyInArrow(_joined_places(length), "rid long, begin long, size long"), "suffix-hot"))
    return spans.groupBy("rid").agg(F.collect_set(F.struct("begin", "size")).alias("spans"))


def without_repeats(docs: DataFrame, keep: list[str] | None = None, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Columns `keep`, n_bytes, n_removed, n_spans, kept (binary), kept_text (kept without the
    remains of characters that a cut went through) and removed (begin and end, flat) for every row."""
    keep = keep or ["doc_id"]
    with passing_tables():
        named = stored(docs.select(F.monotonically_increasing_id().alias("rid"), *keep, *(["text"] if "text" not in keep else [])), "suffix-rows", last=True)
        spans = stored(repeated_spans(named, length, gram), "suffix-spans", last=True)
    both = named.join(spans, "rid", "left")
    both = both.select(*keep, F.coalesce("text", F.lit("")).alias("text__"), "spans")

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                text, spans = part.column(len(keep)), part.column(len(keep) + 1)
                n, gone, runs, kept, removed = [], [], [], [], []
                for k in range(len(part)):
                    raw = text[k].as_py().encode()
                    flat = _spans([(s["begin"], s["begin"] + s["size"]) for s in spans[k].as_py() or []])
                    edges = [0, *flat, len(raw)]
                    rest = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                    n.append(len(raw))
                    gone.append(len(raw) - len(rest))
                    runs.append(len(flat) // 2)
                    kept.append(rest)
                    removed.append(flat)
                cols = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()), pa.array(removed, pa.list_(pa.int64()))], [*keep, "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return both.mapInArrow(run, schema + ", n_bytes long, n_removed long, n_spans long, kept binary, kept_text string, removed array<long>")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
