"""Edit-aware token counts: a segment tree over each document's pre-tokens.

Leaves hold runs of pre-tokens with their lengths and numbers of tokens; inner nodes hold sums of
characters and tokens. An edit goes down by characters to its place, re-encodes from a few characters
before it (a pre-token can depend on up to CONTEXT characters after its end) until a boundary of the
new text falls on one of the old text behind the edit, replaces those pre-tokens and updates the sums
on the way up. From such a boundary on, pre-tokens depend only on the text behind it, so the rest stays.

The first count of a text takes space-delimited chunks from a bounded cache where single spaces
separate them, and the whole pattern otherwise.

Defined cases: null and empty texts have 0 tokens and a tree without pre-tokens, edits of them insert;
edit positions are clipped to the text; repeated rows count alike; other columns are ignored.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, caches, text_batches

CONTEXT = 4
LEAF = 64
CACHE_CHUNKS = 300_000
_RUN = re.compile(r"\s\s")


class Counter:
    """Pre-tokens of a text and the number of tokens of each."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.single: dict[str, int] = {}

    def tokens(self, piece: str) -> int:
        n = self.single.get(piece)
        if n is None:
            if len(self.single) > CACHE_CHUNKS:
                self.single.clear()
            n = self.single[piece] = len(self.encoding._encode_single_piece(piece.encode("utf-8", "surrogatepass")))
        return n

    def scan(self, text: str, at: int = 0):
        """(begin, end) of each pre-token from a boundary on."""
        for m in self.pattern.finditer(text, at):
            yield m.start(), m.end()

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        pieces = self.pattern.findall(text)
        return np.array([len(p) for p in pieces], np.int32).tobytes(), np.array([self.tokens(p) for p in pieces], np.int32).tobytes()

    def arrays(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and token counts of all pre-tokens."""
        if _RUN.search(text) or text[-1:].isspace():
            sizes, counts = self._whole(text)
        else:
            first, *rest = text.split(" ")
            chunks = [first, *[" " + c for c in rest]] if first else [" " + c for c in rest]
            if len(self.cache) > CACHE_CHUNKS:
                self.cache.clear()
            cache = self.cache
            for c in set(chunks):
                if c not in cache:
                    cache[c] = self._whole(c)
            got = [cache[c] for c in chunks]
            sizes, counts = b"".join([g[0] for g in got]), b"".join([g[1] for g in got])
        return np.frombuffer(sizes, np.int32), np.frombuffer(counts, np.int32)


class TokenTree:
    """A text with its number of tokens, kept through edits."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.recounted = text, counter, 0
        self._build(*(counter.arrays(text) if text else (np.zeros(0, np.int32),) * 2))

    def _build(self, sizes: np.ndarray, counts: np.ndarray) -> None:
        n = max(1, -(-len(sizes) // LEAF))
        self.base = 1 << (n - 1).bit_length()
        self.leaves = [(sizes[i * LEAF : (i + 1) * LEAF], counts[i * LEAF : (i + 1) * LEAF]) for i in range(n)]
        edges = np.arange(n) * LEAF
        self.chars, self.sums = np.zeros(2 * self.base, np.int64), np.zeros(2 * self.base, np.int64)
        if len(sizes):
            self.chars[self.base : self.base + n] = np.add.reduceat(sizes, edges)
            self.sums[self.base : self.base + n] = np.add.reduceat(counts, edges)
        size = self.base
        while size > 1:
            for a in (self.chars, self.sums):
                a[size // 2 : size] = a[size : 2 * size].reshape(-1, 2).sum(axis=1)
            size //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1])

    @property
    def n_segments(self) -> int:
        return sum(len(s) for s, _ in self.leaves)

    def _leaf(self, place: int) -> tuple[int, int]:
        """The leaf that holds character `place` and the characters before it."""
        node, before = 1, 0
        while node < self.base:
            node *= 2
            if place - before >= self.chars[node]:
                before += int(self.chars[node])
                node += 1
        leaf = min(node - self.base, len(self.leaves) - 1)
        if leaf != node - self.base:
            before = int(self.chars[1] - self.chars[self.base + leaf])
        return leaf, before

    def _put(self, leaf: int, sizes: np.ndarray, counts: np.ndarray) -> None:
        self.leaves[leaf] = sizes, counts
        node = self.base + leaf
        self.chars[node], self.sums[node] = sizes.sum(), counts.sum()
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, begin: int, end: int, new: str) -> int:
        """Replace characters begin..end by new; the number of tokens after it."""
        begin = min(max(begin, 0), len(self.text))
        end = min(max(end, begin), len(self.text))
        text = self.text[:begin] + new + self.text[end:]
        shift = len(new) - (end - begin)
        first, base = self._leaf(max(0, begin - CONTEXT))
        sizes, counts = self.leaves[first]
        bounds = base + np.cumsum(sizes)
        keep = int(np.searchsorted(bounds, begin - CONTEXT, side="right"))  # pre-tokens that end early enough stay
        at = base + int(sizes[:keep].sum())
        # Old boundaries from the edit on, taken leaf by leaf as the scan moves.
        last, reach = first, base + int(self.chars[self.base + first])
        old = set(bounds.tolist()) | {base}
        got_sizes, got_counts, stop = [], [], None
        for b, e in self.counter.scan(text, at):
            got_sizes.append(e - b)
            got_counts.append(self.counter.tokens(text[b:e]))
            if e >= begin + len(new):
                place = e - shift
                while place > reach and last + 1 < len(self.leaves):
                    last += 1
                    old |= set((reach + np.cumsum(self.leaves[last][0])).tolist())
                    reach += int(self.chars[self.base + last])
                if place >= end and place in old:
                    stop = place
                    break
        if stop is None:  # the scan ended with the text: everything behind is replaced
            stop = len(self.text)
            while last + 1 < len(self.leaves):
                last += 1
                reach += int(self.chars[self.base + last])
        self.recounted += len(got_sizes)
        tail_sizes, tail_counts = self.leaves[last]
        skip = int(np.searchsorted(reach - int(tail_sizes.sum()) + np.cumsum(tail_sizes), stop, side="right"))
        tail = tail_sizes[skip:], tail_counts[skip:]
        self.text = text
        for leaf in range(first + 1, last + 1):
            self._put(leaf, sizes[:0], counts[:0])
        self._put(first, np.concatenate([sizes[:keep], np.array(got_sizes, np.int32), tail[0]]), np.concatenate([counts[:keep], np.array(got_counts, np.int32), tail[1]]))
        if len(self.leaves[first][0]) > 8 * LEAF:  # a leaf that has grown: new leaves from the same counts
            self._build(np.concatenate([s for s, _ in self.leaves]), np.concatenate([c for _, c in self.leaves]))
        return self.n_tokens


_counters: dict[tuple[str, str], Counter] = {}


def _forget() -> None:
    for c in _counters.values():
        c.cache.clear()
        c.single.clear()


caches["counts"] = _forget


def counter(path: str, pattern: str) -> Counter:
    key = (path, pattern)
    if key not in _counters:
        _counters[key] = Counter(path, pattern)
    return _counters[key]


def review_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits that op9 applies in turn: an inserted remark in the middle, the word after the first
    quarter deleted, and the last three quarters point joined to the next character by a hyphen."""
    n = len(text)
    quarter = n // 4
    space = text.find(" ", quarter)
    begin = quarter if space < 0 else space
    end = text.find(" ", begin + 1)
    remark = " (revised: it's the reviewers' 2nd pass) "
    return [(n // 2, n // 2, remark), (begin, n if end < 0 else end, ""), (3 * n // 4, 3 * n // 4 + 1, "-")]


def count_with_edits(docs: DataFrame, path: str, pattern: str, edits=review_edits, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep`, n_tokens, n_segments, n_tokens_edited, n_recounted, n_chars_edited for every row."""
    keep = keep or ["doc_id"]
    bound_batches(docs.sparkSession)
    source = docs.select(*keep, *(["text"] if "text" not in keep else []))

    def run(batches):
        c = counter(path, pattern)
        for part, _, _ in text_batches(batches, cache="counts"):
            rows = []
            for t in part.column(part.schema.get_field_index("text")).to_pylist():
                tree = TokenTree(t or "", c)
                before, segments = tree.n_tokens, tree.n_segments
                for b, e, new in edits(t or ""):
                    tree.edit(b, e, new)
                rows.append((before, segments, tree.n_tokens, tree.recounted, len(tree.text)))
            names = ["n_tokens", "n_segments", "n_tokens_edited", "n_recounted", "n_chars_edited"]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(k)) for k in keep), *(pa.array(v, pa.int64()) for v in zip(*rows, strict=True))], [*keep, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    return source.mapInArrow(run, schema + ", n_tokens long, n_segments long, n_tokens_edited long, n_recounted long, n_chars_edited long")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
