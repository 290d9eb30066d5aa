"""SentencePiece encoding and decoding for merge-type vocabularies.

The text's spaces become the space mark with one in front; symbols are characters. An agenda of
adjacent symbol pairs whose concatenation is a piece, ordered by score and then by place, gives the
next merge until none is left; what is no piece falls back to bytes. No piece has a space mark after
another character or holds a line break, so merges never leave a chunk of space marks and what follows
them, and chunks are encoded once and kept in a bounded cache. Chunks new to an Arrow batch go through
the agenda side by side in numpy (each round takes the top pair of every chunk); long ones use a heap.
Every new chunk is checked against the sentencepiece library; where the two differ the library's ids
are used and counted in `n_corrected`.

Decoding is the library's decode of the whole id list.

Defined cases: null and empty texts are the end id alone and decode to the empty string; repeated rows
encode alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, caches, text_batches

MARK = "▁"
CACHE_CHUNKS = 900_000
#: Chunks of more characters than this take the heap.
LONG = 48
_CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.n = n
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.pieces = {sp.id_to_piece(i): i for i in range(n) if not special[i] and not sp.is_unused(i)}
        self.score = np.array([sp.get_score(i) for i in range(n)], np.float64)
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = sp.eos_id()
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.pieces):
            raise ValueError("a piece spans chunks: this vocabulary can't be encoded chunk by chunk")
        # Characters that only occur inside longer pieces get numbers of their own.
        self.symbol = dict(self.pieces)
        for p in self.pieces:
            for c in p:
                self.symbol.setdefault(c, len(self.symbol) + n)
        self.base = max(self.symbol.values()) + 2
        left, right, merged = [], [], []
        for p, i in self.pieces.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
        keys = np.array(left, np.int64) * self.base + np.array(right, np.int64)
        order = np.argsort(keys)
        self.pair, self.merged = keys[order], np.array(merged, np.int64)[order]
        # Agenda order: a higher score first; equal scores by place.
        self.rank = np.unique(-self.score, return_inverse=True)[1].astype(np.int64)
        bits = 1 << 22
        self.filter = np.zeros(bits, bool)
        self.filter[self._slot(self.pair)] = True
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.pieces_of: dict = {}
        self.corrected = 0

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """The merged piece of each pair key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        p = np.flatnonzero(self.filter[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.pair, keys[p]), len(self.pair) - 1)
        ok = self.pair[at] == keys[p]
        out[p[ok]] = self.merged[at[ok]]
        return out

    def _finish(self, symbols: list[tuple[int, str]]) -> list[int]:
        out = []
        for s, text in symbols:
            if 0 <= s < self.n:
                out.append(s)
            else:
                out += [self.byte[b] for b in text.encode("utf-8", "replace")]
        return out

    def heap_encode(self, chunk: str) -> list[int]:
        """One chunk by the agenda as a heap of (score order, place)."""
        text = list(chunk)
        sym = [self.symbol.get(c, -1) for c in text]
        after = list(range(1, len(text))) + [-1]
        prev = list(range(-1, len(text) - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0:
                m = self.pieces.get(text[i] + text[j])
                if m is not None:
                    heapq.heappush(agenda, (int(self.rank[m]), i, len(text[i]) + len(text[j]), m))

        for i in range(len(text) - 1):
            offer(i)
        while agenda:
            _, i, size, m = heapq.heappop(agenda)
            j = after[i] if text[i] else -1
            if j < 0 or len(text[i]) + len(text[j]) != size or self.pieces.get(text[i] + text[j]) != m:
                continue
            text[i] += text[j]
            sym[i] = m
            text[j] = ""
            after[i] = after[j]
            if after[j] >= 0:
                prev[after[j]] = i
            if prev[i] >= 0:
                offer(prev[i])
            offer(i)
        return self._finish([(s, t) for s, t in zip(sym, text, strict=True) if t])

    def agenda_encode(self, chunks: list[str]) -> list[list[int]]:
        """Chunks side by side: each round merges the top pair of every chunk that has one."""
        size = np.array([len(c) for c in chunks], np.int64)
        joined = "".join(chunks)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes, inverse = np.unique(points, return_inverse=True)
        sym = np.array([self.symbol.get(chr(c), -1) for c in codes], np.int64)[inverse]
        place = np.arange(len(sym))
        owner = np.repeat(np.arange(len(chunks)), size)
        fixed_sym, fixed_place, fixed_owner = [], [], []
        none = np.iinfo(np.int64).max
        while len(sym):
            keys = sym[:-1] * self.base + sym[1:]
            open_ = (owner[:-1] == owner[1:]) & (sym[:-1] >= 0) & (sym[1:] >= 0)
            m = np.full(len(sym), -1, np.int64)
            at = np.flatnonzero(open_)
            m[at] = self._lookup(keys[at])
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            order = np.where(m >= 0, self.rank[np.maximum(m, 0)] * (1 << 32) + np.arange(len(sym)), none)
            top = np.minimum.reduceat(order, start)
            more = top < none
            alive = np.repeat(more, np.diff(np.append(start, len(sym))))
            fixed_sym.append(sym[~alive])
            fixed_place.append(place[~alive])
            fixed_owner.append(owner[~alive])
            hit = top[more] & ((1 << 32) - 1)
            sym[hit] = m[hit]
            alive[hit + 1] = False
            sym, place, owner = sym[alive], place[alive], owner[alive]
        sym, place, owner = (np.concatenate(x) for x in (fixed_sym, fixed_place, fixed_owner))
        order = np.argsort(place, kind="stable")
        sym, owner = sym[order], owner[order]
        place = place[order]
        cut = np.searchsorted(owner, np.arange(len(chunks) + 1))
        plain = (sym >= 0) & (sym < self.n)
        bad = np.unique(owner[~plain])
        out = [sym[cut[i] : cut[i + 1]].tolist() for i in range(len(chunks))]
        for i in bad:
            # Unmerged characters have no piece: each is a symbol of one character.
            ids = []
            for k in range(cut[i], cut[i + 1]):
                ids += [int(sym[k])] if plain[k] else [self.byte[b] for b in joined[place[k]].encode("utf-8", "replace")]
            out[i] = ids
        return out

    def _learn(self, new: list[str]) -> None:
        """Encode chunks by the agenda, check them against the library, and cache ids and their decimal text."""
        short = [c for c in new if len(c) <= LONG]
        ids = dict(zip(short, self.agenda_encode(short), strict=True)) if short else {}
        for c in new:
            if len(c) > LONG:
                ids[c] = self.heap_encode(c)
        # The library puts a mark in front of a sentence; after a line break it leaves chunks as they are.
        plain = [c for c in new if c[0] == MARK]
        other = [c for c in new if c[0] != MARK]
        checked = dict(zip(plain, self.library.encode([c[1:].replace(MARK, " ") for c in plain], num_threads=1), strict=True))
        checked |= {c: e[2:] for c, e in zip(other, self.library.encode(["\n" + c.replace(MARK, " ") for c in other], num_threads=1), strict=True)}
        for c in new:
            got = ids[c]
            if got != checked[c] and c != MARK:
                got = checked[c]
                self.corrected += 1
            self.cache[c] = (np.array(got, np.uint32).tobytes(), " ".join(map(str, got)).encode())

    def encode(self, texts: list[str], cached: int = 0) -> list[tuple[np.ndarray, bytes]]:
        """Ids with the end id, and the same as decimal numbers joined by spaces, for each text; `cached` words are kept about."""
        cached = cached or CACHE_CHUNKS
        if len(self.cache) > cached // 5:  # words keep what they need
            self.cache.clear()
        if len(self.pieces_of) > cached:
            self.pieces_of.clear()
        words, at = [], [0]
        for t in texts:
            s = t.replace("\n", " \n")
            if not t:
                pass
            elif "  " in s or s[0] == " " or s[-1] == " " or MARK in s:
                words += [(MARK, c) for c in _CHUNK.findall(MARK + t.replace(" ", MARK))]
            else:
                words += s.split(" ")  # a word after a line break begins with it and has no space mark
            at.append(len(words))
        if new := set(words).difference(self.pieces_of):
            parts = {w: [w[1]] if isinstance(w, tuple) else _CHUNK.findall(w if w[0] == "\n" else MARK + w) for w in new}
            chunks = {c for p in parts.values() for c in p if c not in self.cache}
            if chunks:
                self._learn(list(chunks))
            for w, p in parts.items():
                self.pieces_of[w] = self.cache[p[0]] if len(p) == 1 else (b"".join([self.cache[c][0] for c in p]), b" ".join([self.cache[c][1] for c in p]))
        got = list(map(self.pieces_of.__getitem__, words))
        out = []
        tail_ids, tail = np.array([self.end], np.uint32).tobytes(), str(self.end).encode()
        for i, j in zip(at, at[1:], strict=False):
            some = got[i:j]
            out.append((np.frombuffer(b"".join([g[0] for g in some]) + tail_ids, np.uint32), b" ".join([*[g[1] for g in some], tail])))
        return out


_models: dict[str, PieceModel] = {}


def _forget() -> None:
    for m in _models.values():
        m.cache.clear()
        m.pieces_of.clear()


caches["pieces"] = _forget


def model(path: str) -> PieceModel:
    """One model for each Python worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_pieces(docs: DataFrame, model_path: str, keep: list[str] | None = None, with_ids: bool = False, cached: int = 0) -> DataFrame:
    """Columns `keep`, n_tokens, ids_sha256, decoded_sha256, n_corrected[, ids, decoded] for every row.

    `cached` bounds the words that a worker remembers (0: CACHE_CHUNKS); fewer take less memory and more time.
    """
    keep = keep or ["doc_id"]
    bound_batches(docs.sparkSession)
    source = docs.select(*keep, *(["text"] if "text" not in keep else []))

    def run(batches):
        m = model(model_path)
        for part, _, _ in text_batches(batches, most=1 << 20, cache="pieces"):
            texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            before = m.corrected
            coded = m.encode(texts, cached)
            decoded = [m.library.decode(i.tolist()) for i, _ in coded]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            cols = [part.column(part.schema.get_field_index(c)) for c in keep]
            cols += [pa.array([len(i) for i, _ in coded], pa.int64()), pa.array([sha(s) for _, s in coded]), pa.array([sha(d.encode("utf-8", "surrogatepass")) for d in decoded])]
            cols.append(pa.array([m.corrected - before] + [0] * (len(part) - 1), pa.int64()))
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"]
            if with_ids:
                cols += [pa.array([i.astype(np.int32) for i, _ in coded], pa.list_(pa.int32())), pa.array(decoded)]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    schema += ", n_tokens long, ids_sha256 string, decoded_sha256 string, n_corrected long" + (", ids array<int>, decoded string" if with_ids else "")
    return source.mapInArrow(run, schema)


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected")
