"""Token ids in a binary file format coded by a static range asymmetric numeral system (rANS).

A file holds the ids of some documents in order: a header, the documents' ids and lengths, one
frequency table that all blocks share, and blocks of BLOCK tokens. A block interleaves LANES coder
states into one stream of 16-bit words: token i belongs to lane i % LANES, and at each step the lanes
that need a word take the next ones in lane order. Every CHECKPOINT steps the states and the place in
the stream are stored, so each such segment can be decoded alone and all segments of a file are decoded
side by side. The head (documents' ids, lengths and the frequency table) and each block have a CRC-32 of
their stored bytes; the reader refuses a file in which one differs.

Vocabularies of up to 2**16 different ids in one file are supported. Encoding and decoding are numpy
over all lanes of all blocks at once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"LGRANS02"
LANES, BLOCK, CHECKPOINT = 64, 1 << 15, 128
_SCALE = 16
_TOTAL = 1 << _SCALE
_LOW = 1 << 16
_HEAD = struct.Struct("<8sIQQI")  # magic, documents, tokens, tokens of this part before the file, symbols
_BLOCK_HEAD = struct.Struct("<III")  # tokens, words, checkpoints
_SUM = struct.Struct("<I")  # CRC-32 of the bytes before, back to the last one


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that add up to 2**16, near to proportional."""
    if len(counts) > _TOTAL:
        raise ValueError(f"more than {_TOTAL} different ids in one file")
    f = np.maximum(1, np.floor(counts * (_TOTAL / counts.sum())).astype(np.int64))
    while (extra := int(f.sum()) - _TOTAL) > 0:
        order = np.argsort(-f, kind="stable")
        order = order[f[order] > 1]
        take = np.minimum(f[order] - 1, np.maximum(1, extra * f[order] // max(int(f[order].sum()), 1)))
        take = np.where(np.cumsum(take) <= extra, take, np.maximum(0, extra - (np.cumsum(take) - take)))
        f[order] -= take
    f[int(np.argmax(f))] += _TOTAL - int(f.sum())
    return f


def _encode(symbols: np.ndarray, freq: np.ndarray, cum: np.ndarray):
    """symbols: blocks x steps x lanes. Words, their mask (both in that shape), and states before each step's decode."""
    b, t, lanes = symbols.shape
    x = np.full((b, lanes), _LOW, np.uint64)
    words = np.zeros((b, t, lanes), np.uint16)
    mask = np.zeros((b, t, lanes), bool)
    states = {}
    freq, cum = freq.astype(np.uint64), cum.astype(np.uint64)
    for i in range(t - 1, -1, -1):
        f = freq[symbols[:, i]]
        m = x >= (f << np.uint64(16))
        words[:, i] = x.astype(np.uint16)
        mask[:, i] = m
        x = np.where(m, x >> np.uint64(16), x)
        q = x // f
        x = (q << np.uint64(_SCALE)) + (x - q * f) + cum[symbols[:, i]]
        if i % CHECKPOINT == 0:
            states[i] = x.astype(np.uint32)
    return words, mask, states


def _write_blocks(symbols: np.ndarray, tokens: int, freq: np.ndarray, cum: np.ndarray) -> list[bytes]:
    words, mask, states = _encode(symbols, freq, cum)
    out = []
    for b in range(len(symbols)):
        places = np.append(0, np.cumsum(mask[b].sum(axis=1)))
        points = sorted(states)
        body = b"".join([np.array([places[i] for i in points], "<u4").tobytes(), np.stack([states[i][b] for i in points]).astype("<u4").tobytes(), words[b][mask[b]].astype("<u2").tobytes()])
        body = _BLOCK_HEAD.pack(tokens, int(places[-1]), len(points)) + body
        out.append(body + _SUM.pack(zlib.crc32(body)))
    return out


def write(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, before: int = 0) -> bytes:
    """The bytes of a file: documents' ids and numbers of tokens, and all tokens one after the other."""
    if len(ids) and int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        table = np.flatnonzero(counts)
        number = np.zeros(len(counts), np.int32)
        number[table] = np.arange(len(table))
        symbols, counts = number[ids], counts[table]
    else:
        table, symbols, counts = np.unique(ids, return_inverse=True, return_counts=True)
    parts = [_HEAD.pack(MAGIC, len(doc_ids), len(ids), before, len(table))]
    parts.append(np.array([d is not None for d in doc_ids], np.uint8).tobytes())
    parts.append(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    parts.append(np.asarray(lengths).astype("<u4").tobytes())
    if len(ids):
        freq = frequencies(counts.astype(np.float64))
        cum = np.append(0, np.cumsum(freq))[:-1]
        parts += [table.astype("<u4").tobytes(), freq.astype("<u4").tobytes()]
    head = b"".join(parts)
    parts = [head, _SUM.pack(zlib.crc32(head))]
    if len(ids):
        whole = len(ids) // BLOCK
        for at in range(0, whole, 64):
            n = min(64, whole - at)
            parts += _write_blocks(symbols[at * BLOCK : (at + n) * BLOCK].reshape(n, -1, LANES), BLOCK, freq, cum)
        if rest := len(ids) - whole * BLOCK:
            steps = -(-rest // LANES)
            last = np.zeros(steps * LANES, np.int64)
            last[:rest] = symbols[whole * BLOCK :]
            parts += _write_blocks(last.reshape(1, steps, LANES), rest, freq, cum)
    return b"".join(parts)


def _checked(data: bytes, begin: int, end: int) -> int:
    """The place behind the checksum of data[begin:end]; raises ValueError where it differs."""
    if end + _SUM.size > len(data) or _SUM.unpack_from(data, end)[0] != zlib.crc32(memoryview(data)[begin:end]):
        raise ValueError("checksum of a token file differs")
    return end + _SUM.size


def read(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """Documents' ids, their numbers of tokens, all tokens, and the tokens of the part before the file."""
    magic, docs, tokens, before, symbols = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEAD.size
    blocks = _checked(data, 0, at + 13 * docs + 8 * symbols)
    known = np.frombuffer(data, np.uint8, docs, at)
    ids = np.frombuffer(data, "<i8", docs, at + docs)
    lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs).astype(np.int64)
    doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
    at += 13 * docs
    table = np.frombuffer(data, "<u4", symbols, at)
    freq = np.frombuffer(data, "<u4", symbols, at + 4 * symbols).astype(np.uint64)
    at = blocks
    out = np.zeros(tokens, np.uint32)
    if not tokens:
        return doc_ids, lengths, out, before
    slot = np.repeat(np.arange(symbols, dtype=np.int32), freq.astype(np.int64))
    cum = np.append(np.uint64(0), np.cumsum(freq))[:-1]
    offset = np.arange(_TOTAL, dtype=np.uint64) - cum[slot]
    by_slot = freq[slot]
    lanes, places, steps, firsts, words = [], [], [], [], []
    size = done = 0
    while done < tokens:
        if at + _BLOCK_HEAD.size > len(data):
            raise ValueError("a token file ends early")
        n, count, points = _BLOCK_HEAD.unpack_from(data, at)
        begin, at = at, at + _BLOCK_HEAD.size
        after = _checked(data, begin, at + points * 4 * (1 + LANES) + 2 * count)
        places.append(np.frombuffer(data, "<u4", points, at).astype(np.int64) + size)
        lanes.append(np.frombuffer(data, "<u4", points * LANES, at + 4 * points).reshape(points, LANES))
        words.append(np.frombuffer(data, "<u2", count, at + 4 * points * (1 + LANES)))
        total = -(-n // LANES)
        steps.append(np.minimum(CHECKPOINT, total - CHECKPOINT * np.arange(points)))
        firsts.append(done + CHECKPOINT * LANES * np.arange(points))
        size += count
        done += n
        at = after
    x = np.concatenate(lanes).astype(np.uint64)
    place, step, first = np.concatenate(places), np.concatenate(steps), np.concatenate(firsts)
    stream = np.append(np.concatenate(words), np.zeros(LANES, np.uint16)).astype(np.uint64)
    order = np.argsort(-step, kind="stable")  # segments that end early drop off the end
    x, place, step, first = x[order], place[order], step[order], first[order]
    symbol = np.zeros((len(x), CHECKPOINT, LANES), np.int32)
    for i in range(int(step.max())):
        live = int(np.searchsorted(-step, -i, side="left"))
        v = x[:live]
        low = (v & np.uint64(_TOTAL - 1)).astype(np.int64)
        symbol[:live, i] = slot[low]
        v = by_slot[low] * (v >> np.uint64(_SCALE)) + offset[low]
        need = v < _LOW
        taken = np.cumsum(need, axis=1)
        at_word = place[:live, None] + taken - 1
        v = np.where(need, (v << np.uint64(16)) | stream[np.where(need, at_word, 0)], v)
        place[:live] += taken[:, -1]
        x[:live] = v
    for k in range(len(x)):
        n = min(int(step[k]) * LANES, tokens - int(first[k]))
        out[first[k] : first[k] + n] = table[symbol[k].reshape(-1)[:n]]
    return doc_ids, lengths, out, before
