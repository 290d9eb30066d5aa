"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are the byte n-grams (2 to 4) of lower-cased words with a boundary byte on each side,
hashed to 2**bits rows of an embedding table. A text's vector is the mean of its subwords'
embeddings; a linear softmax over it gives language probabilities. Table and softmax are trained
jointly by stochastic gradient descent in numpy. At prediction the two are folded into one table of
per-bucket class contributions, so a text costs one gather and one sum per n-gram.

Rejection is calibrated on a held-back part of the training sample: a temperature is fitted by
likelihood, and the rejection threshold is the score below which the wanted share (reject_rate)
of correctly labelled held-back texts falls.

Defined cases: null texts and texts without a letter get lang_pred `und` and score 0; a text with
letters always gets a learned value (`rejected` says whether to trust it); without any labelled row
every text is `und`. Repeated rows predict alike; of a doc_id's several texts in one language the least is
learned; an empty table gives no row; a very long text is a step of its own; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BYTE_CODE, bound_batches, mix, text_batches, within_bytes


@dataclass
class LanguageConfig:
    """max_per_lang bounds the labelled rows that training reads (those least by a hash of doc_id), max_bytes_per_lang
    their texts, max_pieces_per_lang the pieces of them that one epoch visits."""

    max_per_lang: int = 700
    max_bytes_per_lang: int = 8 << 20
    max_pieces_per_lang: int = 1500
    bits: int = 16
    dim: int = 16
    epochs: int = 4
    rate: float = 0.5
    piece_bytes: int = 400
    reject_rate: float = 0.01
    seed: int = 11


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII letters and all bytes of other characters are kept; the rest is one boundary byte.
_LOWER[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 0x20
_ORDERS = (2, 3, 4)


def grams(buf: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every subword."""
    n = len(off) - 1
    # A boundary byte before each row and after the last keeps n-grams within rows.
    length = np.diff(off)
    padded = np.full(len(buf) + n + 1, 0x20, np.uint8)
    at = np.arange(len(buf)) + np.repeat(np.arange(1, n + 1), length)
    padded[at] = _LOWER[buf]
    space = padded == 0x20
    code = BYTE_CODE[padded]
    row_at = np.repeat(np.arange(n + 1), np.append(length + 1, 1))
    buckets, rows = [], []
    shift = np.uint64(64 - bits)
    for k in _ORDERS:
        m = len(padded) - k + 1
        if m <= 0:
            continue
        h = code[:m].copy()
        for j in range(1, k):
            h *= np.uint64(0x2545F4914F6CDD1D)
            h += code[j : j + m]
        inner = np.zeros(m, bool)
        for j in range(1, k - 1):
            inner |= space[j : j + m]
        # No n-gram has a boundary inside or at both ends.
        ok = np.flatnonzero(~(inner | (space[:m] & space[k - 1 : k - 1 + m])))
        buckets.append((mix(h[ok] + np.uint64(k)) >> shift).astype(np.int32))
        rows.append(row_at[ok])
    if not buckets:
        e = np.zeros(0, np.int64)
        return e, e
    return np.concatenate(buckets), np.concatenate(rows)


def _mean_logits(buf: np.ndarray, off: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    b, r = grams(buf, off, bits)
    n, k = len(off) - 1, table.shape[1]
    count = np.maximum(np.bincount(r, minlength=n), 1)
    return np.stack([np.bincount(r, table[b, c], n) / count for c in range(k)], axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str | None], langs: list[str], config: LanguageConfig) -> LanguageModel:
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((1 << config.bits, 1), np.float32), np.zeros(1), 1.0, 1.0)
    y_doc = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(config.seed)
    held = rng.random(len(texts)) < 0.2
    # Whole texts are cut into pieces so that short texts are as familiar as long ones.
    pieces, y, side = [], [], []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        at = 0
        while at < len(raw):
            size = int(rng.integers(config.piece_bytes // 8, config.piece_bytes))
            pieces.append(raw[at : at + size])
            y.append(y_doc[i])
            side.append(held[i])
            at += size
    if not pieces:
        return LanguageModel(names, np.zeros((1 << config.bits, len(names)), np.float32), np.zeros(len(names)), 1.0, 1.0)
    y, side = np.array(y), np.array(side)
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    off = np.append(0, np.cumsum([len(p) for p in pieces])).astype(np.int64)
    size, k = 1 << config.bits, len(names)
    emb = rng.normal(0, 0.1, (size, config.dim)).astype(np.float32)
    soft = np.zeros((config.dim, k), np.float32)
    bias = np.zeros(k, np.float32)
    # Pieces of a class with many bytes must not drown those of a class with few.
    use = np.flatnonzero(~side)
    use = np.concatenate([rng.permutation(use[y[use] == c])[: config.max_pieces_per_lang] for c in range(k)])
    steps_all = max(1, config.epochs * len(use) // 32)
    step = 0
    cached = {}
    for _ in range(config.epochs):
        order = rng.permutation(use)
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            bs, rs = [], []
            for q, i in enumerate(some):
                if i not in cached:
                    cached[i] = grams(buf[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]), config.bits)[0]
                bs.append(cached[i])
                rs.append(np.full(len(cached[i]), q))
            b, r = np.concatenate(bs), np.concatenate(rs)
            count = np.maximum(np.bincount(r, minlength=len(some)), 1)
            vec = np.zeros((len(some), config.dim), np.float32)
            np.add.at(vec, r, emb[b])
            vec /= count[:, None]
            p = _softmax(vec @ soft + bias)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            rate = config.rate * (1 - step / steps_all) * 4
            grad = (p @ soft.T).astype(np.float32)
            soft -= rate * (vec.T @ p).astype(np.float32)
            bias -= rate * p.sum(0).astype(np.float32)
            np.subtract.at(emb, b, (rate * 10 * grad / count[:, None])[r].astype(np.float32))
            step += 1
    table = (emb @ soft).astype(np.float32)
    model = LanguageModel(names, table, bias.astype(float), 1.0, 0.0)
    back = np.flatnonzero(side)
    if len(back):
        z = np.concatenate([_mean_logits(buf[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]), table, config.bits) for i in back]) + bias
        loss = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(back)), y[back]], 1e-12)).mean() for t in np.geomspace(0.05, 8, 40)}
        model.temperature = float(min(loss, key=loss.get))
        p = _softmax(z / model.temperature)
        right = p.argmax(1) == y[back]
        if right.any():
            model.reject_below = float(np.quantile(p.max(1)[right], config.reject_rate))
    return model


def predict(buf: np.ndarray, off: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    bits = int(len(model.table)).bit_length() - 1
    p = _softmax((_mean_logits(buf, off, model.table, bits) + model.bias) / model.temperature)
    return p.argmax(1), p.max(1)


def fit(docs: DataFrame, learn: Column, config: LanguageConfig | None = None) -> LanguageModel:
    """Train on a bounded sample of the rows with a language for which `learn` holds."""
    config = config or LanguageConfig()
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    key = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = F.row_number().over(Window.partitionBy("lang").orderBy(*key))  # Catalyst keeps the least of each task before the shuffle
    sample = known.select("doc_id", "lang").withColumn("k__", first).where(F.col("k__") <= config.max_per_lang).select("doc_id", "lang").distinct()
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(sample), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = within_bytes(texts, "lang", key, config.max_bytes_per_lang).toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    return train(rows.column("text").to_pylist(), rows.column("lang").to_pylist(), config)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep`, then lang_pred, score and rejected, for every row of docs."""
    keep = keep or ["doc_id"]
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2**bits rows of one float a language
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    source = docs.select(*keep, F.col("text").alias("text__"), letter.alias("letter__"))

    def run(batches):
        m = shared.value
        for part, buf, off in text_batches(batches, "text__"):
            best, p = predict(buf, off, m)
            ok = part.column(part.schema.get_field_index("letter__")).to_numpy(zero_copy_only=False) & bool(m.langs)
            names = np.array([*m.langs, "und"], object)
            lang = names[np.where(ok, best, len(m.langs))]
            p = np.where(ok, p, 0.0)
            cols = [part.column(part.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(p), pa.array(p < m.reject_below)], [*keep, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    return source.mapInArrow(run, schema + ", lang_pred string, score double, rejected boolean")


def held_out(remainder: int = 0, modulus: int = 5, column: str = "doc_id") -> Column:
    return (F.crc32(F.col(column).cast("string").cast("binary")) % modulus) == remainder


def op1_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, fit(docs, ~held_out()))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
