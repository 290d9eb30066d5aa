"""Toxicity by multiple-instance learning: document labels train sentence scores.

A sentence's logit is a bias plus the weights of its distinct features (hashes of its words and of
their first 3 to 6 bytes); a document's score is the noisy-or of its sentences' probabilities.
Training maximises the likelihood of document labels through the noisy-or (AdaGrad in numpy, with
an L1 shrink), so the sentences that explain a label are located without sentence labels. Scores are
then shifted so that THRESHOLD is the best place between the classes on documents held back for that.

Defined cases: null, empty and word-free texts have no sentence and score 0.0; without a labelled
row of each class every score is 0.0; repeated rows score alike; of a doc_id's several labels the largest
and of its several texts the least is learned; an empty table gives no row; a very long text is scored
whole, in a step of its own; columns other than the named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, bound_batches, steps, text_batches, text_buffer, within_bytes, words

PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.7


@dataclass
class ToxicityConfig:
    """max_labelled_per_class bounds the labelled rows that training reads (those least by a hash of doc_id), max_bytes_per_class their texts."""

    max_labelled_per_class: int = 4000
    max_bytes_per_class: int = 32 << 20
    bits: int = 19
    epochs: int = 6
    batch_docs: int = 64
    rate: float = 0.3
    shrink: float = 2e-5
    bias: float = -7.0
    #: Share of the sample that the scores' shift is found on.
    held_back: float = 0.25
    seed: int = 7


_BREAK = np.zeros(256, bool)
_BREAK[[0x0A, 0x21, 0x2E, 0x3F]] = True


def features(buf: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentence-grain sparse features: bucket and sentence of each distinct entry; each sentence's row, first and last byte.

    Sentences end at . ! ? or a line break and hold at least one word.
    """
    h, start, end, row, first = words(buf, off, ALNUM_WORDS, PREFIXES)
    if not len(h):
        e = np.zeros(0, np.int64)
        return e, e, e, e, e
    breaks = np.cumsum(_BREAK[buf], dtype=np.int64)[start]
    new = np.ones(len(h), bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
    sentence = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    shift = np.uint64(64 - bits)
    bucket = np.concatenate([(h >> shift).astype(np.int64), *((f[f > 0] >> shift).astype(np.int64) for f in first)])
    owner = np.concatenate([sentence, *(sentence[f > 0] for f in first)])
    return bucket, owner, row[at], start[at], end[np.append(at[1:], len(h)) - 1]


def _distinct(bucket: np.ndarray, owner: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((owner << bits) | bucket)
    return both & ((1 << bits) - 1), both >> bits


def train(texts: list[str | None] | pa.ChunkedArray, labels: np.ndarray, config: ToxicityConfig) -> np.ndarray:
    """Weights of length 2**bits + 2: the buckets', the bias and the shift of scores. -inf is the bias when one class is missing."""
    size = 1 << config.bits
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return np.append(np.zeros(size), [-np.inf, 0]).astype(np.float32)
    buf, off = text_buffer(texts if isinstance(texts, pa.ChunkedArray) else pa.array(texts, pa.large_string()))

    def each():
        for i, j in steps(off):
            b, s, row, _, _ = features(buf[off[i] : off[j]], off[i : j + 1] - off[i], config.bits)
            b, s = _distinct(b, s, config.bits)
            at = np.searchsorted(row[s] if len(s) else s, np.arange(j - i + 1))
            for k in range(j - i):
                yield b[at[k] : at[k + 1]], s[at[k] : at[k + 1]]

    # Two passes, so that memory only holds buckets of three training documents or more.
    seen = np.zeros(size, np.int32)
    for b, _ in each():
        seen[np.unique(b)] += 1
    kept = seen >= 3
    docs = []
    for b, s in each():
        names, number = np.unique(s, return_inverse=True)
        docs.append((b[kept[b]].astype(np.int32), number[kept[b]].astype(np.int32), len(names)))
    del buf, off
    rng = np.random.default_rng(config.seed)
    every = np.arange(len(docs))
    back = rng.random(len(docs)) < config.held_back
    shift = 0.0
    if min(y[back].sum(), y[~back].sum()) > 0 and min((1 - y[back]).sum(), (1 - y[~back]).sum()) > 0:
        shift = _shift(_noisy_or([docs[d] for d in every[back]], _learn(docs, y, every[~back], config, rng)), y[back])
    return np.append(_learn(docs, y, every, config, rng), shift).astype(np.float32)


def _noisy_or(docs: list, weight: np.ndarray) -> np.ndarray:
    """Document scores of (bucket, sentence, number of sentences)."""
    out = []
    for b, s, n in docs:
        z = np.bincount(s, weight[b], n) + weight[-1]
        out.append(-np.expm1(np.log1p(-np.minimum(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 - 1e-12)).sum()))
    return np.array(out)


def _shift(scores: np.ndarray, y: np.ndarray) -> float:
    """What to add to a score's logit so that THRESHOLD is where held-back documents are told apart best (by F1).

    Training pulls weakly on documents with little evidence, so the place lies below THRESHOLD, if anywhere.
    """
    places = np.linspace(0.2, THRESHOLD, 26)
    f1 = [2 * (y * (scores >= t)).sum() / (y.sum() + (scores >= t).sum()) for t in places]
    best = float(places[np.isclose(f1, max(f1))].max())
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(best / (1 - best)))


def _learn(docs: list, y: np.ndarray, rows: np.ndarray, config: ToxicityConfig, rng: np.random.Generator) -> np.ndarray:
    """Weights of length 2**bits + 1, the last the bias, from some of the documents."""
    size = 1 << config.bits
    weight = np.zeros(size + 1)
    weight[size] = config.bias
    toxic = y[rows].sum()
    pull = np.where(y > 0, 0.5 * len(rows) / toxic, 0.5 * len(rows) / (len(rows) - toxic))
    past = np.full(size + 1, 1e-2)
    for _ in range(config.epochs):
        order = rng.permutation(rows)
        for at in range(0, len(order), config.batch_docs):
            some = order[at : at + config.batch_docs]
            counts = np.array([docs[d][2] for d in some])
            base = np.append(0, np.cumsum(counts))
            b = np.concatenate([docs[d][0] for d in some])
            s = np.concatenate([docs[d][1] + base[k] for k, d in enumerate(some)])
            z = np.bincount(s, weight[b], base[-1]) + weight[size]
            q = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-12, 1 - 1e-9)
            owner = np.repeat(np.arange(len(some)), counts)
            clean = np.exp(np.bincount(owner, np.log1p(-q), len(some)))
            clean = np.clip(clean, 1e-9, 1 - 1e-9)
            # A share of labels is noise, so a positive without evidence pulls with a bounded force.
            force = np.where(y[some] > 0, -np.minimum(clean / (1 - clean), 5.0), 1.0) * pull[some]
            g = force[owner] * q
            u, where = np.unique(b, return_inverse=True)
            grad = np.append(np.bincount(where, g[s], len(u)), 0.02 * g.sum())
            at_all = np.append(u, size)
            past[at_all] += grad**2
            step = config.rate * grad / np.sqrt(past[at_all])
            moved = weight[at_all] - step
            moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - config.shrink * len(some), 0)
            weight[at_all] = moved
    return weight


def score_rows(buf: np.ndarray, off: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Document scores, sentence scores and the sentences' (row, first byte, last byte)."""
    bits = int(len(weight) - 1).bit_length() - 1
    bias, shift = float(weight[1 << bits]), float(weight[-1])
    n = len(off) - 1
    b, s, row, begin, end = features(buf, off, bits)
    w = weight[b]
    used = w != 0
    b, s = _distinct(b[used], s[used], bits)
    z = np.bincount(s, weight[b], len(row)) + bias
    q = np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -700, 30))))
    doc = -np.expm1(np.bincount(row, np.log1p(-np.minimum(q, 1 - 1e-12)), n))
    # The logit shifted: odds times a factor, so 0 and 1 stay what they are.
    doc = np.clip(doc, 0, 1)
    up = np.exp(shift)
    return doc * up / (1 - doc + doc * up), q, (row, begin, end)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, config: ToxicityConfig | None = None) -> np.ndarray:
    """Train on a bounded sample of the labelled rows of docs for which `learn` holds."""
    config = config or ToxicityConfig()
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(learn)
    key = F.xxhash64("doc_id")
    sample = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(key, "doc_id").limit(config.max_labelled_per_class)
        sample = part if sample is None else sample.unionAll(part)
    # Bounded by the limit above; of several texts of one doc_id the least is read.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = within_bytes(texts, "toxic", [key, F.col("doc_id")], config.max_bytes_per_class).select("doc_id", "text", "toxic").toArrow().sort_by("doc_id")
    return train(rows.column("text"), rows.column("toxic").to_numpy(), config)


def score(docs: DataFrame, weight: np.ndarray, keep: list[str] | None = None, sentences: bool = False) -> DataFrame:
    """Columns `keep` of docs (doc_id by default), score and n_sentences for every row.

    With `sentences`, also `offending`: the text, score and byte range of each sentence of 0.5 or more.
    """
    keep = keep or ["doc_id"]
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(weight)  # fixed size: 2**bits + 2 floats
    source = docs.select(*keep, *(["text"] if "text" not in keep else []))
    kind = pa.list_(pa.struct([("text", pa.string()), ("score", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for part, buf, off in text_batches(batches):
            doc, q, (row, begin, end) = score_rows(buf, off, shared.value)
            names = list(keep)
            cols = [part.column(part.schema.get_field_index(c)) for c in keep]
            names += ["score", "n_sentences"]
            cols += [pa.array(doc), pa.array(np.bincount(row, minlength=len(off) - 1).astype(np.int64))]
            if sentences:
                found: list[list[dict]] = [[] for _ in range(len(off) - 1)]
                for k in np.flatnonzero(q >= 0.5):
                    found[row[k]].append({"text": bytes(buf[begin[k] : end[k]]).decode("utf-8", "replace"), "score": float(q[k]), "begin": int(begin[k] - off[row[k]]), "end": int(end[k] - off[row[k]])})
                names.append("offending")
                cols.append(pa.array(found, kind))
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    schema += ", score double, n_sentences long" + (", offending array<struct<text:string,score:double,begin:bigint,end:bigint>>" if sentences else "")
    return source.mapInArrow(run, schema)


def held_out(remainder: int = 1, modulus: int = 3, column: str = "doc_id") -> Column:
    return (F.crc32(F.col(column).cast("string").cast("binary")) % modulus) == remainder


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(docs, labels, ~held_out()))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences")
