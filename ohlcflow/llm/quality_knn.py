"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text's terms are its byte trigrams inside words and its style tokens: word shapes,
words that repeat the word before or an earlier one, and how long and how repetitive
the text is.  Both kinds are hashed, weighted by log count and inverse document
frequency, and a truncated singular value decomposition turns them into a short dense
vector.  The labelled vectors are broadcast (their number is bounded by
``per_class``), and every document's cosine with every labelled vector is computed
exactly, a block of documents at a time.  The neighbours are the labelled vectors
whose cosine is at least the k-th largest, ties included; each votes for its label with
its cosine times its class's inverse sampling rate.

Fitting uses a bounded sample of labelled rows: about ``per_class`` of each label, by a
hash of the id.  Weights, decomposition and vectors come from that sample alone.

Defined results: null and empty texts are scored like any other (their style tokens say
that they are empty); without any positive cosine, or without training rows, the score
is the label's share among the training rows (0.5 if there are none); labels that are
null or not 0 or 1 are ignored; repeated labels each count; repeated rows are scored
one by one and pass through with all their columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ohlcflow.llm.common import small_batches
from ohlcflow.llm.words import SPACED, find_words, mix, text_runs

#: Labelled rows of each class used for fitting (expected number of a sample by id hash).
PER_CLASS = 1500
NEIGHBOURS = 15
TRIGRAM_TERMS, STYLE_TERMS = 2048, 2048
LATENT = 64
#: Share of the trigram terms in a vector's squared length, beside the style terms.
TRIGRAM_SHARE = 0.2

# A byte's shape: lower-case and non-ASCII letters, capitals, digits, else itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x30:0x3A] = ord("0")


def _slot(values: np.ndarray, salt: int, slots: int) -> np.ndarray:
    return (mix(values.astype(np.uint64) + np.uint64(salt << 40)) % np.uint64(slots)).astype(np.int64)


def term_counts(texts: pa.Array) -> np.ndarray:
    """Log counts of hashed terms: one row per text, trigram terms first, then style terms."""
    out = np.zeros((len(texts), TRIGRAM_TERMS + STYLE_TERMS), dtype=np.float32)
    for at, data, offsets in text_runs(texts):
        n = len(offsets) - 1
        w = find_words(data, offsets, SPACED)
        size = w.end - w.start
        total = int(size.sum())
        # positions of all bytes inside words, and the word of each
        word = np.repeat(np.arange(len(size)), size)
        pos = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + w.start[word]
        low = w.data.copy()
        caps = (low >= 0x41) & (low <= 0x5A)
        low[caps] += 32
        before = np.concatenate([[0], low[:-1]]).astype(np.uint32)
        behind = np.concatenate([low[1:], [0]]).astype(np.uint32)
        some = offsets[1:] > offsets[:-1]
        before[offsets[:-1][some]], behind[offsets[1:][some] - 1] = 0, 0  # a text's neighbours are none of its own
        tri = (before[pos] << 16) | (low[pos].astype(np.uint32) << 8) | behind[pos]
        doc = w.doc[word]
        tri_at = np.bincount(doc * TRIGRAM_TERMS + _slot(tri, 1, TRIGRAM_TERMS), minlength=n * TRIGRAM_TERMS)
        # shapes: runs of equal classes count once
        shape = _SHAPE[w.data[pos]]
        change = np.concatenate([[True], (shape[1:] != shape[:-1]) | (word[1:] != word[:-1])])[:total]
        kept, kept_word = shape[change].astype(np.uint64), word[change]
        place = np.arange(len(kept)) - np.searchsorted(kept_word, kept_word)
        code = np.zeros(len(size), dtype=np.uint64)
        np.add.at(code, kept_word, (kept + np.uint64(1)) * (np.uint64(0x100000001B3) ** place.astype(np.uint64)))
        terms, owner = [_slot(code, 2, STYLE_TERMS)], [w.doc]
        same = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        terms.append(np.full(int(same.sum()), 0))
        owner.append(w.doc[1:][same])
        order = np.lexsort((w.hash, w.doc))
        again = (w.hash[order][1:] == w.hash[order][:-1]) & (w.doc[order][1:] == w.doc[order][:-1])
        terms.append(np.full(int(again.sum()), 1))
        owner.append(w.doc[order][1:][again])
        style = np.bincount(np.concatenate(owner) * STYLE_TERMS + np.concatenate(terms),
                            minlength=n * STYLE_TERMS).reshape(n, STYLE_TERMS).astype(np.float32)
        words = np.bincount(w.doc, minlength=n)
        repeats = np.bincount(owner[2], minlength=n)
        rows = np.arange(n)
        style[rows, _slot(np.minimum(np.log2(words + 1), 6).astype(np.int64), 3, STYLE_TERMS)] += 3 + words / 4
        share = (10 * repeats / np.maximum(words, 1)).astype(np.int64)
        style[rows, _slot(share, 4, STYLE_TERMS)] += 3 + words / 4
        out[at:at + n, :TRIGRAM_TERMS] = np.log1p(tri_at.reshape(n, TRIGRAM_TERMS))
        out[at:at + n, TRIGRAM_TERMS:] = np.log1p(style)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """What is broadcast: ``per_class`` bounds its rows, the constants above its columns."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray  # (weight, weight if the label is 1) of each labelled vector
    prior: float
    neighbours: int

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf
        x[:, :TRIGRAM_TERMS] = _unit(x[:, :TRIGRAM_TERMS]) * np.float32(TRIGRAM_SHARE ** 0.5)
        x[:, TRIGRAM_TERMS:] = _unit(x[:, TRIGRAM_TERMS:]) * np.float32((1 - TRIGRAM_SHARE) ** 0.5)
        return x

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        near = _unit(self.weighted(counts) @ self.basis) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, -k][:, None]
        near = np.where((near >= least) & (near > 0), near, 0).astype(np.float64)
        votes = near @ self.votes
        return np.where(votes[:, 0] > 0, votes[:, 1] / np.where(votes[:, 0] > 0, votes[:, 0], 1), self.prior)


def fit_matrix(counts: np.ndarray, labels: np.ndarray, class_weight: dict[int, float], neighbours: int) -> Model:
    n = len(counts)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(1)
    weight = np.array([class_weight[int(y)] for y in labels])
    m = Model(idf, np.zeros((counts.shape[1], 0), np.float32), np.zeros((0, 0), np.float32),
              np.stack([weight, weight * labels], axis=1),
              float((weight * labels).sum() / weight.sum()) if n else 0.5, neighbours)
    if not n:
        return m
    x = m.weighted(counts)
    # truncated decomposition by subspace iteration from a fixed start
    k = min(LATENT, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], k)).astype(np.float32)
    for _ in range(8):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    m.basis = q.astype(np.float32)
    m.vectors = _unit(x @ m.basis)
    return m


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, neighbours: int = NEIGHBOURS) -> Model:
    """Fit on about ``per_class`` rows of each label; ``labels`` has ``doc_id``, ``label``."""
    small_batches(docs.sparkSession)
    lab = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("label").cast("int").alias("label"))
    lab = lab.filter(F.col("label").isin(0, 1) & F.col("_id").isNotNull())
    sizes = {r.label: r["count"] for r in lab.groupBy("label").count().collect()}  # two rows
    if not sizes:
        return fit_matrix(np.zeros((0, TRIGRAM_TERMS + STYLE_TERMS), np.float32), np.zeros(0), {}, neighbours)
    rate = {y: min(1.0, per_class / n) for y, n in sizes.items()}
    u = F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    some = lab.filter(u < F.when(F.col("label") == 1, rate.get(1, 0.0)).otherwise(rate.get(0, 0.0)))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(some), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = term_counts(b.column("text"))
            at = [np.flatnonzero(r) for r in counts]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("label"), pa.array(at, pa.list_(pa.int32())),
                 pa.array([r[i] for r, i in zip(counts, at, strict=True)], pa.list_(pa.float32()))],
                names=["_id", "label", "at", "value"])

    found = rows.select("_id", "label", "text").mapInArrow(
        run, "_id long, label int, at array<int>, value array<float>").toArrow()  # at most about 2 * per_class rows
    order = np.lexsort((found["label"].to_numpy(), found["_id"].to_numpy()))
    counts = np.zeros((len(order), TRIGRAM_TERMS + STYLE_TERMS), dtype=np.float32)
    at, value = found["at"].combine_chunks(), found["value"].combine_chunks()
    for r, i in enumerate(order.tolist()):
        counts[r, at[i].values.to_numpy()] = value[i].values.to_numpy()
    return fit_matrix(counts, found["label"].to_numpy()[order], {y: 1 / p for y, p in rate.items()}, neighbours)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` that do not clash, and ``quality_score`` (0 to 1)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "quality_score"]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("quality_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(term_counts(b.column("text").cast(pa.string()).fill_null("")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())],
                                             names=[*b.schema.names, "quality_score"])

    return docs.select(*kept).mapInArrow(run, schema)
