"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors, one for each hashed word and each hashed character n-gram (3 to 5
bytes of a word and the white space at its ends), one for a word that repeats one of the three words before it,
and one that every document has; a softmax over two outputs follows. Vectors and outputs are trained by stochastic gradient descent in numpy, on the driver, over a bounded
sample of labelled rows (`max_rows` rows and `max_bytes` of text at most, those of the smallest hashes of doc_id; whole texts).

After training the model is linear in the mean, so that scoring needs the difference of the two outputs for each
bucket only: one float for each bucket (2**bits * 4 bytes, 1 MB with the default) goes to the executors.

Cases: null and empty texts have the common vector alone, and so a defined score. Rows with a null doc_id are
scored and never learned from. Repeated labels of a document count as the smallest. Without rows of both labels
the score is the share of label 1 (0.5 without any). Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

NS = (3, 4, 5)


def _word_buckets(b: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' starts and buckets; starts of words equal to one of the three before them in the same text. at: the texts' starts."""
    starts, h = C.word_hashes(b)
    text = np.searchsorted(at, starts, "right")
    again = np.zeros(len(starts), bool)
    for k in (1, 2, 3):
        again[k:] |= (h[k:] == h[:-k]) & (text[k:] == text[:-k])
    return starts, (h >> np.uint64(64 - bits)).astype(np.uint32), starts[again]


@dataclass
class Model:
    """table: what a bucket adds to the log odds of label 1 (the last two: a repeated word, the vector of every document)."""

    table: np.ndarray
    bits: int
    constant: float | None = None


def _features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and how often each occurs, the common one included."""
    b, at = C.flat_bytes(pa.array([text or ""]))
    found = [x[ok] for _, x, ok in C.ngrams(b, NS, bits)]
    _, x, again = _word_buckets(b, at, bits)
    ids, n = np.unique(np.concatenate([*found, x, np.full(len(again), 1 << bits), np.array([(1 << bits) + 1])]).astype(np.int64), return_counts=True)
    return ids, n


def train(rows: list[tuple[str, int]], bits: int = 18, dim: int = 16, epochs: int = 5, rate: float = 0.5, batch: int = 16, seed: int = 7) -> Model:
    """rows: text and label, 0 or 1. Batches are drawn by a seeded generator: the same rows give the same model."""
    ys = np.array([y for _, y in rows], np.int64)
    if len(set(ys.tolist())) < 2:
        share = float(ys.mean()) if len(ys) else 0.5
        return Model(np.zeros((1 << bits) + 2, np.float32), bits, share)
    docs = [_features(t, bits) for t, _ in rows]
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / dim, 1 / dim, ((1 << bits) + 2, dim)).astype(np.float32)
    outputs = np.zeros((2, dim), np.float32)
    outputs[:] = draw.uniform(-0.1, 0.1, outputs.shape)
    steps, done = epochs * -(-len(docs) // batch), 0
    for _ in range(epochs):
        order = draw.permutation(len(docs))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            lens = np.array([len(docs[i][0]) for i in some])
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            ids = np.concatenate([docs[i][0] for i in some])
            share = np.concatenate([docs[i][1] / docs[i][1].sum() for i in some]).astype(np.float32)
            mean = np.add.reduceat(vectors[ids] * share[:, None], starts, axis=0)
            z = mean @ outputs.T
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), ys[some]] -= 1
            lr = np.float32(rate * (1 - done / steps))
            back = p @ outputs
            outputs -= lr * (p.T @ mean)
            # a feature's step is its share of the document, scaled so that frequent ones move by about the rate
            step = np.repeat(back, lens, axis=0) * (np.sqrt(share) * lr)[:, None]
            by = np.argsort(ids, kind="stable")
            uniq, first = np.unique(ids[by], return_index=True)
            vectors[uniq] -= np.add.reduceat(step[by], first, axis=0)
            done += 1
    return Model((vectors @ (outputs[1] - outputs[0])).astype(np.float32), bits)


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability of label 1 for each text."""
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    out = np.zeros(len(texts))
    common = float(model.table[-1])
    for first, end in C.slices(texts):
        b, at = C.flat_bytes(texts.slice(first, end - first))
        total, count = np.zeros(len(b), np.float32), np.zeros(len(b), np.int32)
        for _, x, ok in C.ngrams(b, NS, model.bits):
            total[: len(x)] += model.table[x] * ok
            count[: len(x)] += ok
        starts, x, again = _word_buckets(b, at, model.bits)
        total[starts] += model.table[x]
        count[starts] += 1
        total[again] += model.table[-2]
        count[again] += 1
        sums, ns = np.add.reduceat(total, at, dtype=np.float64), np.add.reduceat(count, at, dtype=np.int64)
        out[first:end] = (sums + common) / (ns + 1)
    return 1 / (1 + np.exp(-out))


def held_out(doc_id):
    """Whether a row is kept from training: crc32 of doc_id as text has remainder 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 4000, max_bytes: int = 256 << 20, **how) -> Model:
    """Train on the labelled rows outside the held-out fold whose doc_id hashes lowest: `max_rows` of them, or as many as fit `max_bytes`."""
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    texts = documents.select("doc_id", "text")
    # at most max_rows rows of two numbers: a bounded side to broadcast; of rows with one doc_id one text counts
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = C.written(rows.withColumn("size", F.octet_length("text").cast("long")), "quality-sample")
    by = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # max_rows rows
    fits = rows.select("doc_id", F.sum("size").over(by).alias("sum")).where(F.col("sum") <= max_bytes).select("doc_id")
    rows = rows.join(F.broadcast(fits), "doc_id", "left_semi").collect()
    return train([(r.text, r.label) for r in sorted(rows, key=lambda r: r.doc_id)], **how)


def score(documents: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of documents; only doc_id and text are read."""
    spark = documents.sparkSession
    C.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p = score_texts(batch.column(1), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
