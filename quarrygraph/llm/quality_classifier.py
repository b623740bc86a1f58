"""Quality classifier: hashed word and character n-gram embeddings, averaged per document, with a softmax output.

Trained by numpy stochastic gradient descent on at most TRAIN_DOCS labelled documents, chosen by a
hash of doc_id. As averaging and the output layer are linear, a trained model is one number for
each bucket: a document's score needs a look-up per word, and words repeat.

Defined cases: a null or empty text has no features and gets the model's bias as its score;
labels of ids without a document, null labels and null ids are not learned from; repeated rows
score alike; without labels of both kinds every score is the share of label 1, or 0.5 without
any; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, small_batches

BUCKETS = 1 << 15
DIM = 8
TRAIN_DOCS = 3_000
EPOCHS = 8
PREDICT_AT = 0.7
#: Words remembered by a task; beyond, it starts anew.
CACHE = 400_000


def remainder(mod: int) -> Column:
    """crc32(doc_id as text) mod `mod`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def grams(word: str) -> list[int]:
    """Buckets of the word itself and of its three-character parts, ends marked."""
    b = f"<{word}>".encode("utf-8", "surrogatepass")
    out = [zlib.crc32(b) & (BUCKETS - 1)]
    return out + [zlib.crc32(b[i : i + 3], 7) & (BUCKETS - 1) for i in range(len(b) - 2)]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the whole text and their shares; at most BUCKETS of them, however long the text."""
    found: Counter = Counter()
    for word, n in Counter(text.lower().split()).items():
        for g in grams(word):
            found[g] += n
    ids, n = np.fromiter(found.keys(), np.int32, len(found)), np.fromiter(found.values(), np.float64, len(found))
    return ids, (n / max(n.sum(), 1)).astype(np.float32)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rate: float = 0.4, seed: int = 3) -> tuple[np.ndarray, float]:
    """(margin of label 1 over label 0 by bucket, bias)."""
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
        return np.zeros(BUCKETS), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(bags), 0
    scale = 30.0  # averages of many vectors are short
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            h = scale * (share @ emb[ids]) if len(ids) else np.zeros(DIM, np.float32)
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            lr = rate * (1 - step / steps)
            step += 1
            if len(ids):
                emb[ids] -= (lr * scale * 0.1) * share[:, None] * (out @ p)[None, :]
            out -= lr * 0.1 * np.outer(h, p)
            bias -= lr * 0.1 * p
    return scale * (emb @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0])


class Words(dict):
    """word -> complex(sum of its buckets' margins, number of buckets), filled on demand."""

    def __init__(self, margins: list[float]):
        super().__init__()
        self.margins = margins

    def __missing__(self, word: str) -> complex:
        g = grams(word)
        out = complex(sum(map(self.margins.__getitem__, g)), len(g))
        if len(word) <= 40:
            if len(self) >= CACHE:
                self.clear()
            self[word] = out
        return out


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(quality, ids, shares) of the sample: the TRAIN_DOCS labelled ids outside the held-out part with the smallest hashes."""
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (remainder(4) != 2)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([a.tobytes() for a, _ in bags], pa.binary()), pa.array([b.tobytes() for _, b in bags], pa.binary())], ["doc_id", "quality", "ids", "shares"])

    return docs.select("doc_id", "text").join(F.broadcast(chosen.withColumn("quality", F.col("quality").cast("int"))), "doc_id").select("doc_id", "quality", "text").mapInArrow(run, "doc_id bigint, quality int, ids binary, shares binary")


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    rows = sorted(training_sample(docs, labels).toLocalIterator(), key=lambda r: (r["doc_id"], r["ids"]))
    bags = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows]
    return fit(bags, np.array([r["quality"] for r in rows], np.int64))


def score(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and the probability of label 1, for every row of docs (doc_id, text)."""
    small_batches(spark)
    margins, bias = model

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(margins.tolist())
        for whole in batches:
            for batch in slices(whole):
                sums = np.array([sum(map(words.__getitem__, (t or "").lower().split()), 0j) for t in batch.column("text").to_pylist()])
                z = bias + sums.real / np.maximum(sums.imag, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(spark, docs, model).select(
        "doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted")
    )
