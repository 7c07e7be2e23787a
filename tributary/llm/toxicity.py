"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and
skip-grams; the L1 term leaves few weights, which are broadcast to the scan."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, chunks, drop_stash, held_out, mix, stash, table, texts

#: Labelled documents that the model is fitted on at most, the first by a hash
#: of doc_id; all where there are fewer. About 40 MB of features reach the driver.
SAMPLE = 3_000
#: A feature of fewer training documents is left out.
LEAST_DOCS = 3
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 6.0, 0.1
#: Letters of the stems: inflected and compound words share them.
STEMS = (4, 5, 6)
THRESHOLD = 0.3
#: The bias is the share of toxic labels, this at most: without evidence a text is not toxic.
MOST_PRIOR = 0.15

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Stems(dict):
    """Hashes of a word's first letters; starts afresh when it holds `most` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        letters = word.decode("utf-8", "replace")
        found = self[word] = tuple(xxhash.xxh64_intdigest(letters[:n].encode(), n) for n in STEMS)
        return found


def features(text: bytes, hashes: WordHashes, stems: Stems) -> np.ndarray:
    """Hashes (32 bits) of the words and their stems, the pairs of neighbours and the pairs
    one or two words apart, A-Z in lower case, signs as white space. Not distinct."""
    found = text.translate(_LETTERS).split()
    w = hashes.of(found)
    out = [w, np.fromiter(chain.from_iterable(map(stems.__getitem__, set(found))), np.uint64)]
    for gap in (1, 2, 3):
        if len(w) > gap:
            out.append(mix(w[:-gap] * np.uint64(0x9E3779B97F4A7C15 + 2 * gap) + w[gap:]))
    return (np.concatenate(out) >> np.uint64(32)).astype(np.uint32)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, stems = WordHashes(), Stems()
    for batch in chunks(batches):
        rows = [np.unique(features(t, hashes, stems)).view(np.int32) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], names=["order", "toxic", "found"])


class Ftrl:
    """FTRL-proximal (McMahan et al. 2013): every coordinate has its own rate."""

    def __init__(self, n: int, bias: float = 0.0):
        self.z, self.n, self.bias = np.zeros(n), np.zeros(n), bias

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = _sigmoid(self.bias + w.sum()) - y
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - rate * w
        self.n[at] += g * g


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature hashes in order, weights, bias) from the documents outside the
    held-out fold. The bias is not learned: see MOST_PRIOR. Without labelled documents
    there are no weights."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(sample)
    found = stash(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_sampled, "order long, toxic int, found array<int>").withColumn("row", F.xxhash64("order", "found")), "features")
    # Features that few documents have stay on the executors, however long a text is.
    each = found.select("row", "order", "toxic", F.explode("found").alias("x"))
    common = each.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {LEAST_DOCS}").select("x")
    rows = each.join(common, "x").groupBy("order", "row").agg(F.first("toxic").alias("toxic"), F.sort_array(F.collect_set("x")).alias("found")).orderBy("order", "row").collect()
    positive = found.agg(F.avg("toxic")).first()[0]
    drop_stash(found)
    bias = _logit(min(MOST_PRIOR, max(1e-3, positive))) if positive is not None else _logit(MOST_PRIOR)
    sets = [np.sort(np.array(r.found, np.int32).view(np.uint32)) for r in rows]
    if not sets:
        return np.zeros(0, np.uint32), np.zeros(0), bias
    keys = np.unique(np.concatenate(sets))
    at = [np.searchsorted(keys, s) for s in sets]
    model = Ftrl(len(keys), bias)
    for _ in range(EPOCHS):
        for i, r in zip(at, rows):
            model.learn(i, float(r.toxic))
    w = model.weights(slice(None))
    used = np.flatnonzero(w)
    return keys[used], w[used], bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, score (0 to 1) for every row of docs, over the whole text.

    A null or empty text has no feature: its score is the bias's. Repeated rows
    come out repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, bias = shared.value
        hashes, stems = WordHashes(), Stems()
        for batch in chunks(batches):
            out = []
            for t in texts(batch):
                f = features(t, hashes, stems)
                total = bias
                if len(keys) and len(f):
                    i = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
                    total += weights[np.unique(i[keys[i] == f])].sum()
                out.append(float(_sigmoid(total)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
