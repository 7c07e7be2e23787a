"""Language identification: a convolutional network over bytes, trained in numpy,
applied to every fixed-length window of every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, held_out, table, texts

#: Bytes of a window; the last one of a text is filled with spaces.
WINDOW = 256
#: Training documents at most, the first by a hash of doc_id, and windows from
#: each, at offsets spread over the whole text: 4 MB reach the driver at most.
SAMPLE, SAMPLE_WINDOWS = 4_000, 3
#: A window as long as this is used for training in place of a whole one.
TRAIN_BYTES = 128
EMBEDDING, WIDTHS, FILTERS = 8, (2, 3, 4), 16
EPOCHS, BATCH, RATE = 4, 64, 0.004
#: A small sample is gone through more often, up to so many steps.
LEAST_STEPS = 700
#: Windows that are scored at once.
BLOCK = 512


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        order, langs, rows = [], [], []
        for o, lang, text in zip(batch.column("order").to_pylist(), batch.column("lang").to_pylist(), texts(batch)):
            for k in range(SAMPLE_WINDOWS if text else 0):
                room = max(1, len(text) - TRAIN_BYTES + 1)
                at = xxhash.xxh64_intdigest(f"{o}:{k}") % room
                order.append(o)
                langs.append(lang)
                rows.append(text[at : at + TRAIN_BYTES].ljust(TRAIN_BYTES))
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(langs, pa.string()), pa.array(rows, pa.binary())], names=["order", "lang", "bytes"])


class ByteNet:
    """Embedding, filters of several widths, ReLU, maximum over the window, softmax."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["o"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.p["c"] = np.zeros(len(classes), np.float32)

    def _step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy of a batch of windows."""
        p, n = self.p, len(x)
        e = p["e"][x]
        kept, pooled = [], []
        for w in WIDTHS:
            m = x.shape[1] - w + 1
            cols = np.concatenate([e[:, k : k + m] for k in range(w)], axis=2)
            pre = cols @ p[f"w{w}"] + p[f"b{w}"]
            best = pre.argmax(1)
            kept.append((cols, best))
            pooled.append(np.take_along_axis(pre, best[:, None], 1)[:, 0])
        h = np.concatenate(pooled, 1)
        act = np.maximum(h, 0)
        out = act @ p["o"] + p["c"]
        prob = np.exp(out - out.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(n), y] -= 1
        d = prob / n
        g = {"o": act.T @ d, "c": d.sum(0), "e": np.zeros_like(p["e"])}
        dh = (d @ p["o"].T) * (h > 0)
        rows = np.arange(n)[:, None]
        for j, w in enumerate(WIDTHS):
            cols, best = kept[j]
            dj = dh[:, j * FILTERS : (j + 1) * FILTERS]
            picked = cols[rows, best]  # window, filter, embedding of the bytes that won
            g[f"w{w}"] = np.einsum("nfc,nf->cf", picked, dj)
            g[f"b{w}"] = dj.sum(0)
            dcols = dj[:, :, None] * p[f"w{w}"].T[None]
            for k in range(w):
                np.add.at(g["e"], x[rows, best + k].ravel(), dcols[:, :, k * EMBEDDING : (k + 1) * EMBEDDING].reshape(-1, EMBEDDING))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> ByteNet:
        """Adam; the rate falls to a tenth over the epochs."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        once = -(-len(x) // BATCH)
        epochs = max(EPOCHS, -(-LEAST_STEPS // once))
        t, steps = 0, epochs * once
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                at = order[i : i + BATCH]
                t += 1
                rate = RATE * 0.1 ** (t / steps)
                for k, g in self._step(x[at], y[at]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        """Embedding and filters in one: what each pair of bytes adds to each
        filter, so that a window is scored by look-ups alone."""
        out = []
        for w in WIDTHS:
            one = [self.p["e"] @ self.p[f"w{w}"][k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(w)]
            one[0] = one[0] + self.p[f"b{w}"]
            pairs = [(one[k][:, None] + one[k + 1][None]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            out.append((*pairs, one[-1]) if w % 2 else tuple(pairs))
        return out

    def log_prob(self, x: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        pair = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
        pooled = []
        for w, parts in zip(WIDTHS, tables):
            m = x.shape[1] - w + 1
            pre = np.take(parts[0], pair[:, :m], 0)
            for k, part in enumerate(parts[1:], 1):
                pre += np.take(part, x[:, 2 * k : 2 * k + m] if len(part) == 256 else pair[:, 2 * k : 2 * k + m], 0)
            pooled.append(pre.max(1))
        out = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["o"] + self.p["c"]
        out -= out.max(1, keepdims=True)
        return out - np.log(np.exp(out).sum(1, keepdims=True))


def fit(docs: DataFrame, sample: int = SAMPLE) -> ByteNet | None:
    """A network for the languages of docs (doc_id, text, lang) outside the
    held-out fold; None where no row has both a text and a language."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    # The ids alone are ordered; the texts stay where they are.
    chosen = known.select("doc_id").distinct().withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(sample)
    rows = (
        known.select("doc_id", "lang", "text")
        .join(F.broadcast(chosen), "doc_id")
        .mapInArrow(_sampled, "order long, lang string, bytes binary")
        .collect()
    )
    if not rows:
        return None
    rows.sort(key=lambda r: (r.order, r.lang, bytes(r.bytes)))
    classes = sorted({r.lang for r in rows})
    x = np.frombuffer(b"".join(bytes(r.bytes) for r in rows), np.uint8).reshape(len(rows), TRAIN_BYTES)
    y = np.array([classes.index(r.lang) for r in rows])
    return ByteNet(classes).fit(x, y)


def _windows(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, and whose each is."""
    counts = [max(1, -(-len(t) // WINDOW)) for t in texts_]
    filled = b"".join(t.ljust(n * WINDOW) for t, n in zip(texts_, counts))
    return np.frombuffer(filled, np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(texts_)), counts)


def identify(docs: DataFrame, model: ByteNet | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs, over the whole text.

    The windows' log-probabilities are averaged; score is the probability of the
    language that wins (ties: the first by name). A null text, one without a
    letter, and any text where there is no model: `und`, score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net else None
        for batch in chunks(batches):
            found = texts(batch)
            letters = np.array(batch.column("letters").to_pylist(), bool)
            langs, scores = ["und"] * len(found), np.zeros(len(found))
            if net:
                x, whose = _windows(found)
                logs = np.concatenate([net.log_prob(x[i : i + BLOCK], tables) for i in range(0, len(x), BLOCK)])
                total = np.zeros((len(found), len(net.classes)))
                np.add.at(total, whose, logs)
                total /= np.bincount(whose, minlength=len(found))[:, None]
                prob = np.exp(total - total.max(1, keepdims=True))
                prob /= prob.sum(1, keepdims=True)
                best = prob.argmax(1)
                langs = [net.classes[b] if ok else "und" for b, ok in zip(best, letters)]
                scores = np.where(letters, prob[np.arange(len(found)), best], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(scored, "doc_id long, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
