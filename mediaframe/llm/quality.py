"""Quality classifier: hashed word and character n-gram vectors, averaged, with a softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import flat, gram_hashes, mix, span_hashes
from .langid import chunks

SIZES = (3, 4, 5)
AGAIN = mix(np.full(1, 0x3D, np.uint64))[0]  # a repeated word


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def word_features(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its character n-grams, ends marked; the word of each."""
    data, starts = flat([b"<" + w + b">" for w in words])
    found = [(span_hashes(data, starts[:-1], starts[1:]), np.arange(len(words)))]
    found += [gram_hashes(data, starts, n) for n in SIZES]
    h, owner = (np.concatenate(x) for x in zip(*found, strict=True))
    return (mix(h) % np.uint64(buckets)).astype(np.int64), owner


def pair_features(words: list[bytes], at: np.ndarray, sizes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of neighbouring words, and the text of each. A word that follows itself is written as
    one mark, so that all repeated words share a learned vector."""
    data, starts = flat(words)
    h = span_hashes(data, starts[:-1], starts[1:])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = owner[1:] == owner[:-1]
    a, b = at[:-1][inside], at[1:][inside]
    pair = np.where(a == b, AGAIN, mix(h[a] * np.uint64(31) + h[b]))
    return (pair % np.uint64(buckets)).astype(np.int64), owner[1:][inside]


def numbered(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words between white space, the word at each place of the texts, words by text."""
    numbers = _Numbers()
    split = [(t or "").encode("utf-8", "replace").split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    at = np.concatenate([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in split]) if split else np.zeros(0, np.int64)
    return list(numbers), at, sizes


@dataclass
class TextClassifier:
    """What the vectors and the softmax come to for two classes: a weight of each bucket and a bias."""

    weight: np.ndarray
    bias: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        words, at, sizes = numbered(texts)
        owner = np.repeat(np.arange(len(texts)), sizes)
        if not words:
            return np.full(len(texts), self.bias)
        buckets, of = word_features(words, len(self.weight))
        sums, n = np.bincount(of, self.weight[buckets], len(words)), np.bincount(of, minlength=len(words))
        total, count = np.bincount(owner, sums[at], len(texts)), np.bincount(owner, n[at], len(texts))
        pairs, of = pair_features(words, at, sizes, len(self.weight))
        total += np.bincount(of, self.weight[pairs], len(texts))
        count += np.bincount(of, minlength=len(texts))
        return total / np.maximum(count, 1) + self.bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -40, 40)))


def train(texts: list[str | None], labels: np.ndarray, buckets: int = 1 << 17, dim: int = 16, steps: int = 12_000, rate: float = 2.0, seed: int = 7) -> TextClassifier:
    """Stochastic gradient descent, a document at a time, with a falling rate; about `steps` steps
    in whole epochs, so that a small sample is seen more often."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    out, bias = np.zeros((dim, 2)), np.zeros(2)
    cases = []
    for text in texts:
        words, at, sizes = numbered([text])
        if words:
            b, of = word_features(words, buckets)
            pairs, _ = pair_features(words, at, sizes, buckets)
            ids, back = np.unique(np.concatenate([b, pairs]), return_inverse=True)
            w = np.bincount(back, np.concatenate([np.bincount(at, minlength=len(words))[of], np.ones(len(pairs))]))
            cases.append((ids, w / w.sum()))
        else:
            cases.append((np.zeros(0, np.int64), np.zeros(0)))
    epochs = max(1, round(steps / max(1, len(cases))))
    steps, done = epochs * len(cases), 0
    for _ in range(epochs):
        for k in rng.permutation(len(cases)):
            ids, w = cases[k]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = w @ vectors[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= 0.1 * lr * p
            if len(ids):
                vectors[ids] -= lr * np.outer(w, back)
    return TextClassifier(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> pd.DataFrame:
    """At most `most` labelled texts, whole, chosen by a hash of the id: a bounded sample, sorted so
    that it does not depend on partitions. Rows without a label or a text are left out."""
    known = labels.select(F.col(id_col).alias("_k"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    n = known.count()
    u = F.pmod(F.xxhash64(F.lit(label), "_k"), F.lit(1 << 30)) / (1 << 30)
    picked = known.withColumn("u", u).filter(F.col("u") < min(2.0, 1.2 * most / max(1, n)))
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    few = rows.join(F.broadcast(picked.orderBy("u").limit(2 * most)), F.col("_id") == F.col("_k"))  # 2 * most keys at most
    return few.select("_id", "text", "label", "u").limit(4 * most).toPandas().drop_duplicates("_id").sort_values(["u", "_id"]).head(most).reset_index(drop=True)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> TextClassifier:
    """Fits on at most `most` labelled rows of docs; without any, all scores are one half."""
    sample = sample_labelled(docs, labels, label, most, id_col, text_col)
    if not len(sample):
        return TextClassifier(np.zeros(2), 0.0)
    return train(sample.text.tolist(), sample.label.to_numpy())


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, score (0 to 1), predicted (1 from the threshold on), one row for each row of docs, by the
    whole text. model: has score(texts); it is broadcast, and of a fixed size.

    Null and empty texts get what the model's bias gives. Ids may repeat or be null; other columns
    are ignored; there is no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, part in chunks(texts, 4_000_000):
                s = shared.value.score(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["_id", "score", "predicted"])

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(slim.dtypes)["_id"]
    return slim.mapInArrow(run, f"_id {kind}, score double, predicted int").withColumnRenamed("_id", id_col)
