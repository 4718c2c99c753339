"""A quality classifier on supervised subword embeddings: hashed word and character n-gram vectors, averaged."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import columns_of, text_slices
from countloom.llm.textarrays import mix, word_hashes

_KNOWN = 500_000  # words remembered per worker; it starts anew beyond that
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_features(words: list[str], buckets: int, grams: tuple[int, ...] = (3, 4)) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, number of features of each word): the word itself and the n-grams of ``<word>``.

    The word's own feature ignores the case of A-Z, the n-grams (of UTF-8 bytes) keep it.
    """
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    coded = [b"<" + w.encode() + b">" for w in words]
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    whole, _ = word_hashes(pa.array([" ".join(words)]))
    feature, of = [whole], [np.arange(len(words))]
    for n in grams:
        h = np.zeros(max(0, len(data) - n + 1), np.uint64)
        for k in range(n):
            h = h * _STEP + data[k : k + len(h)]
        fits = np.flatnonzero(np.arange(len(h)) + n <= ends[: len(h)])
        feature.append(mix(h[fits] + np.uint64(n)))
        of.append(owner[fits])
    of_all = np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    return (np.concatenate(feature) % np.uint64(buckets)).astype(np.int64)[order], np.bincount(of_all, minlength=len(words))


class Model:
    """One number per bucket, its vector's pull towards label 1, and a bias. The last entry is for a word that repeats the one before it."""

    def __init__(self, pull: np.ndarray, bias: float):
        self.pull, self.bias = pull, bias
        self._rows: dict[str, int] = {}
        self._values = np.zeros((1 << 16, 2))

    def __getstate__(self):
        return self.pull, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def _learn(self, words: set[str]) -> None:
        if len(self._rows) > _KNOWN:
            self._rows.clear()
        new = [w for w in words if w not in self._rows]
        feature, count = word_features(new, len(self.pull) - 1)
        while len(self._rows) + len(new) > len(self._values):
            self._values = np.concatenate((self._values, np.zeros_like(self._values)))
        if new:
            first = len(self._rows)
            self._values[first : first + len(new), 0] = np.add.reduceat(self.pull[feature], np.concatenate(([0], np.cumsum(count)[:-1])))
            self._values[first : first + len(new), 1] = count
            self._rows.update(zip(new, range(first, first + len(new))))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 of each whole text; a text without words has the bias alone."""
        words = [t.split() for t in texts]
        self._learn(set().union(*words) if words else set())
        out = np.full(len(texts), self.bias)
        for i, ws in enumerate(words):
            if ws:
                rows = np.fromiter(map(self._rows.__getitem__, ws), np.int64, len(ws))
                total, count = self._values[rows].sum(axis=0)
                again = int((rows[1:] == rows[:-1]).sum())
                out[i] += (total + again * self.pull[-1]) / (count + again)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -500, 500)))


def _document_features(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()
    distinct, times = np.unique(np.array(words, object), return_counts=True) if words else (np.empty(0, object), np.empty(0, int))
    feature, count = word_features(list(distinct), buckets)
    weight = np.repeat(times, count).astype(np.float64)
    again = sum(a == b for a, b in zip(words, words[1:]))
    if again:
        feature, weight = np.append(feature, buckets), np.append(weight, again)
    bucket, at = np.unique(feature, return_inverse=True)
    weight = np.bincount(at, weight, len(bucket))
    return bucket, weight / max(weight.sum(), 1.0)


def fit(texts: list[str], labels: list[int], buckets: int = 1 << 16, size: int = 8, rounds: int = 6, rate: float = 1.0, seed: int = 0) -> Model:
    """Stochastic gradient descent on the softmax loss of averaged vectors."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / size, 1.0 / size, (buckets + 1, size))
    out, bias = np.zeros((size, 2)), np.zeros(2)
    docs = [_document_features(t, buckets) for t in texts]
    steps, done = max(1, rounds * len(docs)), 0
    for _ in range(rounds):
        for i in rng.permutation(len(docs)):
            bucket, weight = docs[i]
            hidden = weight @ vectors[bucket]
            logits = hidden @ out + bias
            prob = np.exp(logits - logits.max())
            prob /= prob.sum()
            prob[labels[i]] -= 1.0
            step = rate * (1.0 - done / steps)
            back = out @ prob
            out -= step * np.outer(hidden, prob)
            bias -= step * 0.1 * prob
            vectors[bucket] -= np.outer(step * weight, back)
            done += 1
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, sample: int = 4_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most about ``sample`` labelled rows, those with the smallest hash of their id, in one task.

    Rows without text or label are left out; without any labelled row, and with one label only, the model still scores.
    """
    d = columns_of(docs, id_col, text_col).where(F.col(text_col).isNotNull())
    known = columns_of(labels, id_col, label_col).where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    share = min(1.0, sample / max(1, known.count()))
    few = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) < int(1_000_003 * share) + 1)
    rows = d.join(few, d[id_col] == few["_id"]).select(F.col("_id").alias("id"), F.col(text_col).cast("string").alias("text"), F.col("_label").cast("int").alias("label"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat([pd.DataFrame({"id": [], "text": [], "label": []}), *frames]).sort_values(["id", "text"])
        model = fit(part["text"].tolist(), part["label"].astype(int).tolist())
        yield pd.DataFrame({"model": [pickle.dumps((model.pull, model.bias))]})

    found = rows.repartition(1).mapInPandas(run, "model binary").head()
    return Model(*pickle.loads(found["model"])) if found else fit([], [])


_CURRENT: dict[str, Model] = {}


def score(docs: DataFrame, model: Model, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= ``least``).

    Whole texts are scored; null counts as the empty text, which gets the model's bias. Ids may be null or repeat;
    further columns are ignored; an empty input gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket
    key = uuid.uuid4().hex

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _CURRENT.get(key) or shared.value  # a worker that serves several tasks keeps the words it has met
        _CURRENT.clear()
        _CURRENT[key] = own
        for part in text_slices(batches):
            scores = own.scores([t or "" for t in part.column("text").to_pylist()])
            yield pa.record_batch([part.column("doc_id"), pa.array(scores), pa.array((scores >= least).astype(np.int32))], names=["doc_id", "score", "predicted"])

    d = columns_of(docs, id_col, text_col)
    d = d.select(d[id_col].cast("long").alias("doc_id"), d[text_col].cast("string").alias("text"))
    return d.mapInArrow(predict, "doc_id long, score double, predicted int")
