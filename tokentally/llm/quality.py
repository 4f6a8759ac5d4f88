"""Quality of texts by supervised subword embeddings.

Features of a text are its words (without ASCII case), its words as written, the character
n-grams inside each word, and "the same word again" for each word that repeats the one before it (words of a text
that stutters need not occur in any other), hashed into one table of learned vectors. A text is the average of
the vectors of all its features; a linear layer and a softmax give the class. The table and
the layer are trained by stochastic gradient descent on a bounded, stated number of labelled
texts. Averages are linear, so a trained model scores a text by one number for each feature:
the projection of its vector on the difference of the two classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.llm.common import _BYTE, _PLACE, U64, annotate, blocks, grouped_arange, map_arrow, mix, span_hashes, word_spans

BUCKETS = 1 << 16
# Feature of a word that repeats the one before it.
AGAIN = U64(0x2127599BF4325C37)
DIMENSIONS = 16
GRAMS = (3, 4)
EPOCHS = 6
RATE = 0.3
# Labelled texts that a model is fitted on: the first in the order of a hash of doc_id, one of each id, of at most so many bytes.
SAMPLE, SAMPLE_BYTES = 6000, 1 << 15
# Bytes of text whose features are held at once; a byte has about three of them.
BLOCK = 1 << 20


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of UTF-8 bytes starts, and its hash."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(starts):
        return starts, np.zeros(0, U64)
    place = grouped_arange(np.diff(np.append(starts, len(data))))
    return starts, mix(np.add.reduceat(_BYTE[data[starts[0] :]] * _PLACE[place], starts - starts[0]))


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows one after another, kind by kind, and the row of each."""
    starts, ends, first_word = word_spans(data, offsets)
    shift = U64(64 - (buckets - 1).bit_length())
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first_word))
    words = span_hashes(data, starts, ends, fold=True)
    again = np.flatnonzero((words[1:] == words[:-1]) & (row[1:] == row[:-1])) + 1
    found = [words, span_hashes(data, starts, ends) ^ U64(0x5BD1E995), np.full(len(again), AGAIN)]
    rows = [row, row, row[again]]
    if len(starts):
        at, values = characters(data)
        # Words as ranges of characters; an n-gram lies inside one word.
        first, end = np.searchsorted(at, starts), np.searchsorted(at, ends)
        for n in grams:
            many = np.maximum(end - first - n + 1, 0)
            begin = np.repeat(first, many) + grouped_arange(many)
            total = np.zeros(len(begin), U64)
            for j in range(n):
                total += values[begin + j] * _PLACE[j]
            found.append(mix(total + U64(n)))
            rows.append(np.repeat(row, many))
    return (np.concatenate(found) * U64(0x9E3779B97F4A7C15) >> shift).astype(np.int32), np.concatenate(rows)


def counts(feature: np.ndarray, row: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each row with their counts, by row: (row, feature, count)."""
    both, n = np.unique(row.astype(np.int64) * buckets + feature, return_counts=True)
    return both // buckets, (both % buckets).astype(np.int32), n.astype(np.float32)


@dataclass
class Model:
    """Vectors of features, and weights and biases of the classes 0 and 1."""

    vectors: np.ndarray
    weights: np.ndarray
    biases: np.ndarray

    @property
    def scores(self) -> tuple[np.ndarray, float]:
        """The number of each feature and the constant whose logistic function is the softmax of class 1."""
        return (self.vectors @ (self.weights[1] - self.weights[0])).astype(np.float32), float(self.biases[1] - self.biases[0])


def train(texts: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """Stochastic gradient descent over (features, counts, class); both classes weigh the same in all."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1, 1, (buckets, dimensions)).astype(np.float32) / dimensions, np.zeros((2, dimensions), np.float32), np.zeros(2, np.float32))
    classes = np.array([c for _, _, c in texts])
    share = np.array([max(1, (classes == c).sum()) for c in (0, 1)])
    importance = len(classes) / (2 * share)
    model.weights[:] = rng.normal(0, 0.1, model.weights.shape)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(texts)):
            feature, n, c = texts[i]
            if not len(feature):
                hidden = np.zeros(dimensions, np.float32)
            else:
                part = n / n.sum()
                hidden = part @ model.vectors[feature]
            logits = model.weights @ hidden + model.biases
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[c] -= 1
            p *= importance[c]
            back = p @ model.weights
            model.weights -= step * p[:, None] * hidden[None, :]
            model.biases -= step * 0.1 * p
            if len(feature):
                model.vectors[feature] -= (step * part * 8)[:, None] * back[None, :]
    return model


def sample(documents: DataFrame, labels: DataFrame, size: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", most: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label) of at most ``size`` labelled texts of at most ``most`` bytes, the first by a hash of doc_id.

    Of several texts with one id, one stays, the first by hash. Longer texts are scored like all others, but not learned from.
    """
    known = labels.where(F.col(label_column).isin(0, 1)).groupBy(F.col(id_column).cast("long").alias("doc_id")).agg(F.max(label_column).cast("int").alias("label"))
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).where("doc_id is not null")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    short = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most).join(F.broadcast(chosen), "doc_id")
    return short.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "t.text", "label")


def fit(documents: DataFrame, labels: DataFrame, size: int = SAMPLE, buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS, **names) -> Model:
    """A model from at most ``size`` labelled texts, whose feature counts come to the driver.

    Features are counted by the executors over whole texts, at most SAMPLE_BYTES each. Labels other than 0 and 1 and null
    ids are left out; an id with both labels counts as 1. Without any label all scores are 0.5.
    """

    def run(batch):
        for lo, hi, data, offsets in blocks(batch.column(1), BLOCK):
            row, feature, n = counts(*features(data, offsets, buckets, grams), buckets)
            at = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for v in (feature, n)]
            yield {"doc_id": batch.column(0).slice(lo, hi - lo), "label": batch.column(2).slice(lo, hi - lo), "feature": lists[0], "n": lists[1]}

    rows = map_arrow(sample(documents, labels, size, **names).select("doc_id", "text", "label"), run, "doc_id long, label int, feature array<int>, n array<float>").toArrow()
    order = np.lexsort((rows.column("label").to_numpy(), rows.column("doc_id").to_numpy()))
    feature, n, label = rows.column("feature").combine_chunks(), rows.column("n").combine_chunks(), rows.column("label").to_numpy()
    texts = [(feature[i].values.to_numpy(), n[i].values.to_numpy(), int(label[i])) for i in order.tolist()]
    return train(texts, buckets) if texts else Model(np.zeros((buckets, 1), np.float32), np.zeros((2, 1), np.float32), np.zeros(2, np.float32))


def score(documents: DataFrame, model: Model, text_column: str = "text", into: str = "score", buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """All rows and columns with the probability of class 1 in the column ``into``.

    Null and empty texts get the probability that the biases give. Texts are scored whole.
    """
    values, constant = model.scores

    def run(data, offsets):
        feature, row = features(data, offsets, buckets, grams)
        rows = len(offsets) - 1
        total = np.bincount(row, values[feature], rows)
        n = np.bincount(row, minlength=rows)
        return {into: 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + constant, -500, 500)))}

    return annotate(documents, text_column, run, f"`{into}` double", BLOCK)
