"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The model is fitted on a bounded sample of labelled documents, one document after another, with a rate of its own for
each coordinate; the L1 term leaves few weights other than zero, which are broadcast (at most DIMENSIONS of them). Words
count as a whole and by their first bytes, so that a word that was never labelled is known by its stem. What the sum of
weights says about the probability is learned from documents that a model hasn't seen: FOLDS further models each leave a
part of the sample out, and a slope and a shift are fitted to the sums of the parts left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import id_text, release, slices, texts_of, unused
from papyra.llm.words import GRAM, hash_spans, joined, mix, word_spans

#: Hashed coordinates, the bias at the end.
DIMENSIONS = 1 << 20
#: Labelled documents that a model is fitted on at most: those whose ids hash lowest.
SAMPLE = 12_000
#: Bytes of the stems of words; parts of the sample that are left out in turn.
STEMS, FOLDS = (4, 6, 8), 3
SLICE = 1 << 20


class Model(NamedTuple):
    """Weights other than zero."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(DIMENSIONS)
        out[self.index] = self.weight
        return out


def features(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Coordinates of the unigrams, bigrams and skip-grams (one word left out) and of the stems at each word, one array a kind, and the number of words of each text. Coordinates of grams that would cross a text's end are -1."""
    data, text_begins = joined(texts, plain=True)
    raw = np.frombuffer(data, np.uint8)
    begins, ends = word_spans(raw)
    words, counts = mix(hash_spans(raw, begins, ends) ^ GRAM), np.diff(np.searchsorted(begins, text_begins))
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))  # words from here to the text's end
    kinds = [(words, 0)]
    for gap in (1, 2):
        pair = np.zeros(len(words), np.uint64)
        pair[: len(words) - gap] = mix(words[: len(words) - gap] * GRAM + words[gap:] + np.uint64(gap)) if len(words) > gap else 0
        kinds.append((pair, gap))
    for size in STEMS:
        kinds.append((mix(hash_spans(raw, begins, np.minimum(ends, begins + size)) * GRAM + np.uint64(100 + size)), 0))
    out = []
    for kind, gap in kinds:
        index = (kind % np.uint64(DIMENSIONS)).astype(np.int64)
        index[left <= gap] = -1
        out.append(index)
    return out, counts


def documents(texts: list[str]) -> Iterator[np.ndarray]:
    """The distinct coordinates of each text; texts are worked on in slices of about SLICE characters."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= SLICE):
            size += len(texts[last])
            last += 1
        kinds, counts = features(texts[first:last])
        ends = np.cumsum(counts)
        for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            found = np.unique(np.concatenate([x[a:b] for x in kinds]))
            yield found[found >= 0].astype(np.int32)
        first = last


def ftrl(texts: list[str], labels: list[int], epochs: int = 8, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0) -> Model:
    """Weights of a logistic regression over the distinct coordinates of each text."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    rows = [np.append(x, np.int32(DIMENSIONS)) for x in documents(texts)]
    penalty = lambda at: np.where(at == DIMENSIONS, 0.0, l1)  # noqa: E731  none on the bias

    def weights(at: np.ndarray) -> np.ndarray:
        zi, p = z[at], penalty(at)
        return np.where(np.abs(zi) <= p, 0.0, -(zi - np.sign(zi) * p) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, label in zip(rows, labels, strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            ni = n[at]
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    w = weights(np.arange(DIMENSIONS + 1))
    index = np.flatnonzero(w[:-1])
    return Model(index, w[index], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    """A model of labels (0 or 1) fitted on at most `sample` labelled documents, those whose ids hash lowest.

    Of several labels of a document the largest counts, of several texts the smallest; null labels and ids are left
    out, null texts count as empty. Without labelled documents every score is one half. Each model reads the sample in
    one task: `sample` bounds it, and the ids to look up are broadcast.
    """
    key = F.col(label_id_col).cast("long")
    chosen = labels.select(key.alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))

    # part -1 fits the model; each other part leaves its documents out and tells the model's sums for them
    parts = F.explode(F.sequence(F.lit(-1), F.lit(FOLDS - 1)))
    copies = rows.select(F.xxhash64("doc_id").alias("place"), "doc_id", "text", "label", parts.alias("part"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        table = table.sort_by([("place", "ascending"), ("doc_id", "ascending")])
        texts, label = table.column("text").to_pylist(), np.clip(table.column("label").to_numpy(), 0, 1)
        out = np.arange(len(texts)) % FOLDS == part
        model = ftrl([x for x, o in zip(texts, out, strict=True) if not o], label[~out].tolist())
        if part < 0:
            index, weight, labels_ = np.append(model.index, DIMENSIONS), np.append(model.weight, model.bias), np.zeros(len(model.index) + 1, np.int64)
        else:
            index, labels_ = np.full(out.sum(), -1), label[out].astype(np.int64)
            dense, left = np.append(model.dense(), 0.0), [x for x, o in zip(texts, out, strict=True) if o]
            weight = np.concatenate([sums(left[a : a + 256], dense, model.bias) for a in range(0, len(left), 256)] or [np.zeros(0)])
        release()
        return pa.table([pa.array(index), pa.array(weight), pa.array(labels_)], ["index", "weight", "label"])

    got = copies.groupBy("part").applyInArrow(run, "index long, weight double, label long").toArrow()
    index, weight, label = (got.column(c).to_numpy() for c in ("index", "weight", "label"))
    left, bias = index < 0, index == DIMENSIONS
    if not bias.any():
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    slope, shift = calibrated(weight[left], label[left])
    own = ~left & ~bias
    order = np.argsort(index[own])
    return Model(index[own][order], slope * weight[own][order], float(slope * weight[bias][0] + shift))


def calibrated(total: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of a logistic curve through the sums of unseen documents, fitted by Newton's method to labels drawn in by one document a class (Platt, 1999); (1, 0) where one class is missing or the slope wouldn't rise."""
    ones = int(label.sum())
    if not 0 < ones < len(label):
        return 1.0, 0.0
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    x = np.stack([np.clip(total, -20, 20), np.ones(len(total))], axis=1)
    at = np.array([1.0, 0.0])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - target @ (x @ w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-9 * np.eye(2), x.T @ (p - target))
        while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def sums(texts: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """The bias and the weights of each text's distinct coordinates; weight: all DIMENSIONS weights, and a 0 for coordinates of -1."""
    total = np.full(len(texts), bias)
    kinds, counts = features(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    hits = []
    for index in kinds:
        at = np.flatnonzero(weight[index])
        hits.append(owner[at] * np.int64(DIMENSIONS) + index[at])
    hits = np.unique(np.concatenate(hits))  # each coordinate once a text
    np.add.at(total, hits // DIMENSIONS, weight[hits % DIMENSIONS])
    return total


def probabilities(texts: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """The model's probability of each text, by sums()."""
    return 1 / (1 + np.exp(-np.clip(sums(texts, weight, bias), -35, 35)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: the model's probability that each text is toxic. One row per input row; null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = np.append(shared.value.dense(), 0.0), shared.value.bias
        for batch in slices(batches, size=SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probabilities(texts_of(batch.column("text")), weight, bias))], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that a model may learn from: crc32 of the id as text, modulo 3, is not 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, whose text scores below the threshold.

    Null and empty texts get the bias alone. Ids don't matter here: rows without one, and repeated rows, stay or go by
    their texts. An empty table gives no rows.
    """
    shared, text = docs.sparkSession.sparkContext.broadcast(model), unused(docs, "papyra_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = np.append(shared.value.dense(), 0.0), shared.value.bias
        for batch in slices(batches, text, SLICE):
            clean = probabilities(texts_of(batch.column(text)), weight, bias) < threshold
            yield batch.drop_columns([text]).filter(pa.array(clean)) if own else batch.filter(pa.array(clean))

    # only a column of another kind, or a twin of it, is sent besides
    own = docs.schema[text_col].dataType.typeName() != "string"
    text = text if own else text_col
    return (docs.withColumn(text, F.col(text_col).cast("string")) if own else docs).mapInArrow(run, docs.schema)
