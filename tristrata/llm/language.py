"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else separates words. Runs of one to three characters, spaces included, are hashed
to ``DIMENSIONS`` places and weighted by ``log(1 + count)`` times inverse document frequency, normalised to length one.
Document frequencies come from all documents that may be learned from. The weights are trained by follow-the-
regularised-leader (FTRL-proximal) with L1 and L2 penalties, so most of them are zero; a temperature fitted on
documents apart from the training ones calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tristrata.llm.common import batch, bounded_batches, bounded_sample, text_or_empty

DIMENSIONS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled rows for the fit, about, for each language; a quarter of them calibrates, the others train.
FIT_PER_LANGUAGE = 1000
#: Labelled rows for the fit of all languages together; with more languages than this allows, each gets fewer rows.
FIT_ROWS = 200_000
#: Texts above this number of bytes take no part in the fit of the weights.
FIT_TEXT_BYTES = 1 << 18
UNDETERMINED = "und"

COUNTS = pa.schema([("chunk", pa.int32()), ("documents", pa.int64()), ("counts", pa.binary())])
CHUNK = 1024
GUESSES = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


class _Letters(dict):
    """Code points for str.translate: letters stay, others become spaces."""

    def __missing__(self, point: int) -> int:
        self[point] = value = point if chr(point).isalpha() else 32
        return value


_LETTERS = _Letters()


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams of a text and how often each occurs; none for a text without letters."""
    words = text.lower().translate(_LETTERS).split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    places = []
    rolled = np.zeros(len(points), np.uint64)
    for order in ORDERS:
        n = len(points) - order + 1
        rolled = rolled[:n] * np.uint64(0x100000001B3) + points[order - 1:] + np.uint64(order)
        places.append((rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))
    places = np.concatenate(places).astype(np.int64)
    if len(places) < 4096:
        return np.unique(places, return_counts=True)
    counts = np.bincount(places, minlength=DIMENSIONS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _vector(places: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.log1p(counts) * idf[places]
    return weights / max(1e-12, float(np.sqrt(weights @ weights)))


def document_frequencies(docs: DataFrame, text_column: str = "text") -> tuple[int, np.ndarray]:
    """The number of documents with letters, and in how many of them each place occurs. Sums are made in chunks."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, "<i8"), 0
        for rows in batches:
            for text in rows.column(0).to_pylist():
                places, _ = ngram_counts(text)
                total[places] += 1
                n += bool(len(places))
        if n:
            chunks = range(DIMENSIONS // CHUNK)
            yield batch(COUNTS, list(chunks), [n] * len(chunks), [total[c * CHUNK:(c + 1) * CHUNK].tobytes() for c in chunks])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total, n = None, np.zeros(CHUNK, "<i8"), 0
        for rows in batches:
            for c, m, counts in zip(*(x.to_pylist() for x in rows.columns)):
                if c != chunk:
                    if chunk is not None:
                        yield batch(COUNTS, [chunk], [n], [total.tobytes()])
                    chunk, total, n = c, np.zeros(CHUNK, "<i8"), 0
                total += np.frombuffer(counts, "<i8")
                n += m
        if chunk is not None:
            yield batch(COUNTS, [chunk], [n], [total.tobytes()])

    schema = "chunk int, documents long, counts binary"
    partial = docs.select(text_or_empty(text_column).alias("text")).mapInArrow(count, schema)
    summed = partial.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, schema).collect()  # DIMENSIONS numbers
    frequencies = np.zeros(DIMENSIONS, np.int64)
    for row in summed:
        frequencies[row.chunk * CHUNK:(row.chunk + 1) * CHUNK] = np.frombuffer(row.counts, "<i8")
    return max((r.documents for r in summed), default=0), frequencies


@dataclass
class Model:
    """Languages, inverse document frequencies, sparse weights (places, values, start of each language) and temperature."""

    languages: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS, np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMENSIONS), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0

    def guess(self, text: str) -> tuple[str, float]:
        places, counts = ngram_counts(text)
        if not len(places) or not self.languages:
            return UNDETERMINED, 0.0
        p = _softmax((self.weights[:, places] @ _vector(places, counts, self.idf) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0,
         l1: float = 0.05, l2: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by FTRL-proximal with an elastic net; biases are not penalised."""
    z, n = np.zeros((classes, DIMENSIONS + 1)), np.zeros((classes, DIMENSIONS + 1))
    first, second = np.full(DIMENSIONS + 1, l1), np.full(DIMENSIONS + 1, l2)
    first[-1] = second[-1] = 0.0

    def weights(at) -> np.ndarray:
        zs = z[:, at]
        w = -(zs - np.sign(zs) * first[at]) / ((beta + np.sqrt(n[:, at])) / alpha + second[at])
        return np.where(np.abs(zs) <= first[at], 0.0, w)

    for _ in range(epochs):
        for places, values, label in examples:
            at, x = np.append(places, DIMENSIONS), np.append(values, 1.0)
            w = weights(at)
            error = _softmax(w @ x)
            error[label] -= 1
            gradient = np.outer(error, x)
            square = gradient * gradient
            z[:, at] += gradient - (np.sqrt(n[:, at] + square) - np.sqrt(n[:, at])) / alpha * w
            n[:, at] += square
    w = weights(np.arange(DIMENSIONS + 1))
    return w[:, :-1].astype(np.float32), w[:, -1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of logits with the least log loss, by golden-section search over its logarithm."""
    def loss(t: float) -> float:
        return float(-np.log(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, learn=None, per_language: int = FIT_PER_LANGUAGE, id_column: str = "doc_id", text_column: str = "text",
          language_column: str = "lang") -> Model:
    """A model from the documents with a language, those that fulfil ``learn`` (a condition on ``doc_id``).

    All of them count for document frequencies; about ``per_language`` of each language (``FIT_ROWS`` in all), chosen by a
    hash of id and text, fit weights and temperature. Every language is learned; rows that repeat count once, and texts
    without letters teach nothing.
    """
    bounded_batches(docs.sparkSession)
    known = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"), F.col(language_column).cast("string").alias("lang")
    ).filter("lang is not null")
    if learn is not None:
        known = known.filter(learn)
    documents, frequencies = document_frequencies(known)
    if not documents:
        return Model()
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())  # the classes of the model
    each = max(1, min(per_language, FIT_ROWS // len(languages)))
    idf = (np.log((1 + documents) / (1 + frequencies)) + 1).astype(np.float32)
    short = known.filter(F.octet_length("text") <= FIT_TEXT_BYTES).withColumn("key", F.concat_ws(" ", F.col("doc_id").cast("string"), F.md5("text")))
    rows = bounded_sample(short.select("key", "text", "lang"), "lang", "key", each).collect()
    number = {name: i for i, name in enumerate(languages)}
    examples = []
    for row in sorted(rows, key=lambda r: xxhash.xxh64_intdigest(r.key)):
        places, counts = ngram_counts(row.text)
        if len(places):
            examples.append((places, _vector(places, counts, idf), number[row.lang]))
    if not examples:
        return Model()
    cut = max(1, len(examples) * 3 // 4)
    weights, bias = ftrl(examples[:cut], len(languages))
    apart = examples[cut:] or examples
    logits = np.array([weights[:, places] @ values + bias for places, values, _ in apart])
    return Model(languages, idf, weights, bias, fit_temperature(logits, np.array([label for *_, label in apart])))


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row of ``docs``, from the whole text.

    ``score`` is the calibrated probability of the language. Texts that are null or without letters are ``und`` with
    score 0, and so is everything if the model has no language. Null and repeated ids stay, one row each. Empty tables
    give empty results. Other columns of ``docs`` are ignored.
    """
    bounded_batches(docs.sparkSession)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield batch(GUESSES, rows.column(0), *zip(*(model.guess(t) for t in rows.column(1).to_pylist()))) if rows.num_rows else batch(GUESSES, [], [], [])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(guess, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is determined with at least ``least_score``."""
    bounded_batches(docs.sparkSession)
    at, names = docs.columns.index(text_column), docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = (model.guess(t or "") for t in rows.column(at).to_pylist())
            yield rows.filter(pa.array([name != UNDETERMINED and score >= least_score for name, score in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema).select(*names)
