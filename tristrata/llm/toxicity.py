"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. Texts are cut into overlapping windows of
a few words (long ones, as in scripts without spaces, count by pieces), and every window is compressed twice: with the ordinary dictionary, and with the toxic one put before it. What
ordinary text shares costs the same both times, so the difference of the lengths is what the toxic dictionary explains.
The windows of a document that pass each of several thresholds are counted; a logistic model over the counts, fitted on
labelled documents that no dictionary has seen, calibrates them to a score.

The toxic dictionary is trained on the stretches that are typical of its class: runs of bytes whose q-grams occur in a
least share of the toxic documents of the sample and there ``RATIO`` times as often as in ordinary ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zs
from pyspark.sql import DataFrame, functions as F

from tristrata.llm.common import batch, bounded_batches, bounded_sample, text_or_empty

#: Labelled rows for the fit, about: toxic and ordinary ones. A quarter of each calibrates, the others train.
FIT_TOXIC, FIT_ORDINARY = 2000, 8000
#: Pieces of 200 bytes of ordinary texts from which the ordinary dictionary is trained.
FIT_PIECES = 60_000
#: Texts above this number of bytes take no part in the fit.
FIT_TEXT_BYTES = 1 << 18
WINDOW, STEP = 8, 4
#: Words above this number of bytes (and scripts without spaces) are cut into pieces, each of which counts as a word of a window.
WORD_BYTES, PIECE_BYTES = 24, 12
#: Typical q-grams: their length, the share of toxic texts (and number, at least) that hold them, how much more often.
QGRAM, LEAST_SHARE, LEAST_DOCUMENTS, RATIO = 7, 0.008, 3, 40
ORDINARY_BYTES, TOXIC_BYTES = 32 << 10, 4 << 10
#: Bytes saved from which a window counts.
THRESHOLDS = (3, 4, 5, 6, 8)
_TABLE_BITS = 22

SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _normal(text: str) -> bytes:
    return b" " + b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) + b" "


def windows(text: str) -> list[bytes]:
    """Overlapping runs of words, or of pieces of long ones, that together cover the text; one for a text of up to a run."""
    words = []
    for word in text.encode("utf-8", "surrogatepass").lower().split():
        if len(word) <= WORD_BYTES:
            words.append(b" " + word)
        else:
            words.append(b" " + word[:PIECE_BYTES])
            words += (word[i:i + PIECE_BYTES] for i in range(PIECE_BYTES, len(word), PIECE_BYTES))
    last = max(0, len(words) - WINDOW)
    starts = [*range(0, last, STEP), last]
    return [(b"".join(words[i:i + WINDOW]) or b" ") + b" " for i in starts]


def _qgrams(text: bytes) -> np.ndarray:
    """A table place for each run of ``QGRAM`` bytes."""
    if len(text) < QGRAM:
        return np.empty(0, np.int64)
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(data) - QGRAM + 1
    hashes = np.zeros(n, np.uint64)
    for i in range(QGRAM):
        hashes = hashes * np.uint64(0x100000001B3) + data[i:i + n]
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def _document_counts(texts: list[bytes]) -> np.ndarray:
    counts = np.zeros(1 << _TABLE_BITS, np.int32)
    for text in texts:
        counts[np.unique(_qgrams(text))] += 1
    return counts


def typical_stretches(own: list[bytes], other: list[bytes]) -> list[bytes]:
    """Maximal runs of bytes of ``own`` texts whose q-grams are typical of them."""
    here, there = _document_counts(own), _document_counts(other)
    typical = (here >= max(LEAST_DOCUMENTS, LEAST_SHARE * len(own))) & ((here - 1) / max(1, len(own)) >= RATIO * (there + 0.5) / max(1, len(other)))
    out = []
    for text in own:
        marks = np.zeros(len(text) + 1, np.int8)
        for i in np.flatnonzero(typical[_qgrams(text)]):
            marks[i:i + QGRAM] = 1
        edges = np.flatnonzero(np.diff(marks, prepend=0, append=0))
        out += (text[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return out


def without_near_copies(texts: list[str]) -> list[str]:
    """Texts that share no minimum of three hashes over their runs of four words with an earlier one."""
    seen: set = set()
    out = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
        least = [(seed, min(xxhash.xxh64_intdigest(s, seed) for s in shingles)) for seed in range(3)]
        if not seen.intersection(least):
            out.append(text)
        seen.update(least)
    return out


def _dictionary(samples: list[bytes], size: int, segment: int, run: int) -> bytes:
    try:
        return zs.train_dictionary(size, samples, k=segment, d=run).as_bytes()
    except zs.ZstdError:  # too little text to train on: it serves as it is
        return b"".join(dict.fromkeys(samples))[-size:]


def _compressor(content: bytes) -> zs.ZstdCompressor:
    parameters = zs.ZstdCompressionParameters.from_level(
        7, source_size=64, dict_size=len(content), min_match=3, write_checksum=False, write_content_size=False, write_dict_id=False)
    if len(content) < 8:
        return zs.ZstdCompressor(compression_params=parameters)
    dictionary = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zs.ZstdCompressor(compression_params=parameters, dict_data=dictionary)


@dataclass
class Model:
    """Dictionaries and calibration; ``prior`` is the score where a class has no example."""

    ordinary: bytes = b""
    toxic: bytes = b""
    mean: list[float] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    prior: float = 0.0

    def scorer(self):
        if not self.weights:
            return lambda text: self.prior
        plain, both = _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)
        mean, spread, weights = map(np.array, (self.mean, self.spread, self.weights))

        def score(text: str) -> float:
            z = np.append(1.0, (features(text, plain, both) - mean) / spread)
            return float(1 / (1 + np.exp(-np.clip(z @ weights, -30, 30))))
        return score


def features(text: str, plain: zs.ZstdCompressor, both: zs.ZstdCompressor) -> np.ndarray:
    runs = windows(text)
    saved = np.fromiter(map(len, map(plain.compress, runs)), np.int32, len(runs)) - np.fromiter(map(len, map(both.compress, runs)), np.int32, len(runs))
    passed = np.array([(saved >= t).sum() for t in THRESHOLDS])
    return np.array([saved.mean(), saved.max(), *np.log1p(passed), *(passed / len(runs)), np.log(len(runs))])


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge-penalised logistic regression on standardised columns, by Newton steps."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    ridge = np.diag([1e-6] + [penalty] * x.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
    return mean, spread, w


def evenly(pieces: list[bytes], most: int) -> list[bytes]:
    """``most`` of the pieces by a hash, in their order; all, if there are no more."""
    if len(pieces) <= most:
        return pieces
    chosen = sorted(range(len(pieces)), key=lambda i: (xxhash.xxh64_intdigest(pieces[i], 9), i))[:most]
    return [pieces[i] for i in sorted(chosen)]


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """A model from texts of both classes; ones that are nearly copies of others count once."""
    if not toxic or not ordinary:
        return Model(prior=1.0 if toxic else 0.0)
    toxic, ordinary = without_near_copies(toxic), without_near_copies(ordinary)
    cut_t, cut_o = max(1, len(toxic) * 3 // 4), max(1, len(ordinary) * 3 // 4)
    train_t, train_o = [_normal(t) for t in toxic[:cut_t]], [_normal(t) for t in ordinary[:cut_o]]
    runs = evenly([w for t in train_o for w in (t[i:i + 200] for i in range(0, len(t), 200))], FIT_PIECES)
    model = Model(
        _dictionary(runs, ORDINARY_BYTES, 64, 8),
        _dictionary(typical_stretches(train_t, train_o) or train_t, TOXIC_BYTES, 32, 6))
    plain, both = _compressor(model.ordinary), _compressor(model.toxic + model.ordinary)
    held = [(t, 1.0) for t in toxic[cut_t:] or toxic] + [(t, 0.0) for t in ordinary[cut_o:] or ordinary]
    mean, spread, weights = _logistic(np.array([features(t, plain, both) for t, _ in held]), np.array([y for _, y in held]))
    model.mean, model.spread, model.weights = mean.tolist(), spread.tolist(), weights.tolist()
    return model


def train(docs: DataFrame, labels: DataFrame, learn=None, fit_toxic: int = FIT_TOXIC, fit_ordinary: int = FIT_ORDINARY,
          id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """A model from about ``fit_toxic`` and ``fit_ordinary`` labelled documents, chosen by a hash of the id.

    ``learn`` is a condition on ``doc_id`` that documents to learn from fulfil. Null ids, null labels and labels other
    than 0 and 1 are ignored, as are texts above ``FIT_TEXT_BYTES``; an id labelled both ways counts as toxic, and of several
    texts of one id one is taken. ``FIT_PIECES`` pieces of ordinary texts, taken evenly, make the ordinary dictionary.
    """
    marks = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("y"))
    marks = marks.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    if learn is not None:
        marks = marks.filter(learn)
    chosen = bounded_sample(marks, "y", "doc_id", {1: fit_toxic, 0: fit_ordinary})
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    sample = texts.filter(F.octet_length("text") <= FIT_TEXT_BYTES).join(F.broadcast(chosen), "doc_id")
    # One text for each id, however many rows have it.
    sample = sample.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted(sample.collect(), key=lambda r: (xxhash.xxh64_intdigest(str(r.doc_id)), r.text))
    return fit([r.text for r in rows if r.y == 1], [r.text for r in rows if r.y == 0])


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, score)`` per row of ``docs``, from the whole text; the score is the calibrated chance of label 1.

    Null and empty texts are scored as a text without words. Null and repeated ids stay as they are, one row each.
    Empty tables give empty results. Other columns of ``docs`` are ignored.
    """
    bounded_batches(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for rows in batches:
            yield batch(SCORES, rows.column(0), [of(t) for t in rows.column(1).to_pylist()])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(apply, "doc_id long, score double")
