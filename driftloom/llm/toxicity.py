"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm import shingles
from driftloom.llm.common import text_of

#: Hashed features: each word and its beginnings of so many bytes.
FEATURE_BITS = 20
PREFIXES = (5, 6, 7)
#: The training sample holds at most so many labelled documents, a third of them toxic, those first by a hash of their id,
TRAIN_DOCS = 3_600
#: and whole documents only: they are taken in that order while their texts' bytes, a third of them of toxic ones, fit in this.
TRAIN_BYTES = 24 << 20
STEPS = 200
RATE = 0.05
DECAY = 1e-4
#: Parts of the sample that are scored by models of the others, for the calibration.
FOLDS = 3
#: The calibration shifts log odds by no more than this.
MAX_SHIFT = 3.0
#: A feature needs so many documents of the sample.
MIN_DOCS = 4
#: A toxic document counts so many times in the loss.
TOXIC_WEIGHT = 1.0
START_BIAS = -5.0

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = False


@dataclass(frozen=True)
class Model:
    """Weights of the hashed words, the bias of a sentence, and what is added to the log odds of a noisy-or to make them a document's."""

    weights: np.ndarray
    bias: float
    shift: float = 0.0

    def calibrated(self, p: np.ndarray) -> np.ndarray:
        """Scores of noisy-ors; 0 stays 0."""
        own = np.clip(p, 1e-12, 1 - 1e-12)
        return np.where(p > 0, 1 / (1 + np.exp(-(np.log(own) - np.log1p(-own) + self.shift))), 0.0)


def sentence_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the features of each word, a row of 1 + len(PREFIXES); its sentence; the text of each sentence). Sentences end at . ! ? or a line's end and hold at least one word."""
    joined = np.frombuffer(b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
    starts, *hashes = shingles.runs(joined, _OUTSIDE, PREFIXES)
    ends = np.cumsum([len(t) + 1 for t in texts])
    raw = np.cumsum(_ENDS[joined])[starts]
    new = np.concatenate([[True], raw[1:] != raw[:-1]]) if len(raw) else np.zeros(0, bool)
    sentence = np.cumsum(new) - 1
    text = np.searchsorted(ends, starts[new], side="right")
    return (np.stack(hashes, axis=1) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32), sentence, text


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def sentence_logits(model: Model, features: np.ndarray, sentence: np.ndarray, sentences: int) -> np.ndarray:
    return model.bias + np.bincount(sentence, model.weights[features].sum(axis=1), sentences)


def noisy_or(logits: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """1 - product of (1 - p) over each text's sentences; 0 for a text without any."""
    return -np.expm1(-np.bincount(text, _softplus(logits), texts))


def fit(labels: np.ndarray, features: np.ndarray, sentence: np.ndarray, text: np.ndarray, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, min_docs: int = MIN_DOCS, weight: float = TOXIC_WEIGHT) -> Model:
    """Fit by Adam on the whole sample: the log loss of the documents' noisy-or, with a penalty on the squared weights.

    Only features that stand in at least min_docs documents get a weight. They start from the log odds of their documents'
    labels where those are clearly positive, so that the search begins at the sentences that set the toxic documents apart.
    """
    n, size = len(labels), 1 << FEATURE_BITS
    flat, where = features.ravel(), np.repeat(sentence.astype(np.int32), features.shape[1])
    seen, toxic = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for doc, own in enumerate(np.split(features, np.searchsorted(text[sentence], np.arange(1, n)))):
        own = np.unique(own)
        seen[own] += 1
        toxic[own] += labels[doc]
    base = max(labels.mean(), 1e-6)
    odds = np.log((toxic + 2 * base) / (seen - toxic + 2 * (1 - base))) - np.log(base / (1 - base))
    known = np.flatnonzero(seen >= min_docs)
    place = np.full(size, -1, np.int32)
    place[known] = np.arange(len(known))
    flat = place[flat]
    flat, where = flat[flat >= 0], where[flat >= 0]

    theta, m, v = np.append(np.where(odds[known] > 1.5, odds[known] / 2, 0), START_BIAS), np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(where, theta[flat], len(text))
        whole = np.clip(noisy_or(z, text, n), 1e-6, 1 - 1e-12)
        pull = np.where(labels == 1, -weight * (1 - whole) / whole, 1.0)[text] * np.exp(-_softplus(-z)) / n
        grad = np.append(np.bincount(flat, pull[where], len(known)) + decay * theta[:-1], pull.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[known] = theta[:-1]
    return Model(weights, float(theta[-1]))


def calibrate(model: Model, labels: np.ndarray, features: np.ndarray, sentence: np.ndarray, text: np.ndarray, folds: int = FOLDS, **options) -> Model:
    """The model with the shift that suits documents it was not fitted on: the sample is cut into folds, each is scored by a model of the others, and
    the shift of the log odds of those scores is the likeliest for the labels."""
    n = len(labels)
    fold, apart = np.arange(n) % folds, np.zeros(n)
    order = np.argsort(labels, kind="stable")  # folds hold equal shares of both labels
    fold[order] = np.arange(n) % folds
    owner = text[sentence]
    for f in range(folds):
        for own, learn in ((fold != f, True), (fold == f, False)):
            docs, rows, lines = np.flatnonzero(own), own[owner], own[text]
            place, line = np.cumsum(own) - 1, np.cumsum(lines) - 1
            part = features[rows], line[sentence[rows]], place[text[lines]]
            if learn:
                part_model = fit(labels[docs], *part, **options)
            else:
                apart[docs] = noisy_or(sentence_logits(part_model, part[0], part[1], len(part[2])), part[2], len(docs))
    own = np.clip(apart, 1e-9, 1 - 1e-9)
    x, shift = np.log(own) - np.log1p(-own), 0.0
    for _ in range(50):  # Newton's steps, held back by a weak prior
        p = 1 / (1 + np.exp(-np.clip(x + shift, -30, 30)))
        shift = float(np.clip(shift + ((labels - p).sum() - 0.1 * shift) / ((p * (1 - p)).sum() + 0.1), -MAX_SHIFT, MAX_SHIFT))
    return Model(model.weights, model.bias, shift)


def _features(docs: DataFrame) -> DataFrame:
    """(label, features, sentence): the words of each document with the number of their sentence."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"label": batch.column(1).to_pylist(), "features": [], "sentence": []}
            for text in batch.column(0).to_pylist():
                f, s, _ = sentence_words([text.encode()])
                rows["features"].append(f.ravel())
                rows["sentence"].append(s)
            yield pa.RecordBatch.from_arrays([pa.array(rows["label"], pa.int32()), pa.array(rows["features"], pa.list_(pa.int32())), pa.array(rows["sentence"], pa.list_(pa.int64()))], names=list(rows))

    return docs.select("text", "label").mapInArrow(extract, "label int, features array<int>, sentence array<long>")


def _within(sizes: list, limit: int) -> list[tuple]:
    """(id, label) of the rows (id, label, n), in order, that fit in a third of the limit if toxic and in the rest if not."""
    left, out = {1: limit // 3, 0: limit - limit // 3}, []
    for row in sizes:
        if row["n"] <= left[row["label"]]:
            left[row["label"]] -= row["n"]
            out.append((row["id"], row["label"]))
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on at most train_docs labelled documents of together at most train_bytes; null ids and labels are left out, and without any document of both labels the model scores 0.

    The sample is chosen among the labels, then by the lengths of its texts, so that only ids of a fixed number are broadcast and only
    the words of so many bytes reach the driver. Texts are taken whole: one that no longer fits is passed over for the next.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    first = lambda label, n: chosen.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = first(1, train_docs // 3).unionByName(first(0, train_docs - train_docs // 3))
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    sizes = texts.select("id", F.octet_length("text").alias("n")).join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.sum("n").alias("n"))
    ids = _within(sizes.orderBy(F.xxhash64("id"), "id", "label").collect(), train_bytes)
    rows = texts.join(F.broadcast(docs.sparkSession.createDataFrame(ids, sizes.select("id", "label").schema)), "id")
    table = _features(rows).toArrow()
    y = table["label"].to_numpy()
    if len(np.unique(y)) < 2:
        return Model(np.zeros(1 << FEATURE_BITS, np.float32), -1e9)
    features, sentence, text, base = [], [], [], 0
    for i, (f, s) in enumerate(zip(table["features"], table["sentence"], strict=True)):
        f, s = f.values.to_numpy().reshape(-1, 1 + len(PREFIXES)), s.values.to_numpy()
        if len(f):
            features.append(f)
            sentence.append(s + base)
            base += int(s[-1]) + 1
            text.append(np.full(int(s[-1]) + 1, i))
    order = [np.concatenate(x) for x in (features, sentence, text)]
    return calibrate(fit(y, *order), y, *order)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", locate: bool = False, threshold: float = 0.5) -> DataFrame:
    """Per row: id, score in 0..1, n_sentences, n_offending; with locate also offending, the sentences of at least the threshold with their own scores.

    Whole texts are read, the text alone. Null, empty and wordless texts score 0; repeated rows score alike; other columns are dropped.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, score double, n_sentences long, n_offending long" + (", offending array<struct<sentence:string,score:double>>" if locate else "")
    limit = np.log(threshold / (1 - threshold)) - model.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            for own in shingles.chunks(shingles.texts_of(batch.column(1))):
                features, sentence, text = sentence_words(own)
                z = sentence_logits(model, features, sentence, len(text))
                found = [_located(t, z[text == i], model.calibrated(1 / (1 + np.exp(-z[text == i]))), limit) for i, t in enumerate(own)] if locate else [None] * len(own)
                parts.append((model.calibrated(noisy_or(z, text, len(own))), np.bincount(text, minlength=len(own)), np.bincount(text[z >= limit], minlength=len(own)), found))
            if not parts:
                continue
            columns = [batch.column(0), *[pa.array(np.concatenate([p[k] for p in parts])) for k in range(3)]]
            if locate:
                kinds = pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))
                columns.append(pa.array([x for p in parts for x in p[3]], kinds))
            names = [id_col, "score", "n_sentences", "n_offending", "offending"]
            yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    return docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(run, schema)


def _located(text: bytes, logits: np.ndarray, scores: np.ndarray, limit: float) -> list[dict]:
    import re

    own = [x for x in re.split(rb"(?<=[.!?\n])", text) if re.search(rb"[A-Za-z\x80-\xff]", x)]
    return [{"sentence": x.decode(errors="replace").strip(), "score": s} for x, z, s in zip(own, logits, scores.tolist(), strict=True) if z >= limit]
