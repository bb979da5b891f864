"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + <w, x> + sum over pairs i < j of <v_i, v_j> x_i x_j). The pairwise part is computed in linear time
as half the sum over factors of (sum of v x) squared less the sum of (v x) squared.

The machine is fitted on a bounded sample of labelled documents (PER_CLASS of each label); every text is scored whole, in
one pass without a shuffle.

Defined results: null and empty texts are scored like any other (their words are none); a null n_chars is taken as 0;
labels other than 0 and 1 are no labels; a document with several labels counts with its largest; without labels of both kinds every score is the share of label 1
(0.5 if there is none at all); equal texts with equal metadata get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, VOCABULARY, encoded, forget, pick, pieces
from .sampling import class_sample, collected

PER_CLASS = 1500
BUCKETS, FACTORS = 2048, 8
EPOCHS, STEP, MINIBATCH, DECAY = 30, 0.02, 256, 1e-4
THRESHOLD = 0.7
_WORDS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MARKS = bytes(c if 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 else 32 for c in range(256))
_CLASS = np.array([0 if c in b" \t\n\r\x0b\x0c" else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c >= 128 else 5 for c in range(256)], np.uint8)
STATISTICS = 20


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        b = self[word] = xxhash.xxh3_64_intdigest(word) % BUCKETS
        return b


def _structure(text: bytes, words: list[bytes], marks: list[bytes], n_chars: int) -> list[float]:
    """Statistics of a text's form, each of about unit size."""
    n = max(1, len(text))
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=6) / n
    lines = text.split(b"\n")
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    return [
        *(2 * kinds),  # white space, a-z, A-Z, digits, beyond ASCII, marks
        np.log1p(n) / 10, np.log1p(len(words)) / 8, np.log1p(n_chars) / 10,
        len(set(words)) / w, len(set(marks)) / max(1, len(marks)), len(marks) / w,
        lengths.mean() / 8, lengths.std() / 4, lengths.max() / 40,
        np.log1p(len(lines)) / 5, len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 8,
        max(map(len, marks), default=0) / 8, sum(len(m) > 1 for m in marks) / max(1, len(marks)),
    ]


def features(b: pa.RecordBatch, known: _Buckets) -> np.ndarray:
    """A row per document: hashed words and marks, each part of length 1, then the statistics."""
    out = np.zeros((len(b), 2 * BUCKETS + STATISTICS), np.float32)
    chars = b.column("n_chars").to_pylist()
    for row, t, c in zip(out, encoded(b.column("text")), chars, strict=True):
        t = t or b""
        words, marks = t.translate(LOWER).translate(_WORDS).split(), t.translate(_MARKS).split()
        for part, at in ((words, 0), (marks, BUCKETS)):
            if part:
                x = np.log1p(np.bincount(np.fromiter(map(known.__getitem__, part), np.int64, len(part)), minlength=BUCKETS))
                row[at : at + BUCKETS] = x / np.linalg.norm(x)
        row[2 * BUCKETS :] = np.clip(_structure(t, words, marks, c or 0), 0, 4)
    return out


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # features
    factors: np.ndarray  # features x factors

    def raw(self, x: np.ndarray, squares: np.ndarray | None = None) -> np.ndarray:
        if not len(self.linear):
            return np.full(len(x), self.bias)
        squares = x * x if squares is None else squares
        return self.bias + x @ self.linear + 0.5 * ((x @ self.factors) ** 2 - squares @ (self.factors**2)).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, prior: float, seed: int = 5) -> Machine:
    """Logistic loss, Adam over minibatches; ``prior``: the share of label 1 among all labelled documents."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if len(set(y.tolist())) < 2:
        return Machine(float(np.log(prior / (1 - prior))) if len(y) else 0.0, np.empty(0), np.empty((0, FACTORS)))
    r = np.random.default_rng(seed)
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    theta = [np.array([np.log(prior / (1 - prior))], np.float32), np.zeros(x.shape[1], np.float32), r.normal(0, 0.05, (x.shape[1], FACTORS)).astype(np.float32)]
    first, second, t = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta], 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(y))
        for at in range(0, len(y), MINIBATCH):
            rows = order[at : at + MINIBATCH]
            a, sq = x[rows], x[rows] ** 2
            va = a @ theta[2]
            raw = theta[0][0] + a @ theta[1] + 0.5 * (va**2 - sq @ (theta[2] ** 2)).sum(1)
            g = (weight[rows] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
            grads = [
                np.array([g.sum()], np.float32),
                a.T @ g + DECAY * theta[1],
                a.T @ (g[:, None] * va) - theta[2] * (sq.T @ g)[:, None] + DECAY * theta[2],
            ]
            t += 1
            step = STEP * (1 - epoch / EPOCHS)
            for p, d, m, v in zip(theta, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
    return Machine(float(theta[0][0]), theta[1], theta[2])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine of the labelled documents that are not held out. Texts are not shuffled: the sample's ids go to them."""
    known = pick(labels, doc_id="long", quality="int").where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    sample = F.broadcast(class_sample(known, "quality", PER_CLASS, 2 * PER_CLASS))  # some 2 * PER_CLASS ids, by their rate
    d = pick(docs, doc_id="long", text="string", n_chars="long").join(sample, "doc_id")
    buckets = _Buckets()
    x, y = collected(d, "quality", lambda b: features(b, buckets))
    return train(x, np.array(y), counts.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    d = pick(docs, doc_id="long", text="string", n_chars="long").withColumn("held_out", held_out(F.col("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m, known = shared.value, _Buckets()
        for b in pieces(batches, rows=500, most_bytes=8 << 20):
            s = m.score(features(b, known)).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))
