"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit a linear classifier over hashed byte n-grams of the lower-cased
text, white space and ASCII punctuation folded, predicts on which side the text's language stands. Decoding is loss-weighted:
a codeword's distance is the sum over its bits of exp(-bit * margin), each weighted by how well the bit's classifier
knows that language; the nearest codeword wins. A text whose two nearest codewords lie close together is flagged.

The classifiers are fitted on a bounded sample: PER_LANGUAGE texts of each language, or MOST_SAMPLE over the number of languages where
that is less, so that every labelled language is learned; every text is scored whole, in one pass without a shuffle.

Defined results: a null text and one without a letter are ``und`` with score 0; so is any text if no row is labelled;
with one learned language every text with a letter is of it, with score 1; equal texts get equal results, repeated rows each their own; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import encoded, field, forget, pick, pieces
from .sampling import class_sample, collected

PER_LANGUAGE, MOST_SAMPLE = 500, 8000
#: Hashed n-grams: how many buckets, and of which lengths in bytes.
BUCKETS, LENGTHS = 4096, (2, 3)
RIDGE = 0.05
#: Codes of up to this many languages hold every split of them; longer ones are random, this many bits per log2 of their number.
EXHAUSTIVE, BITS_PER_LOG = 6, 10
#: Steepness of the score, and the least relative distance between the two nearest codewords of a clear text.
STEEPNESS, CLEAR = 1.5, 0.1
#: From this distance of the nearest codeword on (1: the classifiers say nothing) an ambiguous text's language is not found.
FAR = 0.95
UNDETERMINED = "und"
_FOLD = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def ngram_features(texts: list[bytes | None]) -> np.ndarray:
    """Rows of square roots of n-gram counts, each of length 1 (of length 0 for a text without any)."""
    joined = np.frombuffer(b"   ".join(t or b"" for t in texts) + b"   ", np.uint8)
    folded = _FOLD[joined].astype(np.uint32)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    hashes = []
    for n in LENGTHS:
        h = np.full(len(folded) - n + 1, np.uint32(n))
        for k in range(n):
            h = (h + folded[k : len(folded) - n + 1 + k]) * _FACTORS[k]
            h ^= h >> np.uint32(15)
        h = (h * _FACTORS[3]) >> shift
        # an n-gram of nothing but white space says nothing; runs of it would swamp a short text
        h[folded[: len(h)] + folded[1 : len(h) + 1] == 64] = 0
        hashes.append(h.astype(np.int64))
    out, at = np.zeros((len(texts), BUCKETS), np.float32), 0
    for row, t in zip(out, texts, strict=True):
        end = at + len(t or b"") + 1
        for h in hashes:
            row += np.bincount(h[at:end], minlength=BUCKETS)
        at = end + 2
    out[:, 0] = 0
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 per class; every column splits the classes."""
    if classes < 2:
        return np.ones((classes, 0))
    if classes <= EXHAUSTIVE:
        bits = [[1 if (k >> c) & 1 else -1 for c in range(classes)] for k in range(1, 1 << (classes - 1))]
        return np.array(bits).T
    r, n = np.random.default_rng(seed), int(np.ceil(BITS_PER_LOG * np.log2(classes)))
    best, most = None, -1
    for _ in range(200):
        code = np.where(r.random((classes, n)) < 0.5, -1, 1)
        if (abs(code.sum(0)) == classes).any():
            continue
        apart = (n - (code @ code.T)[np.triu_indices(classes, 1)].max()) // 2
        if apart > most:
            best, most = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # (buckets + 1) x bits, the last row is the constant
    trust: np.ndarray  # languages x bits, rows add up to the number of bits

    def distances(self, x: np.ndarray) -> np.ndarray:
        """The loss-weighted distance of each text to each codeword: 1 if the classifiers say nothing, 0 if they are sure and agree."""
        margins = x @ self.weights[:-1] + self.weights[-1]
        up, down = (np.exp(sign * margins) @ np.where(self.code == -sign, self.trust, 0).T for sign in (-1, 1))
        return (up + down) / max(1, self.code.shape[1])


def train(x: np.ndarray, labels: list[str]) -> Model:
    """Least-squares classifiers of all bits at once, classes weighing the same."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        return Model(languages, codewords(len(languages)), np.zeros((BUCKETS + 1, 0), np.float32), np.ones((len(languages), 0)))
    code, which = codewords(len(languages)), np.array([languages.index(v) for v in labels])
    weight = np.sqrt(len(which) / len(languages) / np.bincount(which))[which][:, None].astype(np.float32)
    a = np.hstack([x, np.ones((len(x), 1), np.float32)]) * weight
    y = code[which] * weight
    if len(a) <= a.shape[1]:  # fewer samples than features: solve for the samples
        w = a.T @ np.linalg.solve(a @ a.T + RIDGE * np.eye(len(a), dtype=np.float32), y)
    else:
        w = np.linalg.solve(a.T @ a + RIDGE * np.eye(a.shape[1], dtype=np.float32), a.T @ y)
    right = (x @ w[:-1] + w[-1]) * code[which] > 0
    trust = np.stack([right[which == k].mean(0) for k in range(len(languages))]) + 1e-3
    return Model(languages, code, w.astype(np.float32), trust / trust.sum(1, keepdims=True) * code.shape[1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame) -> Model:
    """The model of the labelled documents that are not held out."""
    d = pick(docs, doc_id="long", text="string", lang="string")
    labelled = d.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = class_sample(labelled, "lang", PER_LANGUAGE, MOST_SAMPLE)
    return train(*collected(sample, "lang", lambda b: ngram_features(encoded(pc.utf8_lower(b.column("text"))))))


def _decoded(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(slice, place of each text's language in the model, score, distance of its codeword, whether it is ambiguous)."""
    forget()
    for b in pieces(batches, rows=500, most_bytes=2 << 20):
        column = field(b, "text", pa.string())
        lettered = np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False))
        n = len(column)
        if len(m.languages) < 2:
            best, score, near, least = np.full(n, 0), np.full(n, float(len(m.languages))), np.zeros(n, bool), np.zeros(n)
        else:
            d = m.distances(ngram_features(encoded(pc.utf8_lower(column))))
            best = d.argmin(1)
            two = np.partition(d, 1, axis=1)[:, :2]
            least = two[:, 0]
            score = 1 / np.exp(-STEEPNESS * len(m.languages) * (d - two[:, :1])).sum(1)
            near = (two[:, 1] - two[:, 0]) < CLEAR * two[:, 1]
        yield b, np.where(lettered, best, len(m.languages)), np.where(lettered, score, 0.0), np.where(lettered, least, 1.0), near & lettered


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, ambiguous, distance (of the nearest codeword, 1 for ``und``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = pick(docs, doc_id="long", text="string").withColumn("held_out", held_out(F.col("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, UNDETERMINED], object)
        for b, best, score, distance, near in _decoded(batches, shared.value):
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(names[best], pa.string()), pa.array(score), pa.array(near), pa.array(distance.astype(float))],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous", "distance"],
            )

    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, distance double")


def identified(docs: DataFrame, model: Model, far: float = FAR) -> DataFrame:
    """The rows of ``docs``, all their columns, whose language is found: texts with a letter, but for those that are ambiguous and ``far`` from every codeword."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, best, _, distance, near in _decoded(batches, shared.value):
            yield b.filter(pa.array((best < len(shared.value.languages)) & ~(near & (distance >= far))))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame) -> DataFrame:
    return identify(docs, learn(docs))
