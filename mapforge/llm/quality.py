"""A quality classifier: random-indexing word vectors, pooled, then a two-layer network with calibrated probabilities.

Every word has a sparse random index vector, drawn from its hash and from those of its shape and its ending, so that
words never seen before share parts with words that were. A known word's vector is the sum of the index vectors of
its neighbours in the training texts (its contexts), scaled to length one, beside its own index vector; an unknown
word has its own only. A document's vector is the mean of its words' vectors over its whole text,
with the mean's length and how often a word repeats the one before. The network
has one hidden layer; its logits are divided by a temperature that is fitted on a part of the training rows that it
did not learn from, which calibrates the probabilities.

Only labels of the training fold are read, and of these at most `most` documents (those of the smallest hashes of
doc_id) with at most `chars` characters in all, which are the documented bounds of what the driver holds: a document
that would go beyond is passed over whole. Everything else covers all rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_names, in_batches, pieces
from .shingles import as_bytes

#: Dimensions of a vector's two halves, non-zero entries of an index vector, words on each side of a context.
DIM, NONZERO, WINDOW = 64, 4, 2
#: Training documents at most, characters of all of them at most, and words that keep a context vector at most.
SAMPLE, SAMPLE_CHARS, VOCABULARY = 3000, 32_000_000, 20_000
HIDDEN, EPOCHS, RATE, DECAY, SEED = 24, 160, 0.01, 1e-4, 3
CACHE_WORDS = 100_000
_CLASSES = bytes(b"A"[0] if 65 <= c <= 90 else b"a"[0] if 97 <= c <= 122 or c >= 128 else b"0"[0] if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
#: Numbers of a document's vector: the two halves, the own half's length, the share of words like the one before, and the size.
WIDTH = 2 * DIM + 3


def shape(word: bytes) -> bytes:
    """Runs of upper case, lower case and digits become one letter each; marks stay, repeated ones once."""
    return _RUN.sub(rb"\1", word.translate(_CLASSES))[:12]


def index_vectors(words: list[bytes]) -> np.ndarray:
    """For each word the sum of the sparse random vectors of its lower-case form, shape and ending."""
    out, rows = np.zeros((len(words), DIM), np.float32), np.arange(len(words))
    digest = xxhash.xxh3_64_intdigest
    for seed, parts in ((1, map(bytes.lower, words)), (2, map(shape, words)), (3, (w[-2:] for w in words))):
        h = np.fromiter((digest(p, seed) for p in parts), np.uint64, len(words))
        for k in range(NONZERO):
            bits = (h >> np.uint64(16 * k)).astype(np.int64)
            np.add.at(out, (rows, bits % DIM), np.where(bits >> 8 & 1, 1.0, -1.0).astype(np.float32))
    return out


def contexts(texts: list[bytes], limit: int = VOCABULARY, window: int = WINDOW) -> dict[bytes, np.ndarray]:
    """Random-indexing vectors of the commonest words: summed index vectors of their neighbours, of length one."""
    counts: Counter[bytes] = Counter()
    for t in texts:
        counts.update(t.lower().split())
    kept = sorted((w for w, n in counts.items() if n > 1), key=lambda w: (-counts[w], w))[:limit]
    number = {w: i for i, w in enumerate(kept)}
    index = np.concatenate([index_vectors(kept), np.zeros((1, DIM), np.float32)])
    sums = np.zeros((len(kept) + 1, DIM), np.float32)
    for t in texts:
        at = np.array([number.get(w, len(kept)) for w in t.lower().split()], np.int64)
        for d in range(1, window + 1):
            if len(at) > d:
                np.add.at(sums, at[:-d], index[at[d:]])
                np.add.at(sums, at[d:], index[at[:-d]])
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return {w: sums[i] for w, i in number.items()}


class Vectors:
    """Vectors of words, remembered, and of documents."""

    def __init__(self, known: dict[bytes, np.ndarray]):
        self.known, self.at = known, {}
        self.table = np.zeros((1 << 12, 2 * DIM), np.float32)

    def documents(self, texts: list) -> np.ndarray:
        """WIDTH numbers for each text; without words, all zero."""
        if len(self.at) > CACHE_WORDS:
            self.at.clear()
        split = [as_bytes(t).split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        words = [w for s in split for w in s]
        new = list(set(words).difference(self.at))
        first = len(self.at)
        if first + len(new) > len(self.table):
            self.table = np.concatenate([self.table[:first], np.zeros((len(new) + first // 2, 2 * DIM), np.float32)])
        for begin in range(0, len(new), 20_000):
            part = new[begin : begin + 20_000]
            self.table[first + begin : first + begin + len(part), :DIM] = index_vectors(part)
        none = np.zeros(DIM, np.float32)
        for n, w in enumerate(new, first):
            self.at[w] = n
            self.table[n, DIM:] = self.known.get(w.lower(), none)
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        out = np.zeros((len(texts), WIDTH), np.float32)
        begin = 0
        for i, n in enumerate(counts.tolist()):
            if n:
                # Words in blocks, so that a very long text needs no more memory than a short one.
                for j in range(begin, begin + n, 50_000):
                    out[i, : 2 * DIM] += self.table[at[j : min(j + 50_000, begin + n)]].sum(axis=0)
                out[i, : 2 * DIM] /= n
                out[i, -3:] = np.linalg.norm(out[i, :DIM]), (at[begin + 1 : begin + n] == at[begin : begin + n - 1]).mean() if n > 1 else 0, np.log1p(n) / 10
            begin += n
        return out


@dataclass
class Model:
    known: dict[bytes, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def gradients(model: Model, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of the mean log loss and of DECAY / 2 times the squared weights, by w1, b1, w2 and b2; z are scaled inputs."""
    h = np.tanh(z @ model.w1 + model.b1)
    err = (1 / (1 + np.exp(-np.clip(h @ model.w2 + model.b2, -60, 60))) - y) / len(y)
    back = np.outer(err, model.w2) * (1 - h * h)
    return z.T @ back + DECAY * model.w1, back.sum(axis=0), h.T @ err + DECAY * model.w2, np.array([err.sum()])


def train(texts: list, labels: np.ndarray, seed: int = SEED) -> Model:
    """Fits the network on four fifths of the rows and the temperature on the rest. With one class only, its share is the score."""
    raw = [as_bytes(t) for t in texts]
    y = np.asarray(labels, np.float64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(raw))
    fit, held = order[len(raw) // 5 :], order[: len(raw) // 5]
    known = contexts([raw[i] for i in fit]) if len(raw) else {}
    vectors = Vectors(known)
    x = np.concatenate([vectors.documents(raw[i : i + 200]) for i in range(0, len(raw), 200)]).astype(np.float64) if raw else np.zeros((0, WIDTH))
    mean, scale = (x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3) if len(fit) else (np.zeros(WIDTH), np.ones(WIDTH))
    prior = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    model = Model(known, mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(prior / (1 - prior))), 1.0)
    if len(set(y[fit].tolist())) < 2:
        return model
    model.w2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
    state = [[np.zeros_like(p, dtype=np.float64), np.zeros_like(p, dtype=np.float64)] for p in (model.w1, model.b1, model.w2, np.zeros(1))]
    step = 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
            grads = gradients(model, (x[rows] - mean) / scale, y[rows])
            step += 1
            moves = []
            for g, s in zip(grads, state):  # Adam
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.999 * s[1] + 0.001 * g * g
                moves.append(RATE * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8))
            model.w1 -= moves[0]
            model.b1 -= moves[1]
            model.w2 -= moves[2]
            model.b2 -= float(moves[3][0])
    if len(held):
        logits = model.logits(x[held])
        grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
        # Two made-up rows, one of each class at even odds, keep the temperature finite where all is right.
        loss = [np.logaddexp(0, -np.where(y[held] > 0, 1, -1) * logits / t).sum() + np.logaddexp(0, 6 / t) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fold(doc_id: str) -> Column:
    """crc32 of doc_id as text, modulo 5; rows of fold 0 are held out. A null doc_id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, chars: int = SAMPLE_CHARS, target: str = "quality") -> Model:
    """A model of the labelled training rows. Of a doc_id that is labelled twice, the larger label counts; of one with
    several texts, the shortest."""
    known = labels.select("doc_id", F.col(target).alias("label")).filter("doc_id is not null and label is not null").filter(fold("doc_id") != 0)
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most `most` rows of two numbers, whatever the size of the labels; then as many of sizes and hashes, without texts.
    found = column_names(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sized = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("hash"))).alias("t"))
    held, kept = 0, []
    for r in sorted(sized.collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id)):
        if held + r.t.n <= chars:
            held += r.t.n
            kept.append((r.doc_id, r.t.hash))
    if not kept:
        return train([], np.zeros(0))
    table = docs.sparkSession.createDataFrame(kept, "doc_id long, hash long")
    texts = found.withColumn("hash", F.xxhash64("text")).join(F.broadcast(table), ["doc_id", "hash"]).groupBy("doc_id", "label").agg(F.first("text").alias("text"))
    got = sorted(texts.collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return train([r.text for r in got], np.array([int(r.label > 0) for r in got]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs; a null or empty text has a score like all others."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        vectors = Vectors(own.known)
        for part, texts in pieces(batches, limit=1_500_000):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.scores(vectors.documents(texts)).astype(np.float64))], ["doc_id", "score"])

    scored = in_batches(column_names(docs, "doc_id", "text"), run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """score() by the model that fit() makes. Without labels of the training fold every score is a half."""
    return score(docs, fit(docs, labels, most), threshold)


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least threshold; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        vectors = Vectors(sent.value.known)
        for part, texts in pieces(batches, limit=1_500_000):
            yield part.filter(pa.array(sent.value.scores(vectors.documents(texts)) >= threshold))

    return in_batches(docs, run, docs.schema)
