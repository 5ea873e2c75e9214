"""Document quality from random-indexing word vectors.

Every word (hashed to one of ``BUCKETS``) has a fixed random index vector of a
few +1 and -1. A word's vector is the sum of the index vectors of its neighbours
over the whole corpus, summed per task and then by bucket, so the table of
vectors has a fixed size. A document pools its words: the mean, weighted by the
rarity of the words, of their vectors and of their index vectors, and the spread
of the vectors. A two-layer network is trained on a bounded sample of labelled
documents; its temperature is set on a part that training did not see.

Defined results: NULL and empty texts pool to zeros and get the network's score
for them; labels that are NULL or whose documents are missing are not learned
from; without labels of both kinds the score is 0.5 for all; repeated rows are
scored alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.common import map_batches

BUCKETS = 1 << 13  # words share so many vectors: 8192 x 32 numbers, 2 MB
DIMENSIONS = 32
NONZERO = 4  # entries of an index vector
REACH = 2  # neighbours on each side
BLOCK = 512  # words whose index vectors are held at once, so that they stay in a core's cache
TRAIN_ROWS = 20_000  # labelled documents learned from, at most
HIDDEN = 24
FOLDS, HELD_OUT = 3, 1  # rows whose crc32 of the id leaves HELD_OUT are not learned from


def index_vectors() -> np.ndarray:
    """The fixed random index vector of each bucket."""
    draw = np.random.default_rng(20)
    table = np.zeros((BUCKETS, DIMENSIONS), np.int8)
    for i in range(NONZERO):
        at = draw.integers(0, DIMENSIONS, BUCKETS)
        table[np.arange(BUCKETS), at] += np.where(draw.random(BUCKETS) < 0.5, 1, -1).astype(np.int8)
    return table


def _buckets(segment: words.Segment) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and piece of each word of a segment."""
    starts, ends, pieces = words.spans(segment)
    if len(starts) == 0:
        return starts, pieces
    hashes = words.Hasher(segment.data).of(starts, ends)
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), pieces


def neighbour_sums(bucket: np.ndarray, piece: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sum of the index vectors of each word's neighbours in its own text; a row per dimension, a column per word.

    A sum is at most 2 * REACH * NONZERO, so bytes hold it.
    """
    own = np.take(np.ascontiguousarray(index.T), bucket, 1)
    near = np.zeros_like(own)
    for d in range(1, REACH + 1):
        same = (piece[d:] == piece[:-d]).astype(np.int8)
        near[:, d:] += own[:, :-d] * same
        near[:, :-d] += own[:, d:] * same
    return near


def neighbour_products(bucket: np.ndarray, piece: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Twice the product of each word's index vector with those of its next neighbours in its own text.

    Over a text they sum to the products with the neighbours on both sides.
    """
    out = np.zeros(len(bucket))
    for begin in range(0, len(bucket), BLOCK):
        own = index.take(bucket[begin : begin + BLOCK + REACH], 0)
        for d in range(1, REACH + 1):
            after = own[d : d + BLOCK]
            end = begin + len(after)
            same = piece[begin + d : end + d] == piece[begin:end]
            out[begin:end] += 2 * np.einsum("ij,ij->i", own[: len(after)], after) * same
    return out


def corpus_vectors(docs: DataFrame) -> DataFrame:
    """(bucket, n, v0 ... ) over all documents: counts and summed neighbour vectors.

    A task sums its own texts first and emits each bucket once.
    """
    names = [f"v{i}" for i in range(DIMENSIONS)]

    def run(batches):
        index = index_vectors()
        sums = np.zeros((BUCKETS, DIMENSIONS), np.int64)
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for segment in words.segments(batch.column(0)):
                bucket, piece = _buckets(segment)
                if len(bucket) == 0:
                    continue
                near = neighbour_sums(bucket, piece, index)
                counts += np.bincount(bucket, minlength=BUCKETS)
                for i in range(DIMENSIONS):
                    sums[:, i] += np.bincount(bucket, near[i], BUCKETS).astype(np.int64)
        seen = np.flatnonzero(counts)
        if len(seen):
            columns = [pa.array(seen), pa.array(counts[seen]), *[pa.array(sums[seen, i]) for i in range(DIMENSIONS)]]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "n", *names])

    schema = ", ".join(f"{c} bigint" for c in ["bucket", "n", *names])
    partial = docs.select("text").mapInArrow(run, schema)
    return partial.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ["n", *names]])


@dataclass(frozen=True)
class WordVectors:
    """A row per bucket: weight, index vector and corpus vector side by side."""

    weights: np.ndarray
    table: np.ndarray

    @staticmethod
    def gathered(corpus: DataFrame) -> WordVectors:
        """From at most BUCKETS rows."""
        got = corpus.toArrow()
        bucket = got["bucket"].to_numpy()
        counts = np.zeros(BUCKETS)
        counts[bucket] = got["n"].to_numpy()
        summed = np.zeros((BUCKETS, DIMENSIONS), np.float32)
        for i in range(DIMENSIONS):
            summed[bucket, i] = got[f"v{i}"].to_numpy()
        length = np.sqrt((summed**2).sum(1, keepdims=True))
        share = counts / max(1.0, counts.sum())
        weights = (1e-3 / (1e-3 + share)).astype(np.float32)
        table = np.hstack([index_vectors().astype(np.float32), summed / np.maximum(length, 1)])
        return WordVectors(weights, table)

    @property
    def features(self) -> int:
        return 2 * self.table.shape[1] + 4

    @cached_property
    def summands(self) -> np.ndarray:
        """What a word adds to its text's sums, a column per bucket: its weighted vectors and their squares."""
        vectors = (self.table * self.weights[:, None]).T
        return np.vstack([vectors, vectors * vectors]).astype(np.float64, order="C")

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """A row of features for each text."""
        d, index = self.table.shape[1], index_vectors().astype(np.float32)
        sums = np.zeros((len(texts), 2 * d + 3))
        for segment in words.segments(texts):
            bucket, piece = _buckets(segment)
            if len(bucket) == 0:
                continue
            w = self.weights[bucket]
            first = np.flatnonzero(np.diff(piece, prepend=-1))
            at = segment.rows[piece[first]]
            # one dimension of all words at a time: its row of the table and its words' numbers stay in a core's cache
            for i, row in enumerate(self.summands):
                sums[at, i] += np.add.reduceat(row.take(bucket), first)
            sums[at, 2 * d] += np.add.reduceat(w, first, dtype=np.float64)
            sums[at, 2 * d + 1] += np.diff(np.append(first, len(piece)))
            # how much of a word's own index vector its neighbours hold: high where words repeat at once
            sums[at, 2 * d + 2] += np.add.reduceat(neighbour_products(bucket, piece, index), first)
        words_held = sums[:, 2 * d + 1 : 2 * d + 2]
        n = np.maximum(words_held, 1)
        mean = sums[:, :d] / np.maximum(sums[:, 2 * d : 2 * d + 1], 1e-6)
        spread = np.sqrt(sums[:, d : 2 * d] / n)
        return np.hstack([mean, spread, sums[:, 2 * d : 2 * d + 1] / n, sums[:, 2 * d + 2 :] / n, np.log1p(words_held), words_held == 0])


@dataclass(frozen=True)
class Network:
    """Two layers with a temperature on the output."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip((hidden @ self.w2 + self.b2) / self.temperature, -30, 30)))


def constant_network(features: int) -> Network:
    zero = np.zeros(features)
    return Network(zero, zero + 1, np.zeros((features, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, seed: int = 1) -> Network:
    """Adam on the logistic loss; the temperature minimises it on a fifth kept apart."""
    if len(set(y.tolist())) < 2:
        return constant_network(x.shape[1])
    draw = np.random.default_rng(seed)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    order = draw.permutation(len(y))
    kept, fitted = order[: len(y) // 5], order[len(y) // 5 :]
    w1, b1 = draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
    weights = [w1, b1, w2, b2]
    first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(rounds):
        for part in np.array_split(draw.permutation(fitted), max(1, len(fitted) // 64)):
            hidden = np.tanh(z[part] @ w1 + b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30))) - y[part]) / len(part)
            back = error[:, None] * w2 * (1 - hidden * hidden)
            grads = [z[part].T @ back + 1e-4 * w1, back.sum(0), hidden.T @ error + 1e-4 * w2, error.sum(keepdims=True)]
            t += 1
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= 0.003 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    net = Network(centre, scale, w1, b1, w2, float(b2[0]), 1.0)
    sign = np.where(y[kept] == 1, 1, -1)
    logits = np.tanh(z[kept] @ w1 + b1) @ w2 + b2
    choices = np.geomspace(0.25, 8, 41)
    loss = [np.logaddexp(0, -sign * logits / c).mean() for c in choices] if len(kept) else [0.0]
    return Network(net.centre, net.scale, w1, b1, w2, net.b2, float(choices[int(np.argmin(loss))]) if len(kept) else 1.0)


def in_fold(doc_id, folds: int, fold: int):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold


def learn(docs: DataFrame, labels: DataFrame, vectors: WordVectors, limit: int = TRAIN_ROWS) -> Network:
    """Train on at most ``limit`` labelled rows, those with the lowest hash, outside the held-out fold.

    The limit bounds what is broadcast and what is collected.
    """
    known = labels.where(F.col("label").isNotNull() & ~in_fold(F.col("doc_id"), FOLDS, HELD_OUT))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = vectors.pooled(batch.column("text"))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], ["doc_id", "label", "x"])

        return step

    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text")
    got = map_batches(sample, make, "doc_id bigint, label int, x array<double>").toArrow()
    if got.num_rows == 0:
        return constant_network(vectors.features)
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    label = got["label"].to_numpy()
    # ordered here: a sort in Spark pools every text once more to find its ranges
    order = np.lexsort([*x.T[::-1], label, got["doc_id"].to_numpy()])
    return train(x[order], (label[order] > 0).astype(np.float64))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text); labels are (doc_id, label)."""
    vectors = WordVectors.gathered(corpus_vectors(docs))
    network = learn(docs, labels, vectors)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = network.score(vectors.pooled(batch.column("text")))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

        return step

    out = map_batches(docs.select("doc_id", "text"), make, "doc_id bigint, score double, predicted int")
    return out.select("doc_id", F.coalesce(in_fold(F.col("doc_id"), FOLDS, HELD_OUT), F.lit(False)).alias("held_out"), "score", "predicted")
