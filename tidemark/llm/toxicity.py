"""Toxicity from a bidirectional gated recurrent network with attention pooling.

A text is read as words; a run without spaces is cut every ``LONGEST``
characters. A word's input is the sum of learned vectors for the word itself, its
first 2 to 7 bytes, its last three, its length and, from each of its characters
on, ``GRAM`` characters of the run, also across a cut. Windows of ``WINDOW`` words overlap, so every word but those at the
ends of a text is read in more than one place or with context on both sides. In
each window a forward and a backward recurrent layer are pooled by attention;
a document's score is that of its most toxic window, and all windows are scored.

The network is trained in numpy on a bounded sample of labelled documents. Only
the label of a whole document is known, so in each round the window that scores
highest stands for its document.

Defined results: NULL and empty texts get the score of a window without words;
labels that are NULL are not learned from; without labels of both kinds the
score is 0.5 for all; repeated rows are scored alike; texts beyond a megabyte
are read in parts cut at white space, each with its own windows; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.common import map_batches
from tidemark.llm.quality import in_fold

WINDOW, STEP = 32, 24
ROWS = 1 << 13  # rows of each table of input vectors, shared by hash
PREFIXES = (2, 3, 4, 5, 6, 7)
INPUT, HIDDEN = 12, 12
TRAIN_TOXIC, TRAIN_CLEAN = 1200, 2000  # labelled documents learned from, at most
TRAIN_CHARACTERS = 50_000  # a longer document is not learned from
TRAIN_TEXT = {1: 1_500_000, 0: 2_500_000}  # bytes of text by label after which no further document is learned from
FOLDS, HELD_OUT = 5, 0  # rows whose crc32 of the id leaves HELD_OUT are not learned from
SEGMENT = 1 << 19
TABLES = 2 + len(PREFIXES)
LONGEST, GRAM = 16, 3  # characters of a word, and of a run of them
GRAM_ROWS = 1 << 14  # rows of the table of character runs, shared by hash
GRAMS = TABLES * ROWS + 32  # where it begins
NO_GRAM = GRAMS + GRAM_ROWS  # for characters that a word does not have; stays zero
INPUTS = TABLES + 1 + LONGEST


def word_inputs(segment: words.Segment) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the input tables for each word [n, INPUTS] and the word's piece."""
    starts, ends, piece = words.spans(segment)
    data = words.LOWER[segment.data]
    hasher = words.Hasher(data)
    # the characters of all words, each with its run and its place there
    lead = (data & 0xC0) != 0x80
    lead[starts] = True
    at = np.flatnonzero(lead)
    run = np.searchsorted(starts, at, "right") - 1
    held = (run >= 0) & (at < ends[run]) if len(starts) else np.zeros(len(at), bool)
    at, run = at[held], run[held]
    nth = np.arange(len(at)) - np.searchsorted(run, np.arange(len(starts)))[run]
    grams = hasher.of(at, np.minimum(np.append(at[GRAM:], np.full(min(GRAM, len(at)), len(data))), ends[run]))
    first = np.flatnonzero(nth % LONGEST == 0)
    piece, ends = piece[run[first]], np.minimum(np.append(at[first[1:]], np.full(min(1, len(first)), len(data))), ends[run[first]])
    starts = at[first]
    out = np.full((len(starts), INPUTS), NO_GRAM, np.int32)
    out[np.cumsum(nth % LONGEST == 0) - 1, TABLES + 1 + nth % LONGEST] = GRAMS + (grams % np.uint64(GRAM_ROWS)).astype(np.int32)
    parts = [(starts, ends), (np.maximum(starts, ends - 3), ends), *((starts, np.minimum(ends, starts + n)) for n in PREFIXES)]
    for i, (a, b) in enumerate(parts):
        # a prefix as long as the word or longer is marked by the length hashed with it
        out[:, i] = (hasher.of(a, b) % np.uint64(ROWS)).astype(np.int32) + i * ROWS
    out[:, TABLES] = TABLES * ROWS + np.minimum(ends - starts, 31)
    return out, piece


def windows(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and piece of each window, from the words' pieces."""
    first = np.flatnonzero(np.diff(piece, prepend=-1))
    n = np.diff(np.append(first, len(piece)))
    count = np.maximum(1, -(-(n - WINDOW) // STEP) + 1)
    of = np.repeat(np.arange(len(first)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = nth * STEP
    return first[of] + start, np.minimum(WINDOW, n[of] - start), piece[first[of]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights by name; ``f`` and ``b`` are the two directions."""

    w: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 3) -> Network:
        draw = np.random.default_rng(seed)
        h = HIDDEN

        def matrix(*shape):
            return (draw.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)

        w = {"e": (0.1 * draw.normal(0, 1, (NO_GRAM + 1, INPUT))).astype(np.float32)}
        w["e"][NO_GRAM] = 0
        for d in "fb":
            w |= {f"{d}x": matrix(INPUT, 3 * h), f"{d}c": np.zeros(3 * h, np.float32), f"{d}u": matrix(h, 3 * h)}
        return Network(w | {"a": matrix(2 * h), "o": matrix(2 * h), "k": np.array([-1.0], np.float32)})

    def run(self, inputs: np.ndarray, start: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logit of each window; with ``keep`` also what the way back needs."""
        w, h, n = self.w, HIDDEN, len(start)
        x = np.zeros((len(inputs) + 1, INPUT), w["e"].dtype)  # the last row is read beyond a window's end, then masked
        for column in inputs.T[: TABLES + 1]:
            x[:-1] += w["e"][column]
        for column in inputs.T[TABLES + 1 :]:
            given = np.flatnonzero(column != NO_GRAM)
            x[given] += w["e"][column[given]]
        at = [np.where(t < length, start + t, len(x) - 1) for t in range(WINDOW)]
        on = [(t < length)[:, None].astype(np.float32) for t in range(WINDOW)]
        states = np.zeros((WINDOW, n, 2 * h), np.float32)
        kept: dict = {}
        for d, order, side in (("f", range(WINDOW), slice(0, h)), ("b", range(WINDOW - 1, -1, -1), slice(h, 2 * h))):
            projected = x @ w[d + "x"] + w[d + "c"]
            u, state = w[d + "u"], np.zeros((n, h), np.float32)
            for t in order:
                given = projected[at[t]]
                inner = state @ u
                gates = _sigmoid(given[:, : 2 * h] + inner[:, : 2 * h])
                new = np.tanh(given[:, 2 * h :] + gates[:, h:] * inner[:, 2 * h :])
                moved = new + gates[:, :h] * (state - new)
                if keep:
                    kept[d, t] = (state, gates, new, inner[:, 2 * h :])
                state = state + on[t] * (moved - state)
                states[t, :, side] = state
        level = states @ w["a"]
        level = np.where(np.arange(WINDOW)[:, None] < length, level, -1e9)
        share = np.exp(level - level.max(0))
        share /= share.sum(0)
        pooled = np.einsum("tn,tnh->nh", share, states)
        logit = pooled @ w["o"] + w["k"]
        return (logit, (x, at, on, states, share, pooled, kept)) if keep else logit

    def gradients(self, inputs: np.ndarray, held, error: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weights from the error on each window's logit."""
        w, h = self.w, HIDDEN
        x, at, on, states, share, pooled, kept = held
        g = {"o": pooled.T @ error, "k": error.sum(keepdims=True)}
        to_pooled = error[:, None] * w["o"]
        to_share = np.einsum("tnh,nh->tn", states, to_pooled)
        to_level = share * (to_share - (share * to_share).sum(0))
        g["a"] = np.einsum("tn,tnh->h", to_level, states)
        to_states = share[:, :, None] * to_pooled + to_level[:, :, None] * w["a"]
        to_x = np.zeros_like(x)
        for d, order, side in (("f", range(WINDOW - 1, -1, -1), slice(0, h)), ("b", range(WINDOW), slice(h, 2 * h))):
            gu, to_given = np.zeros_like(w[d + "u"]), np.zeros((len(x), 3 * h), np.float32)
            carried = np.zeros((len(error), h), np.float32)
            for t in order:
                state, gates, new, inner_n = kept[d, t]
                total = carried + to_states[t, :, side]
                moved = on[t] * total
                z, r = gates[:, :h], gates[:, h:]
                to_n = moved * (1 - z) * (1 - new * new)
                to_z = moved * (state - new) * z * (1 - z)
                to_r = to_n * inner_n * r * (1 - r)
                given = np.hstack([to_z, to_r, to_n])
                inner = np.hstack([to_z, to_r, to_n * r])
                gu += state.T @ inner
                np.add.at(to_given, at[t], given)
                carried = total - moved + moved * z + inner @ w[d + "u"].T
            to_given[-1] = 0
            g[d + "u"], g[d + "x"], g[d + "c"] = gu, x.T @ to_given, to_given.sum(0)
            to_x += to_given @ w[d + "x"].T
        word, place = np.nonzero(inputs != NO_GRAM)
        rows, by_word = inputs[word, place], to_x[word]
        g["e"] = np.stack([np.bincount(rows, by_word[:, i], len(w["e"])) for i in range(INPUT)], 1).astype(np.float32)
        return g


def doc_logits(net: Network, texts: pa.Array) -> np.ndarray:
    """The highest window logit of each text."""
    nothing = net.run(np.zeros((0, INPUTS), np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    best = np.full(len(texts), -np.inf)
    for segment in words.segments(texts, SEGMENT):
        inputs, piece = word_inputs(segment)
        if len(inputs) == 0:
            continue
        start, length, of = windows(piece)
        np.maximum.at(best, segment.rows[of], net.run(inputs, start, length).astype(np.float64))
    return np.where(np.isfinite(best), best, nothing)


@dataclass
class Sample:
    """Windows of the labelled documents, one after another."""

    inputs: np.ndarray
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    label: np.ndarray


def within_bound(texts: pa.Array, label: np.ndarray) -> np.ndarray:
    """The first documents of each label, whole, until ``TRAIN_TEXT`` is reached."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    kept = np.zeros(len(size), bool)
    for kind, most in TRAIN_TEXT.items():
        mine = label == kind
        kept[mine] = np.cumsum(size[mine]) - size[mine] < most
    return kept


def sample_windows(texts: pa.Array, label: np.ndarray) -> Sample:
    inputs, start, length, doc, base = [], [], [], [], 0
    for segment in words.segments(texts):
        rows, piece = word_inputs(segment)
        if len(rows) == 0:
            continue
        s, n, of = windows(piece)
        inputs.append(rows)
        start.append(s + base)
        length.append(n)
        doc.append(segment.rows[of])
        base += len(rows)
    if not inputs:
        return Sample(np.zeros((0, INPUTS), np.int32), *[np.zeros(0, np.int64)] * 3, label)
    return Sample(np.concatenate(inputs), np.concatenate(start), np.concatenate(length), np.concatenate(doc), label)


def _evidence(sample: Sample) -> np.ndarray:
    """Log odds of each input row from the documents that hold it."""
    pairs, label = [], []
    for doc in np.unique(sample.doc):
        mine = sample.doc == doc
        held = np.unique(sample.inputs[sample.start[mine].min() : (sample.start[mine] + sample.length[mine]).max()])
        pairs.append(held)
        label.append(np.full(len(held), sample.label[doc]))
    rows, label = np.concatenate(pairs), np.concatenate(label)
    size = NO_GRAM + 1
    bad, all_docs = np.bincount(rows, label, size), np.bincount(rows, minlength=size)
    prior = sample.label.mean()
    return np.log((bad + 2 * prior) / (all_docs - bad + 2 * (1 - prior)) * (1 - prior) / prior)


def train(sample: Sample, weight: np.ndarray, rounds: int = 6, least_steps: int = 150, seed: int = 4) -> Network | None:
    """Adam on the logistic loss of each document's highest window; ``weight`` by document.

    A small sample gets more rounds.
    """
    if len(sample.doc) == 0 or len(set(sample.label[np.unique(sample.doc)].tolist())) < 2:
        return None
    net, draw = Network.new(), np.random.default_rng(seed)
    net.w["e"][:NO_GRAM, 0] = np.where(np.arange(NO_GRAM) < GRAMS, 0.25, 0.05) * np.clip(_evidence(sample), -4, 4)[:NO_GRAM]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    steps, docs = 0, len(np.unique(sample.doc))
    rounds = max(rounds, least_steps * 128 // (docs + docs // 2 + 128))
    for round_ in range(rounds):
        blocks = np.array_split(np.arange(len(sample.doc)), len(sample.doc) // 2048 + 1)
        logit = np.concatenate([net.run(*_only(sample, block), sample.length[block]) for block in blocks])
        order = np.lexsort((-logit, sample.doc))
        top = order[np.flatnonzero(np.diff(sample.doc[order], prepend=-1))]
        # one more window of each clean document: none of its windows is toxic
        clean = np.flatnonzero(sample.label[sample.doc] == 0)
        chosen = np.concatenate([top, draw.choice(clean, min(len(clean), len(top) // 2), replace=False)])
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * round_ / rounds))
        for part in np.array_split(draw.permutation(chosen), max(1, len(chosen) // 128)):
            inputs, start = _only(sample, part)
            out, held = net.run(inputs, start, sample.length[part], keep=True)
            doc = sample.doc[part]
            error = ((_sigmoid(out) - sample.label[doc]) * weight[doc] / len(part)).astype(np.float32)
            steps += 1
            for k, g in net.gradients(inputs, held, error).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.w[k] -= (rate * m / (1 - 0.9**steps) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-7)).astype(np.float32)
    return net


def _only(sample: Sample, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inputs of the given windows laid one after another."""
    n = sample.length[part]
    start = np.cumsum(n) - n
    return sample.inputs[np.repeat(sample.start[part] - start, n) + np.arange(n.sum())], start


def learn(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Train on the labelled documents with the lowest hashes outside the held-out fold.

    At most TRAIN_TOXIC + TRAIN_CLEAN rows are broadcast, and their texts, each
    below TRAIN_CHARACTERS, collected. Of these the first by hash are learned
    from with all their windows, as many as TRAIN_TEXT holds.
    """
    usable = labels.where(F.col("label").isNotNull() & ~in_fold(F.col("doc_id"), FOLDS, HELD_OUT))
    hashed = [F.xxhash64("doc_id"), "doc_id"]
    toxic = usable.where("label > 0").orderBy(*hashed).limit(TRAIN_TOXIC)
    clean = usable.where("label <= 0").orderBy(*hashed).limit(TRAIN_CLEAN)
    shares = usable.agg(F.count_if(F.col("label") > 0).alias("toxic"), F.count_if(F.col("label") <= 0).alias("clean")).first()
    known = F.broadcast(toxic.unionByName(clean).select("doc_id", (F.col("label") > 0).cast("int").alias("label")).distinct())
    short = docs.select("doc_id", "text").where(F.length("text") <= TRAIN_CHARACTERS)
    got = short.join(known, "doc_id").orderBy(*hashed, "label", "text").limit(2 * (TRAIN_TOXIC + TRAIN_CLEAN)).toArrow()
    if got.num_rows == 0 or not shares["toxic"] or not shares["clean"]:
        return None
    texts, label = got["text"].combine_chunks(), got["label"].to_numpy().astype(np.float32)
    kept = within_bound(texts, label)
    texts, label = texts.filter(pa.array(kept)), label[kept]
    # documents stand for all labelled ones of their kind
    part = shares["toxic"] / (shares["toxic"] + shares["clean"])
    weight = np.where(label > 0, part / max(label.mean(), 1e-6), (1 - part) / max(1 - label.mean(), 1e-6))
    return train(sample_windows(texts, label), weight)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text); labels are (doc_id, label)."""
    schema = "doc_id bigint, score double, predicted int"
    out = map_batches(docs.select("doc_id", "text"), scorer(learn(docs, labels)), schema)
    return out.select("doc_id", F.coalesce(in_fold(F.col("doc_id"), FOLDS, HELD_OUT), F.lit(False)).alias("held_out"), "score", "predicted")


def scores(net: Network | None, texts: pa.Array) -> np.ndarray:
    if net is None:
        return np.full(len(texts), 0.5)
    return 1 / (1 + np.exp(-np.clip(doc_logits(net, texts), -30, 30)))


def scorer(net: Network | None):
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = scores(net, batch.column("text"))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

        return step

    return make


def kept(docs: DataFrame, net: Network | None) -> DataFrame:
    """The documents that are not toxic, with all their columns; without a network all are kept."""

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            score = scores(net, row.field("text") if row.null_count == 0 else row.flatten()[row.type.get_field_index("text")])
            out = batch.filter(pa.array((score < 0.5) | (net is None)))
            if out.num_rows:
                yield out

    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return held.mapInArrow(run, held.schema).select("row.*")
