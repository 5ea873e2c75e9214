"""Runs: stretches of words that repeat with a period at least four times.

A run is a stretch of words with smallest period q and a length of at least
max(6, 4 q) that no neighbouring word extends. On the diagonal of lag q the words
of a run match the words q before them, all but the first q.

The diagonals are followed in text order. At each word its earlier occurrences name
lags; a lag whose diagonal is already active only goes on, any other opens a
diagonal whose match length is counted until the words differ. A diagonal that
ends with length enough emits its run there and then, if no divisor of the lag is
a period too.

Taking every earlier occurrence would make a text of one repeated word cost the
square of its length. So a lag between w and 2 w, w a power of two, is named by
earlier occurrences of the w words from the place on, and only by such w words
whose occurrences lie more than w / 2 apart. No run is lost: were all w words of
a run of period q >= w of a period of at most w / 2, neighbouring ones would share
it (they overlap in w - 1 words) and q were not smallest; the others occur again
one period on, and never within w / 2. So each place names three lags at
most for each w, and places whose words occur once drop out: the table of
diagonals is sparse for every text. Words are named by 64-bit hashes, the w words
by pairs of names (prefix doubling); runs are compared word by word in the end.

Defined results: a NULL or empty text has no words and no runs; runs may overlap,
also with others of another period; equal rows have equal results; an empty table
gives no rows; columns of any name stay in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WORD, rows_held
from tidemark.llm.words import BLANKS, Hasher, mixed, segments, spans

LEAST_LENGTH, LEAST_POWER = 6, 4
_FAR = np.int64(1) << 60

Run = tuple[int, int, int]  # start, length, period


def lags_named(names: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags, by place, that may lie on a run; names are equal only within a text, ends[i] is its end."""
    longest = int((ends - np.arange(len(names))).max(initial=0))
    place, name, w = np.arange(len(names)), names, 1
    places, lags = [], []
    while len(place) and LEAST_POWER * w <= longest:
        order = np.argsort(name, kind="stable")
        n, p = name[order], place[order]
        again = np.zeros(len(n), bool)
        again[1:] = n[1:] == n[:-1]
        gap = np.full(len(n), _FAR)
        gap[1:][again[1:]] = (p[1:] - p[:-1])[again[1:]]
        first = np.flatnonzero(~again)
        nearest = np.minimum.reduceat(gap, first)
        number = np.cumsum(~again) - 1
        usable = (2 * nearest > w)[number]
        for hop in range(1, 4):
            lag = p[hop:] - p[:-hop]
            held = (n[hop:] == n[:-hop]) & (lag >= w) & (lag < 2 * w) & usable[hop:]
            places.append(p[hop:][held])
            lags.append(lag[held])
        repeated = (nearest < _FAR)[number]
        back = np.sort(order[repeated])
        place, name = place[back], name[back]
        # the name of twice as many words: where they end in the text and both halves occur again
        after = np.searchsorted(place, place + w)
        whole = after < len(place)
        whole[whole] = place[after[whole]] == place[whole] + w
        whole &= place + 2 * w <= ends[place]
        _, numbers = np.unique(name, return_inverse=True)
        name = numbers[whole].astype(np.int64) * (len(numbers) + 1) + numbers[after[whole]]
        place, w = place[whole], 2 * w
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, lag = np.concatenate(places), np.concatenate(lags)
    order = np.lexsort((lag, place))
    return place[order], lag[order]


def _matching(names: np.ndarray, at: int, lag: int, stop: int, step: int) -> int:
    """The first place from ``at`` on towards ``stop`` (not reached) whose name differs from that ``lag`` before."""
    block = 16
    while at != stop:
        size = min(block, abs(stop - at))
        low = at if step > 0 else at - size + 1
        differ = names[low : low + size] != names[low - lag : low - lag + size]
        if differ.any():
            return low + int(differ.argmax()) if step > 0 else low + size - 1 - int(differ[::-1].argmax())
        at, block = at + step * size, 2 * block
    return stop


def _is_smallest(names: np.ndarray, start: int, end: int, period: int) -> bool:
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            q = period // prime
            if (names[start : end - q] == names[start + q : end]).all():
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def runs_by_diagonals(names: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, Run]]:
    """(text, run) of texts laid end to end: text t holds the words bounds[t] to bounds[t + 1]."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    place, lag = lags_named(names, ends)
    text = np.searchsorted(bounds, place, "right") - 1
    active: dict[int, int] = {}  # lag -> where its last diagonal ends
    for i, p, t in zip(place.tolist(), lag.tolist(), text.tolist()):
        if active.get(p, -1) > i:
            continue
        low, high = int(bounds[t]), int(bounds[t + 1])
        end = _matching(names, i, p, high, 1)
        begin = _matching(names, i, p, low + p - 1, -1) + 1
        active[p] = end
        length = end - begin + p
        if length >= max(LEAST_LENGTH, LEAST_POWER * p) and _is_smallest(names, begin - p, end, p):
            yield t, (begin - p - low, length, p)


def _runs_of_words(words: list[bytes]) -> list[Run]:
    known: dict[bytes, int] = {}
    names = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    return sorted(r for _, r in runs_by_diagonals(names, np.array([0, len(words)])))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words outside the repeated parts of the runs, joined by one space."""
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


def runs_of_texts(texts: pa.Array) -> list[tuple[list[Run], bytes]]:
    """Runs by start and period, and the collapsed text, of each text."""
    out = []
    for segment in segments(texts, whole=True):
        starts, ends, piece = spans(segment, BLANKS)
        bounds = np.searchsorted(piece, np.arange(len(segment.rows) + 1))
        h = Hasher(segment.data).of(starts, ends)
        _, names = np.unique(mixed(h + piece.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)
        found: dict[int, list[Run]] = {}
        for t, run in runs_by_diagonals(names.astype(np.int64), bounds):
            found.setdefault(t, []).append(run)
        cuts = [*segment.starts.tolist(), len(segment.data)]
        raw = segment.data.tobytes()
        for t in range(len(segment.rows)):
            words, runs = raw[cuts[t] : cuts[t + 1]].split(), sorted(found.get(t, []))
            if any(words[s : s + n - q] != words[s + q : s + n] for s, n, q in runs):
                runs = _runs_of_words(words)  # two words share a hash
            out.append((runs, collapsed(words, runs) if runs else b" ".join(words)))
    return out


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, runs, collapsed): each row, its runs by start and period, and its text without the repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = runs_of_texts(batch.column("text"))
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r, _ in got]
            texts = pa.array([c for _, c in got], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(runs, _RUNS), texts], ["row", "runs", "collapsed"])

    held = rows_held(docs).withColumn("text", F.col("row")[text])
    runs = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = held.drop("text").schema.add("runs", runs).add("collapsed", "string")
    return held.mapInArrow(run, schema)


def longest_run(runs: Column) -> Column:
    """The run of greatest length, then smallest start, then smallest period; NULL without runs."""
    # runs come by start and period, so the first of equal length stays
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, r: F.when(r["length"] > a["length"], r).otherwise(a))


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text), a tenth of the texts, by a hash of doc_id, with a tail that repeats some of its words.

    A text without words and a row without doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    with_words = docs.select("doc_id", "text", g.alias("g"), F.when(chosen, words).alias("words"))
    n = F.size("words")
    a = F.col("g") % n
    with_start = with_words.withColumn("a", F.when(n > 0, a).cast("int"))
    period = (F.floor((n - F.col("a")) / (3 + F.col("g") % 8)) + 1).cast("int")
    cut = with_start.withColumn("p", period)
    tail = F.slice("words", F.col("a") + 1, F.least(F.col("p"), n - F.col("a")))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(tail, times)), F.lit(1), n - F.col("a"))
    new = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), repeated), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), new).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The longest run of each row and hashes of its runs and of its collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    held = found.select(F.col("row.doc_id").alias("doc_id"), "runs", "collapsed", longest_run(F.col("runs")).alias("best"))
    return held.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def periodic(docs: DataFrame) -> DataFrame:
    """The digest columns of all documents, a tenth of them with a tail that repeats."""
    return digests(with_runs(looped(docs.select("doc_id", "text"))))
