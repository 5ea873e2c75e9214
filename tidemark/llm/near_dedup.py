"""Near-duplicate texts by order MinHash and banded alignment.

A text is a sequence of five-word shingles, each labelled with how often it
occurred before, so labels are unique within a text. Each of ``FUNCTIONS`` hash
functions samples the ``KEPT`` smallest labelled shingles and keeps their order
in the text: two texts agree where they share those shingles in the same order,
which follows edit similarity rather than bags of words. ``ROWS`` such samples
make a band; texts that agree in a band are candidates.

A candidate pair is verified by a banded alignment of the labelled shingles.
With L aligned shingles the similarity is L / (n_a + n_b - L); at the threshold
no aligned pair lies farther off the diagonal than the shingles that may be
missing, which is the width of the band. As labels are unique, the alignment is
the longest increasing run of matched places.

Groups of copies are never expanded to pairs. Texts of equal words are one class
from the start. In each bucket every member is compared with one centre, the
member that shares most buckets; links give components. Only members that are
still in another component than others of their bucket are compared with those,
in blocks. So no link between members of a bucket is lost, and work follows
what is unresolved.

Defined results: a text without words (also NULL or empty) is a class of its
own; a text of fewer than five words is one shingle; of repeated rows with equal
doc_id and text one is kept; an empty table gives no rows; further columns pass
through ``deduplicated`` untouched.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.common import map_batches
from tidemark.llm.components import components
from tidemark.llm.url_filter import MAX_FILTER_BYTES, Level, _low, low_bits
from tidemark.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
KEPT = 2  # shingles that one hash function samples
ROWS = 3  # samples in a band
BANDS = 32  # a pair at the threshold meets in none of them once in about 15,000
FUNCTIONS = ROWS * BANDS
MINOR_BLOCK, MEMBER_BLOCK = 128, 512  # members of a bucket that meet in one group
_PLACE = np.uint64((1 << 24) - 1)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
FILTER_BITS = 8 * MAX_FILTER_BYTES // 8  # 8 MB


def _odds(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def shingles(segment: words.Segment) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labelled shingles of a segment's texts, where each text's begin, its piece and the hash of all its words."""
    lower = words.LOWER[segment.data]
    starts, ends, piece = words.spans(segment, words.BLANKS)
    none = np.zeros(0, np.int64)
    if len(starts) == 0:
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    hashed = words.Hasher(lower).of(starts, ends)
    first = np.flatnonzero(np.diff(piece, prepend=-1))
    n = np.diff(np.append(first, len(piece)))
    # sums with a weight by place make the shingle depend on the order of its words
    weights = _odds(SHINGLE, 31)
    summed = hashed * weights[0]
    for d in range(1, SHINGLE):
        same = piece[d:] == piece[:-d]
        summed[:-d] += np.where(same, hashed[d:] * weights[d], np.uint64(0))
    left = np.repeat(first + n, n) - np.arange(len(piece))  # words from here to the text's end
    begins = (left >= SHINGLE) | (np.arange(len(piece)) == np.repeat(first, n))
    made, of = words.mixed(summed[begins]), piece[begins]
    order = np.lexsort((made, of))
    same = np.append(False, (made[order][1:] == made[order][:-1]) & (of[order][1:] == of[order][:-1]))
    run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = run
    labelled = words.mixed(made + occurrence * np.uint64(0x9E3779B97F4A7C15))
    begin = np.flatnonzero(np.diff(of, prepend=-1))
    # the hash of a text's word sequence, from the words before they are grouped
    place = (np.arange(len(piece)) - np.repeat(first, n)).astype(np.uint64)
    whole = np.add.reduceat(words.mixed(hashed + place * np.uint64(0xD1B54A32D192ED03)), first)
    return labelled, begin, piece[first], whole


def sketches(labelled: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of the ordered sample of each function for each text [texts, FUNCTIONS]."""
    counts = np.diff(np.append(begin, len(labelled)))
    place = np.minimum((np.arange(len(labelled)) - np.repeat(begin, counts)).astype(np.uint64), _PLACE)
    out = np.empty((len(begin), FUNCTIONS), np.uint64)
    value = np.empty_like(labelled)
    for f, odd in enumerate(_odds(FUNCTIONS, 32)):
        np.multiply(labelled, odd, out=value)
        value &= ~_PLACE
        value |= place
        lowest = np.minimum.reduceat(value, begin)
        value[value == np.repeat(lowest, counts)] = _TOP
        second = np.minimum.reduceat(value, begin)
        swap = (second & _PLACE) < (lowest & _PLACE)
        a = np.where(swap, second, lowest) >> np.uint64(24)
        b = np.where(swap, lowest, second) >> np.uint64(24)
        out[:, f] = words.mixed(a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(f))
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    weights = _odds(FUNCTIONS, 33).reshape(BANDS, ROWS)
    return words.mixed((sketch.reshape(-1, BANDS, ROWS) * weights).sum(2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Similarity by banded alignment; 0 where it lies below the threshold."""
    n, m = len(a), len(b)
    if min(n, m) < threshold * max(n, m):
        return 0.0
    _, i, j = np.intersect1d(a, b, return_indices=True)
    if len(i) / (n + m - len(i)) < threshold:
        return 0.0
    width = (n + m) * (1 - threshold) / (1 + threshold)  # at most so many shingles have no partner
    near = np.abs(i - j) <= width + 1e-6
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if len(j) and (np.diff(j) > 0).all():
        aligned = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        aligned = len(tails)
    found = aligned / (n + m - aligned)
    return found if found >= threshold else 0.0


def _read(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, a, b, n, bands) per row; a and b hash the words, n is 0 without words. Bands are NULL then."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            size = batch.num_rows
            a, b, n = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
            bands = np.zeros((size, BANDS), np.int64)
            for segment in words.segments(batch.column("text"), whole=True):
                labelled, begin, piece, whole = shingles(segment)
                if len(labelled) == 0:
                    continue
                at = segment.rows[piece]
                n[at] = np.diff(np.append(begin, len(labelled)))
                bands[at] = band_keys(sketches(labelled, begin))
                a[at] = whole.view(np.int64)
                # a second hash, from the shingles; both with the length make equal words
                b[at] = np.add.reduceat(words.mixed(labelled), begin).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[n > 0].ravel()))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tag"), pa.array(a), pa.array(b), pa.array(n), lists], ["doc_id", "tag", "a", "b", "n", "bands"]
            )

        return step

    tagged = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    return map_batches(tagged, make, "doc_id bigint, tag bigint, a bigint, b bigint, n bigint, bands array<bigint>")


def _members_filter(nodes: DataFrame) -> Level:
    """A Bloom filter of fixed size over (a, b): it only saves moving texts that no candidate needs."""
    at = F.explode(F.array(*[F.pmod(_low(F.col("a")) + i * _low(F.col("b")), F.lit(FILTER_BITS)) for i in range(3)]))
    bits = nodes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v")
    ).toArrow()
    held = np.zeros(FILTER_BITS // 64, np.uint64)
    held[bits["w"].to_numpy()] = bits["v"].to_numpy().astype(np.int64).view(np.uint64)
    return Level(held, FILTER_BITS, 3)


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the given classes (node, low, a, b), read from the documents once more."""
    wanted = _members_filter(nodes)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, a, b, held = [], [], [], []
            for segment in words.segments(batch.column("text"), whole=True):
                labelled, begin, piece, whole = shingles(segment)
                if len(labelled) == 0:
                    continue
                other = np.add.reduceat(words.mixed(labelled), begin)
                found = wanted.has(low_bits(whole.view(np.int64)), low_bits(other.view(np.int64)))
                ends = np.append(begin[1:], len(labelled))
                for i in np.flatnonzero(found):
                    rows.append(segment.rows[piece[i]])
                    a.append(int(whole[i].view(np.int64)))
                    b.append(int(other[i].view(np.int64)))
                    held.append(labelled[begin[i] : ends[i]].astype(np.uint32).tobytes())
            doc_id = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays(
                [doc_id, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(held, pa.binary())], ["doc_id", "a", "b", "shingles"]
            )

        return step

    read = map_batches(docs.select("doc_id", "text"), make, "doc_id bigint, a bigint, b bigint, shingles binary").alias("t")
    met = read.join(nodes.alias("n"), F.expr("t.a = n.a and t.b = n.b and t.doc_id <=> n.low"))
    return met.select("n.node", "t.shingles")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose alignment reaches the threshold. A text travels once for each of its pairs as ``b``."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            left, right = batch.column("left"), batch.column("right")
            good = [
                similarity(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), threshold) > 0
                for x, y in zip(left, right)
            ]
            kept = batch.select(["a", "b"])
            return kept.filter(pa.array(good, pa.bool_()))

        return step

    seconds = texts.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    firsts = texts.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    held = pairs.join(seconds, "b").join(firsts, "a").select("a", "b", "left", "right")
    return map_batches(held, make, "a bigint, b bigint")


def _named(df: DataFrame, stars: DataFrame, node: str, name: str) -> DataFrame:
    """Add the component of a node; a node without links is its own."""
    labels = stars.select(F.col("node").alias(node), F.col("component").alias(name))
    return df.join(labels, node, "left").withColumn(name, F.coalesce(name, node))


def _crossed(open_: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members of one bucket that lie in different components.

    ``open_`` has (key, node, of, major). Members apart from the bucket's largest
    component meet all others, in blocks of bounded size; only links leave a
    block, one for each member and component.
    """
    minor = F.col("of") != F.col("major")
    sizes = open_.groupBy("key").agg(
        F.ceil(F.count_if(minor) / MINOR_BLOCK).cast("int").alias("minors"), F.ceil(F.count(F.lit(1)) / MEMBER_BLOCK).cast("int").alias("others")
    )
    held = open_.join(texts, "node").join(sizes, "key").withColumn("is_major", ~minor)

    def own(count: str):
        return F.pmod(F.xxhash64("node"), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    group, kept = ["key", "x", "y"], ["node", "of", "is_major", "shingles"]
    asking = held.where(minor).withColumn("x", own("minors")).withColumn("y", every("others")).select(*group, *kept)
    others = held.withColumn("y", own("others")).withColumn("x", every("minors"))
    others = others.select(*[F.col(c).alias(f"o_{c}") for c in (*group, *kept)])

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        members = [(n, of, major, np.frombuffer(t, np.uint32)) for n, of, major, t in zip(right.o_node, right.o_of, right.o_is_major, right.o_shingles)]
        for node, of, text in zip(left.node, left.of, left.shingles):
            mine, linked = np.frombuffer(text, np.uint32), {of}
            for other, other_of, is_major, theirs in members:
                if other_of not in linked and (is_major or node < other) and similarity(mine, theirs, threshold) > 0:
                    linked.add(other_of)
                    found.append((node, other))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    met = asking.groupBy(*group).cogroup(others.groupBy(*[f"o_{c}" for c in group]))
    return met.applyInPandas(meet, "a bigint, b bigint")


def _components_of(classes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of the classes that have a link."""
    members = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    starred = materialize(members.join(shared, "key").select("key", "band", "node", "size"), "buckets")
    # the text that the others of a group were made from shares most buckets with most of them: it makes the best centre
    central = starred.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = starred.join(central, "node")
    centres = weighed.groupBy("key").agg(F.max(F.struct("weight", F.xxhash64("node"), "node")).alias("top"))
    starred = materialize(starred.join(centres.select("key", F.col("top.node").alias("centre")), "key"), "stars")
    used = classes.join(starred.select("node").distinct(), "node", "left_semi").select("node", "low", "a", "b")
    texts = materialize(_texts_of(docs, used), "candidate-texts")

    rays = starred.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    links = materialize(_verified(rays.distinct(), texts, threshold), "verified")
    stars = components(links)
    # members that are apart from the largest component of their bucket meet all others there
    placed = _named(starred.where("size > 2"), stars, "node", "of")
    parts = placed.groupBy("key", "of").agg(F.count(F.lit(1)).alias("n"))
    major = parts.groupBy("key").agg(F.max(F.struct("n", "of")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    open_ = placed.where("node != centre").join(major.select("key", F.col("top.of").alias("major")), "key")
    more = materialize(_crossed(open_.select("key", "node", "of", "major"), texts, threshold), "crossed")
    if more.isEmpty():
        return stars
    return components(links.unionByName(more))


def grouped(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, tag (hash of the text), class_id, kept and times per row of docs (doc_id, text).

    class_id is the smallest doc_id of the class; ``kept`` marks its row; ``times``
    counts rows of this doc_id and text. A NULL doc_id counts as larger than all.
    """
    rows = materialize(_read(docs), "shingled")
    worded = rows.where("n > 0")
    classes = worded.groupBy("a", "b", "n").agg(F.min("doc_id").alias("low"), F.first("bands").alias("bands"))
    # the number is written with its row and so the same for all readers
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "text-classes")
    stars = _components_of(classes, docs, threshold)
    placed = _named(classes.select("node", "a", "b", "n", "low"), stars, "node", "of")
    # the kept row: the smallest doc_id, then the smallest class and text hash
    per_row = rows.groupBy("a", "b", "n", "doc_id", "tag").agg(F.count(F.lit(1)).alias("times"))
    joined = per_row.alias("r").join(placed.alias("p"), F.expr("r.n > 0 and r.a = p.a and r.b = p.b and r.n = p.n"), "left")
    found = joined.select("r.doc_id", "r.tag", "r.times", F.col("p.of").alias("of"))
    found = materialize(found, "placed-rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag"))
    lead = found.where("of is not null").groupBy("of").agg(best.alias("lead")).select(F.col("of").alias("lead_of"), "lead")
    named = found.join(lead, F.col("of") == F.col("lead_of"), "left")
    alone = F.col("of").isNull()
    return named.select(
        "doc_id", "tag",
        F.when(alone, F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("class_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("tag") == F.col("lead.tag")))).alias("kept"),
        F.when(alone, F.lit(1)).otherwise(F.col("times")).alias("times"), F.col("times").alias("rows"),
    )


def classes_of(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, kept for each row; of repeated rows one is kept."""
    found = grouped(docs, threshold)
    each = found.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    once = (F.col("nth") == 1) | (F.col("times") == 1)
    return each.select("doc_id", "class_id", (F.col("kept") & once).alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of which one stays for each class, with all their columns."""
    found = grouped(docs.select("doc_id", "text"), threshold).where("kept").select("doc_id", "tag", "times")
    kept = materialize(found, "kept-rows").alias("k")
    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).withColumn("tag", F.xxhash64("row.text"))
    met = held.alias("d").join(kept, F.expr("d.tag = k.tag and d.row.doc_id <=> k.doc_id"))
    single = met.where("times = 1").select("d.row")
    # repeated rows: any one of each
    again = met.where("times > 1").groupBy("k.doc_id", "k.tag").agg(F.first("d.row").alias("row")).select("row")
    return single.unionByName(again).select("row.*")
