"""Invertible Bloom lookup sketches of a document's paragraphs.

A document's keys are the digests of its paragraphs (lines), each hashed with
its occurrence number, so repeated paragraphs count. A sketch is three tables
of cells; a key adds 1 to the count and is XORed, with its check hash, into one
cell of each table. Subtracting two sketches cancels what both texts hold.
Cells left with one key are peeled in rounds until none is left, which recovers
exactly the differing digests. Where peeling gets stuck, the pair is tried again
with sixteen times as many sketches, each for its share of the keys.

The next document is found on doc_id and a hash of the text alone; a text then
travels once, and the part of it that the document before takes once more. Keys,
cells and peeling are rows that Spark groups, never lists searched key by key, so
a text of any number of lines costs in proportion to it.

The likeness of two fingerprints is (shared keys) / (all keys of both).
DataFrame functions only.

Defined results: a NULL text is empty; an empty text has one empty paragraph; a
sole document is its own next document; rows with one doc_id follow each other by
the hash of their texts, equal rows one by one; equal texts have equal
fingerprints and likeness 1; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sliced import next_row
from tidemark.session import materialize

TABLE_CELLS = 32  # cells in each of the three tables
GROWTH = 16  # sketches of a pair are multiplied so at each retry; empty cells cost nothing
MAX_TRIES = 10
ROUNDS = 4  # of peeling in one try
PART_KEYS = 100_000  # keys whose cells one task holds
ROW = ["d", "t", "v"]  # doc_id (0 for NULL), hash of the text and of whether doc_id is there, which copy


def digests(text: Column) -> Column:
    """A digest for each paragraph."""
    return F.transform(F.split(text, "\n"), lambda p: F.xxhash64(p))


def _check(key: Column) -> Column:
    return F.xxhash64(F.lit(7), key)


def cell_numbers(key: Column) -> Column:
    """The key's cell in each table, as numbers over all three."""
    h = F.xxhash64(F.lit(11), key)
    return F.array(*[
        (F.lit(t * TABLE_CELLS) + F.pmod(F.shiftright(h, 16 * t), F.lit(TABLE_CELLS))).cast("int") for t in range(3)
    ])


def with_next(docs: DataFrame) -> DataFrame:
    """(d, t, v, times, doc_id, text, n_chars, taken, next_digests) for each row of (doc_id, text).

    ``taken`` is the start of the next document's text, as long as a quarter of
    this one; equal rows are one row, met ``times``, before the row that follows
    them (v = 0) or before a copy (v = 1).
    """
    text = F.coalesce("text", F.lit(""))
    t = F.xxhash64(text, F.col("doc_id").isNull())
    held = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("d"), t.alias("t"), "doc_id", text.alias("text"))
    counted = held.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("times"), F.max(F.length("text")).alias("n"))
    ordered = materialize(next_row(counted, [], ["doc_id", "t"], ["doc_id", "t"], "next"), "next-documents")
    lowest = ordered.agg(F.min(F.struct("doc_id", "t")).alias("low")).scalar()
    following = F.coalesce("next", lowest)
    named = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    takes = ordered.select(
        named(following["doc_id"]).alias("d"), following["t"].alias("t"), named(F.col("doc_id")).alias("before_d"),
        F.col("t").alias("before_t"), F.floor(F.col("n") / 4).cast("int").alias("asked"),
    )
    times = ordered.select(named(F.col("doc_id")).alias("d"), "t", "doc_id", "times")
    # the same columns for both readers: they share one shuffle of the texts
    texts = held.select("d", "t", "text").groupBy("d", "t").agg(F.first("text").alias("text"))
    given = texts.join(takes, ["d", "t"]).select(
        F.col("before_d").alias("d"), F.col("before_t").alias("t"),
        F.substring("text", F.lit(1), F.col("asked")).alias("taken"), digests(F.col("text")).alias("next_digests"),
    )
    joined = texts.join(times, ["d", "t"]).join(given, ["d", "t"]).withColumn("n_chars", F.length("text"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    last = F.struct(F.lit(0).alias("v"), F.lit(1).cast("long").alias("times"), "taken", "next_digests")
    copies = F.struct(
        F.lit(1).alias("v"), (F.col("times") - 1).alias("times"),
        F.substring("text", F.lit(1), quarter).alias("taken"), digests(F.col("text")).alias("next_digests"),
    )
    cases = F.explode(F.when(F.col("times") > 1, F.array(last, copies)).otherwise(F.array(last))).alias("case")
    return joined.select("d", "t", "doc_id", "text", "n_chars", cases).select("d", "t", "doc_id", "text", "n_chars", "case.*")


def with_edited(rows: DataFrame) -> DataFrame:
    """Add the text with its last quarter taken from the next document's start."""
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    return rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - quarter), F.col("taken")))


# versions of a text, and the pairs that are compared
OWN, EDITED, NEXT = range(3)
#: by version: the pairs (of OWN with it) that it takes part in, and its sign there
_PAIRS = {OWN: [(EDITED, 1), (NEXT, 1)], EDITED: [(EDITED, -1)], NEXT: [(NEXT, -1)]}


def _pairs_of(version: Column) -> Column:
    listed = {v: F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(s).alias("sign")) for p, s in u]) for v, u in _PAIRS.items()}
    return F.when(version == OWN, listed[OWN]).when(version == EDITED, listed[EDITED]).otherwise(listed[NEXT])


def keys_of(found: DataFrame, group: list[str]) -> DataFrame:
    """(group, key): a key for each digest of a group, hashed with how often it came before."""
    counted = found.groupBy(*group, "digest").agg(F.count(F.lit(1)).cast("int").alias("n"))
    numbered = counted.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return numbered.select(*group, F.xxhash64("digest", "i").alias("key"))


def _cells(keys: DataFrame, group: list[str], sign: Column) -> DataFrame:
    """Sketch cells per group from rows of (group, key), added or taken by their sign; nonzero ones."""
    cells = (
        keys.withColumn("cell", F.explode(cell_numbers(F.col("key"))))
        .groupBy(*group, "cell")
        .agg(F.sum(sign).alias("c"), F.bit_xor("key").alias("k"), F.bit_xor(_check(F.col("key"))).alias("h"))
    )
    return cells.where("c != 0 or k != 0 or h != 0")


_KEY, _FOUND = -1, -2  # in place of a cell: a key to take out, the number of keys taken out


def _peeled_once(cells: DataFrame, group: list[str]) -> DataFrame:
    """The cells after every key that lies alone in some cell is taken out of all its cells."""
    itself = F.struct("cell", "c", "k", "h")
    pure = (F.col("cell") >= 0) & (F.abs("c") == 1) & (F.col("h") == _check(F.col("k")))
    alone = F.struct(F.lit(_KEY).alias("cell"), "c", "k", "h")
    told = cells.select(*group, F.explode(F.when(pure, F.array(itself, alone)).otherwise(F.array(itself))).alias("x")).select(*group, "x.*")
    # a key may lie alone in two or three cells and goes once
    once = told.groupBy(*group, "cell", "k", "h").agg(F.max("c").alias("c"))
    at = cell_numbers(F.col("k"))
    zero = F.lit(0).cast("long")
    out = [F.struct(F.get(at, F.lit(i)).alias("cell"), (-F.col("c")).alias("c"), "k", "h") for i in range(3)]
    tally = F.struct(F.lit(_FOUND).alias("cell"), F.lit(1).cast("long").alias("c"), zero.alias("k"), zero.alias("h"))
    left = once.select(*group, F.explode(F.when(F.col("cell") == _KEY, F.array(*out, tally)).otherwise(F.array(itself))).alias("x"))
    after = left.select(*group, "x.*").groupBy(*group, "cell").agg(F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
    return after.where("c != 0 or k != 0 or h != 0")


def peeled(cells: DataFrame, group: list[str]) -> DataFrame:
    """(group, found, done): how many keys come out and whether no cell is left; a group without cells has no row."""
    for _ in range(ROUNDS):
        cells = _peeled_once(cells, group)
    found = F.sum(F.when(F.col("cell") == _FOUND, F.col("c")).otherwise(0))
    return cells.groupBy(*group).agg(found.alias("found"), (F.count_if(F.col("cell") >= 0) == 0).alias("done"))


def _text_of(cells: Column) -> Column:
    """A sketch as text: cell.count.key.check in hexadecimal, by cell."""
    return F.array_join(
        F.transform(cells, lambda x: F.concat_ws(".", F.hex(x["cell"].cast("long")), F.hex(x["c"]), F.hex(x["k"]), F.hex(x["h"]))), ";"
    )


def _likeness(differing: Column, total: Column) -> Column:
    """Shared keys over all keys, from the number of differing keys and the sum of both counts."""
    shared = (total - differing) / 2
    return F.when(total == 0, 1.0).otherwise(shared / (total - shared))


def _tasks(keys: int) -> int:
    """A set number of tasks: the keys of few bytes grow to many cells, which sizes in bytes do not show."""
    return max(1, -(-keys // PART_KEYS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_edited(with_next(docs)).select(
        *ROW, "times", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.array(digests(F.col("text")), digests(F.col("edited")), F.col("next_digests")).alias("digests"),
    )
    # what follows works on the digests
    rows = materialize(rows, "paragraph-digests")
    size = [F.size(F.get("digests", F.lit(v))) for v in (OWN, EDITED, NEXT)]
    total = rows.agg(F.sum(size[0] + size[1] + size[2]).alias("n")).first()["n"] or 0
    placed = rows.select(*ROW, "digests").repartition(_tasks(total), *ROW)
    versions = placed.select(*ROW, F.posexplode("digests").alias("version", "list"))
    keys = keys_of(versions.select(*ROW, "version", F.explode("list").alias("digest")), [*ROW, "version"])
    sketches = _cells(keys.where(F.col("version") != NEXT), [*ROW, "version"], F.lit(1).cast("long"))
    listed = F.array_sort(F.collect_list(F.struct("cell", "c", "k", "h")))
    texts = sketches.groupBy(*ROW, "version").agg(_text_of(listed).alias("text"))
    texts = texts.groupBy(*ROW).agg(
        *[F.max(F.when(F.col("version") == v, F.col("text"))).alias(c) for v, c in ((OWN, "fingerprint"), (EDITED, "edited_fingerprint"))]
    )
    signed = keys.withColumn("use", F.explode(_pairs_of(F.col("version")))).select(*ROW, "use.*", "key")
    read = materialize(peeled(_cells(signed, [*ROW, "pair"], F.col("sign").cast("long")), [*ROW, "pair"]), "peeled")
    differing = read.where("done").drop("done").unionByName(_retried(rows, read.where("not done").select(*ROW, "pair")))
    differing = differing.groupBy(*ROW).agg(
        *[F.sum(F.when(F.col("pair") == p, F.col("found")).otherwise(0)).alias(c) for p, c in ((EDITED, "e"), (NEXT, "x"))]
    )
    named = dict(zip(("n_own", "n_edited", "n_next"), size))
    out = rows.withColumns(named).drop("digests").join(texts, ROW).join(differing, ROW, "left")
    e, x = F.coalesce("e", F.lit(0)), F.coalesce("x", F.lit(0))
    out = out.withColumn("near_edited", _likeness(e, F.col("n_own") + F.col("n_edited")))
    out = out.withColumn("near_next", _likeness(x, F.col("n_own") + F.col("n_next")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def _retried(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """(d, t, v, pair, found) of the failed pairs, whose keys go to ever more sketches until all peel.

    A share of the keys that peels is done; the keys of the others are dealt again.
    """
    group = [*ROW, "pair"]
    done = failed.where("false").withColumn("found", F.lit(0).cast("long"))
    count = failed.join(rows, ROW).agg(F.sum(F.size(F.flatten("digests"))).alias("n")).first()["n"]
    if count is None:
        return done
    placed = failed.join(rows.select(*ROW, "digests"), ROW).repartition(_tasks(count), *ROW)
    sides = placed.select(
        *group,
        F.explode(F.array(
            F.struct(F.lit(1).alias("sign"), F.get("digests", F.lit(OWN)).alias("list")),
            F.struct(F.lit(-1).alias("sign"), F.get("digests", F.col("pair")).alias("list")),
        )).alias("side"),
    ).select(*group, "side.sign", F.explode("side.list").alias("digest"))
    keys = materialize(keys_of(sides, [*group, "sign"]), "keys-to-retry")
    parts, failed = 1, failed.withColumn("part", F.lit(0))
    for _ in range(MAX_TRIES):
        dealt = F.xxhash64(F.lit(13), "key")
        open_ = keys.withColumn("part", F.pmod(dealt, F.lit(parts)).cast("int")).join(failed, [*group, "part"], "left_semi")
        parts *= GROWTH
        cells = _cells(open_.withColumn("part", F.pmod(dealt, F.lit(parts)).cast("int")), [*group, "part"], F.col("sign").cast("long"))
        tried = materialize(peeled(cells, [*group, "part"]), "retried")
        done = done.unionByName(tried.where("done").groupBy(*group).agg(F.sum("found").alias("found")))
        failed = tried.where("not done").select(*group, "part")
        if failed.isEmpty():
            return done
    raise RuntimeError("sketches do not peel: two different keys share their hashes")
