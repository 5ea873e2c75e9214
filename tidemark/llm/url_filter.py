"""URL rules held in a cascade of Bloom filters.

A rule is (host, path, action); it fits its host and all subdomains where the
url's path starts with the rule's. Every rule and every (host suffix, path
prefix) of a page is a key. Level 0 of a cascade encodes the listed keys, level
1 the corpus keys that level 0 takes for listed, level 2 the listed keys that
level 1 takes for false positives, and so on until a level has none left. Over
the corpus's whole key universe the number of levels passed then gives exact
membership, so pages are judged by bit tests alone, without a join.

One cascade is built for the allowing and one for the blocking rules. The
longest listed key of a url is its rule; a url without a listed key is allowed.

Defined results: a NULL url or one without ``://`` has an empty host and path
and no keys; repeated urls are judged alike; a rule listed with both actions
blocks; rules with an empty host or a path that does not start with ``/`` can
fit nothing and are left out; empty tables and empty rule lists work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_batches
from tidemark.session import materialize

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
RULE_SCHEMA = "host string, path string, action string"
FALSE_RATE = 1 / 1024  # of level 0; later levels use a half
MAX_FILTER_BYTES = 64 << 20  # a cascade is shipped to every worker only below this
MAX_LEVELS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_hashes(key: Column) -> Column:
    """The two hashes that all bit positions of a key follow from."""
    return F.struct(F.xxhash64(F.lit(1), key).alias("a"), F.xxhash64(F.lit(2), key).alias("b"))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys of a url that a rule could list, longest first.

    ``lengths`` are the path lengths that occur among the rules.
    """
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    suffixes = F.filter(suffixes, lambda h: h != "")
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length(path))
    keys = F.flatten(
        F.transform(suffixes, lambda h: F.transform(fitting, lambda n: F.concat(h, F.substring(path, F.lit(1), n))))
    )
    longest_first = F.array_sort(
        F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(longest_first, lambda s: s["k"]))


@dataclass(frozen=True)
class Level:
    words: np.ndarray  # the bits, 64 to a word
    bits: int
    hashes: int

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.ones(len(a), bool)
        for i in range(self.hashes):
            at = (a + np.uint64(i) * b) % np.uint64(self.bits)
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


@dataclass(frozen=True)
class Cascade:
    levels: list[Level]

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact for listed keys and for all keys of the corpus it was built on."""
        passed = np.zeros(len(a), np.int64)
        going = np.arange(len(a))
        for level in self.levels:
            going = going[level.has(a[going], b[going])]
            passed[going] += 1
        return passed % 2 == 1


def _shape(n: int, rate: float, number: int) -> tuple[int, int]:
    """Bits and hash functions for n keys at a false positive rate.

    Each level has a size of its own, so keys that meet in all bits of one level part in another.
    """
    hashes = max(1, round(-np.log2(rate)))
    return max(64, int(np.ceil(n * hashes / np.log(2)))) + number, hashes


def build_level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """One Bloom filter over the ``h`` column of ``keys``: bits are joined per word on the executors."""
    bits, hashes = _shape(n, rate, number)
    if bits // 8 > MAX_FILTER_BYTES:
        raise OverflowError(f"a level of {bits // 8} bytes")
    # double hashing on 63 bits; both sides of the library use the same arithmetic
    at = F.explode(F.array(*[F.pmod(_low(F.col("h.a")) + i * _low(F.col("h.b")), F.lit(bits)) for i in range(hashes)]))
    words = (
        keys.select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v"))
    )
    held = np.zeros((bits + 63) // 64, np.uint64)
    got = words.toArrow()
    held[got["w"].to_numpy()] = got["v"].to_numpy().astype(np.int64).view(np.uint64)
    return Level(held, bits, hashes)


def _low(c: Column) -> Column:
    """The low 56 bits: sums of a few of them stay below 2^63."""
    return c.bitwiseAND(F.lit((1 << 56) - 1))


def low_bits(h: np.ndarray) -> np.ndarray:
    return (h & ((1 << 56) - 1)).astype(np.uint64)


def _passing(keys: DataFrame, levels: list[Level]) -> DataFrame:
    """Rows of (key, h) that pass every given level."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            h = batch.column("h")
            a, b = (low_bits(h.field(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            keep = np.ones(len(a), bool)
            for level in levels:
                keep &= level.has(a, b)
            return batch.filter(pa.array(keep))

        return step

    return map_batches(keys.select("key", "h"), make, "key string, h struct<a: bigint, b: bigint>")


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade for ``listed`` (key, h) over ``universe`` (key, h).

    Universe keys that pass a level are few by design; only those are made
    distinct, compared with the list and written for the next level.
    """
    inside = materialize(listed.dropDuplicates(["key"]), "url-listed")
    n_inside = inside.count()
    if n_inside == 0:
        return Cascade([])
    levels = [build_level(inside, n_inside, FALSE_RATE, 0)]
    wrong = _passing(universe, levels).dropDuplicates(["key"]).join(inside.select("key"), "key", "left_anti")
    encoded, other = inside, materialize(wrong, "url-wrong")
    n_other = other.count()
    while n_other:
        if len(levels) >= MAX_LEVELS:
            raise RuntimeError("the cascade does not end: two keys share both hashes")
        levels.append(build_level(other, n_other, 0.5, len(levels)))
        encoded, other = other, materialize(_passing(encoded, levels[-1:]), "url-wrong")
        n_other = other.count()
    return Cascade(levels)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def _judged(pages: DataFrame, cascades: dict[str, Cascade]) -> DataFrame:
    """Add ``rule``, the first listed key of ``keys``, and ``verdict``, its action."""
    schema = T.StructType(pages.schema.fields + [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, hashes = batch.column("keys"), batch.column("hashes")
            flat = hashes.flatten()
            a, b = (low_bits(flat.field(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            block = cascades["block"].has(a, b)
            listed = np.flatnonzero(block | cascades["allow"].has(a, b))
            lengths = np.diff(keys.offsets.to_numpy())
            ends = np.cumsum(lengths)
            at = np.searchsorted(listed, ends - lengths)  # the first listed key at or after each row's start
            first = np.append(listed, len(a))[at]
            found = first < ends
            first = np.where(found, first, 0)
            texts = keys.flatten()
            rule = texts.take(pa.array(first, mask=~found)) if len(texts) else pa.nulls(batch.num_rows, pa.string())
            blocked = np.append(block, False)[first] & found
            verdict = pa.array(np.where(blocked, "block", "allow"), pa.string())
            return pa.RecordBatch.from_arrays([*batch.columns, rule.cast(pa.string()), verdict], [*batch.schema.names, "rule", "verdict"])

        return step

    return map_batches(pages, make, schema)


def judged(pages: DataFrame, rules: DataFrame, id_column: str = "page_id") -> DataFrame:
    """One row per page: its id, host, path, rule and verdict."""
    spark = pages.sparkSession
    fits = (F.col("host") != "") & (F.col("path").startswith("/"))
    # one row per listed key; a key with both actions blocks
    named = rules.where(fits).withColumn("key", F.concat("host", "path"))
    named = named.groupBy("key").agg(F.max("action").alias("action"), F.max(F.length("path")).alias("n"))
    named = materialize(named.withColumn("h", key_hashes(F.col("key"))), "url-rules")
    lengths = sorted(r["n"] for r in named.select("n").distinct().collect())  # at most the longest path's length
    urls = pages.select(F.col(id_column).alias("page_id"), F.col("url"))
    parts = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("keys").alias("key")).withColumn("h", key_hashes(F.col("key")))
    try:
        cascades = {action: build_cascade(named.where(F.col("action") == action).select("key", "h"), universe) for action in ("allow", "block")}
    except OverflowError:
        return _joined(keyed, named)
    shipped = keyed.withColumn("hashes", F.transform("keys", key_hashes))
    return _judged(shipped, cascades).select("page_id", "host", "path", "rule", "verdict")


def _joined(keyed: DataFrame, named: DataFrame) -> DataFrame:
    """The same verdicts by a join, for rule lists whose filters exceed the size that may be shipped."""
    rows = keyed.withColumn("id", F.monotonically_increasing_id())
    rows = materialize(rows, "url-rows")
    hits = rows.select("id", F.explode("keys").alias("key")).join(named.select("key", "action"), "key")
    best = hits.groupBy("id").agg(F.min(F.struct((-F.length("key")).alias("n"), "key", "action")).alias("hit"))
    return rows.join(best, "id", "left").select(
        "page_id", "host", "path", F.col("hit.key").alias("rule"), F.coalesce("hit.action", F.lit("allow")).alias("verdict")
    )


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
ORACLE_SQL = f"""
with rules(rhost, rpath, action) as (values {_RULE_ROWS}),
p as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
m as (
  select page_id, rhost || rpath as rule, action,
         row_number() over (partition by page_id order by length(rhost || rpath) desc, rhost || rpath) as k
  from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select p.page_id, host, path, rule, coalesce(action, 'allow') as verdict
from p left join m on p.page_id = m.page_id and k = 1
"""
