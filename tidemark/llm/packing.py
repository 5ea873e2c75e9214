"""Best-fit packing of documents into bins under conflicts.

Documents go in order of falling size, each into the tightest open bin that has
room and no conflict; else a bin is opened. Open bins are ordered by residual
room and carry bitmaps of the sources and duplicate clusters they hold. A
document looks for the smallest residual not below its size and goes on to the
next larger one until a compatible bin is found: no bin holds two documents of
one duplicate cluster, nor more than ``per_source`` documents of one source.

A document larger than a bin is cut: its full pieces fill bins by themselves and
the rest is packed like a document, so nothing is dropped.

The table is dealt into shards of bounded size by a hash; each shard is packed
for itself. Shards share no bins, so the loss against one global packing is at
most the last few open bins of each shard.

Defined results: a text without words (also NULL) takes no room and is packed
with size 0; a NULL source is a source of its own; repeated rows are separate
pieces that share a cluster and so never a bin; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import rows_held, word_count

CAPACITY = 4096  # words in a bin
PER_SOURCE = 2  # documents of one source in a bin
SHARD_WORDS = 4_000_000
SHARD_ROWS = 20_000

PACKED = "shard bigint, bin bigint, doc_id bigint, piece bigint, size bigint, source string, cluster bigint"


class Bins:
    """Open bins of one shard, ordered by residual room.

    ``classes[residual]`` maps a bitmap of full sources to the bins of that
    residual which have it, so one test speaks for all of them; their cluster
    bitmaps are tested bin by bin. Bitmaps are integers with a bit per source
    or per cluster that occurs more than once in the shard.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.residuals: list[int] = []  # sorted, those with an open bin
        self.classes: dict[int, dict[int, list[int]]] = {}
        self.clusters: list[int] = []  # by bin
        self.full: list[int] = []  # by bin: sources that may not come again
        self.counts: list[dict[int, int]] = []

    def place(self, size: int, source: int, cluster: int | None) -> int:
        source_bit, cluster_bit = 1 << source, 0 if cluster is None else 1 << cluster
        found = self._successor(size, source_bit, cluster_bit)
        if found is None:
            number, residual = len(self.full), self.capacity
            self.clusters.append(0)
            self.full.append(0)
            self.counts.append({})
        else:
            residual, number = found
            self._remove(residual, number)
        counts = self.counts[number]
        counts[source] = counts.get(source, 0) + 1
        if counts[source] >= self.per_source:
            self.full[number] |= source_bit
        self.clusters[number] |= cluster_bit
        self._add(residual - size, number)
        return number

    def _successor(self, size: int, source_bit: int, cluster_bit: int) -> tuple[int, int] | None:
        for at in range(bisect_left(self.residuals, size), len(self.residuals)):
            residual, best = self.residuals[at], None
            for full, members in self.classes[residual].items():
                if full & source_bit:
                    continue
                number = next((b for b in members if not self.clusters[b] & cluster_bit), None)
                if number is not None and (best is None or number < best):
                    best = number
            if best is not None:
                return residual, best
        return None

    def _add(self, residual: int, number: int) -> None:
        if residual not in self.classes:
            insort(self.residuals, residual)
            self.classes[residual] = {}
        insort(self.classes[residual].setdefault(self.full[number], []), number)

    def _remove(self, residual: int, number: int) -> None:
        by_full = self.classes[residual]
        members = by_full[self.full[number]]
        del members[bisect_left(members, number)]
        if not members:
            del by_full[self.full[number]]
            if not by_full:
                del self.classes[residual]
                del self.residuals[bisect_left(self.residuals, residual)]


def pack_shard(pieces: pd.DataFrame, capacity: int, per_source: int) -> pd.Series:
    """The bin of each row of (size, source, cluster), placed in the rows' order."""
    sources = pd.factorize(pieces["source"], use_na_sentinel=False)[0]
    groups = pieces.groupby("cluster", dropna=False)["cluster"].transform("size")
    repeated = pieces["cluster"].where(groups > 1)
    clusters = pd.factorize(repeated)[0]  # -1 where nothing can clash
    bins = Bins(capacity, per_source)
    placed = [
        bins.place(size, source, None if cluster < 0 else cluster)
        for size, source, cluster in zip(pieces["size"].tolist(), sources.tolist(), clusters.tolist())
    ]
    return pd.Series(placed, index=pieces.index, dtype="int64")


def cut_pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """Add ``piece`` and its ``size``: full pieces first, then what is left."""
    last = F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0))
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return pieces.withColumn("size", F.least(F.lit(capacity).cast("bigint"), F.col("words") - F.col("piece") * capacity)).drop("words")


def packed(
    docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE,
    shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(shard, bin, doc_id, piece, size, source, cluster), a row per piece.

    The cluster of a document is the hash of its words, case and spacing aside.
    """
    row = F.col("row")
    spaced = F.regexp_replace(F.lower(F.coalesce(row["text"], F.lit(""))), r"\s+", " ")
    sized = rows_held(docs).select(
        row["doc_id"].alias("doc_id"), row["source"].alias("source"), word_count(row["text"]).alias("words"),
        F.xxhash64(F.trim(spaced)).alias("cluster"),
    )
    pieces = cut_pieces(sized, capacity)
    totals = sized.agg(
        F.greatest(F.ceil(F.coalesce(F.sum("words"), F.lit(0)) / shard_words), F.ceil(F.count(F.lit(1)) / shard_rows), F.lit(1)).alias("shards")
    ).scalar()
    spread = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "piece", "cluster")
    sharded = pieces.withColumn("shard", F.pmod(spread, totals))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        order = group.assign(name=group["doc_id"].fillna(-(2**62))).sort_values(
            ["size", "name", "piece", "cluster"], ascending=[False, True, True, True], kind="stable"
        )
        return order.assign(bin=pack_shard(order, capacity, per_source))[
            ["shard", "bin", "doc_id", "piece", "size", "source", "cluster"]
        ]

    return sharded.groupBy("shard").applyInPandas(pack, PACKED)
