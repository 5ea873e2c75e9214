"""Connected components by alternating star contractions.

Each round links every node's larger neighbours to the smallest node it knows
(large star), then its smaller neighbours and itself likewise (small star). The
graph stays as connected as it was and ends as stars around the smallest node of
each component, after about log2 of the longest path rounds. Minima are combined
before the shuffle, and joins on a hot centre are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

MAX_ROUNDS = 100


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b) that has a link to another node.

    The component is its smallest node; the smallest node itself is not a row.
    """
    a, b = F.col("a"), F.col("b")
    held = edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    held = materialize(held, "links")
    before = _signature(held)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        both = held.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            held.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("low").alias("lo"))
        large = large.where("hi != lo").distinct()
        lower = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = large.join(lower, "hi").select(
            F.explode(F.array(F.struct(F.col("hi"), F.col("low").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("low").alias("lo")))).alias("e")
        )
        held = materialize(small.select("e.*").where("hi != lo").distinct(), "links")
        after = _signature(held)
        if after == before:
            break
        before = after
    return held.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def local_stars(n: int, left, right):
    """Smallest node reachable from each of n nodes by the links (left, right), in numpy."""
    import numpy as np

    label = np.arange(n)
    if len(left) == 0:
        return label
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
