"""Near-duplicate vectors by product quantisation with exact bounds.

Equal vectors are made one class first. Coarse centroids and residual codebooks
are fitted on a bounded sample; every class is indexed: its inverted list, the
codes of its residual in each subspace and the length of what the codes miss.

Probes are sufficient by geometry: two partners in different lists lie on
opposite sides of the plane between the lists' centroids, and their distances to
it sum to at most the linking distance, so one of them is within half of it. A
vector probes its own list and those whose plane is within half the linking
distance. A pair that meets from both ends is compared by its lower node alone,
any other pair by the end that probes, and a link counts for both its ends.
Within a probed list the asymmetric table-lookup distance, less the length that
y's codes miss, is a lower bound of the true distance, so it excludes no link;
pairs it cannot exclude are compared by exact cosine in double precision.

Lists and their queries meet in blocks of bounded size, so a hot list becomes
many tasks. A block returns a count for each query and a spanning star of its
links, never the pairs.

Defined results: vectors that are NULL, zero, hold NULL or non-finite components
link with nothing, and vectors of different lengths never link; n_links counts
rows, so each copy counts; a row without links is its own component; rows that
share a vec_id are separate vectors; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches
from tidemark.llm.components import components, local_stars
from tidemark.session import materialize

THRESHOLD = 0.95
SAMPLE_ROWS = 20_000  # vectors that centroids and codebooks are fitted on
LIST_ROWS = 2048  # vectors that a list is meant to hold
MAX_LISTS = 1024
SUBSPACES = 8
CODEWORDS = 128
BLOCK = 4096  # members, and queries, of a list that meet in one group
ROUNDING = 1e-6


@dataclass(frozen=True)
class Quantiser:
    centroids: np.ndarray  # lists x dimensions
    books: list[np.ndarray]  # for each subspace codewords x its dimensions
    cuts: list[slice]

    def codes(self, residuals: np.ndarray) -> np.ndarray:
        return np.stack([_nearest(residuals[:, c], b) for c, b in zip(self.cuts, self.books)], axis=1).astype(np.uint8)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    def tables(self, residuals: np.ndarray) -> list[np.ndarray]:
        """For each subspace the squared distances of the queries' residuals to all codewords."""
        return [_squared(residuals[:, c], b) for c, b in zip(self.cuts, self.books)]


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :], 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _squared(x, centres).argmin(1)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centres = x[draw.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return np.unique(centres, axis=0)


def fit(sample: np.ndarray, lists: int) -> Quantiser:
    """Quantiser from unit vectors; a constant amount of work, as the sample is bounded."""
    centroids = _kmeans(sample, max(1, min(lists, MAX_LISTS, len(sample))))
    residuals = sample - centroids[_nearest(sample, centroids)]
    edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
    cuts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
    return Quantiser(centroids, [_kmeans(residuals[:, c], CODEWORDS) for c in cuts], cuts)


def _units(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(1, keepdims=True)  # large components would overflow when squared
    scaled = vectors / top
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(v: Column) -> Column:
    """Neither NULL nor zero nor with NULL or non-finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _indexed(classes: DataFrame, q: Quantiser, reach: float) -> DataFrame:
    """Add list, codes, missed and probes to each class."""
    gaps = np.sqrt(_squared(q.centroids, q.centroids))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            units = _units(_matrix(batch.column("vector")))
            squared = _squared(units, q.centroids)
            own = squared.argmin(1)
            # the distance to a plane is this excess / (2 * gap); half of reach is the limit
            probed = squared - squared.min(1)[:, None] <= reach * gaps[own] + ROUNDING
            residuals = units - q.centroids[own]
            codes = q.codes(residuals)
            missed = np.sqrt(((residuals - q.decoded(codes)) ** 2).sum(1))
            rows, lists = np.nonzero(probed)
            offsets = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(missed), pa.ListArray.from_arrays(pa.array(offsets), pa.array(lists.astype(np.int32))),
                ],
                [*batch.schema.names, "list", "codes", "missed", "probes"],
            )

        return step

    kind = dict(classes.dtypes)["vector"]
    schema = f"node bigint, low bigint, copies bigint, vector {kind}, list int, codes binary, missed double, probes array<int>"
    return map_batches(classes.select("node", "low", "copies", "vector"), make, schema)


def _met(members: pd.DataFrame, queries: pd.DataFrame, q: Quantiser, threshold: float, reach: float) -> pd.DataFrame:
    """Counts and a spanning star from one block of a list and one block of its queries."""
    result = pd.DataFrame({"node": [], "n": [], "other": []}).astype("int64")
    if members.empty or queries.empty:
        return result
    y = _units(np.stack(members["vector"].to_numpy()).astype(np.float64))
    x = _units(np.stack(queries["asked"].to_numpy()).astype(np.float64))
    codes = np.frombuffer(b"".join(members["codes"]), np.uint8).reshape(len(y), -1)
    missed = members["missed"].to_numpy()
    copies = members["copies"].to_numpy()
    y_nodes, x_nodes = members["node"].to_numpy(), queries["asker"].to_numpy()
    homes, weights = queries["home"].to_numpy(), queries["weight"].to_numpy()
    asks = np.zeros((len(y), len(q.centroids)), bool)  # the lists that each member probes itself
    asks[np.repeat(np.arange(len(y)), members["probes"].map(len)), np.concatenate(members["probes"].to_numpy())] = True
    own = q.centroids[members["list"].iloc[0]]
    bound = (reach + missed + ROUNDING) ** 2
    rows, cols = [], []
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        looked_up = np.zeros((len(part), len(y)))
        for i, table in enumerate(q.tables(part - own)):
            looked_up += table[:, codes[:, i]]
        possible = looked_up <= bound
        dense = possible.mean() > 0.05
        r, c = np.nonzero(possible & (part @ y.T >= threshold) if dense else possible)
        mine = (x_nodes[at + r] < y_nodes[c]) | ~asks[c, homes[at + r]]
        r, c = r[mine], c[mine]
        if not dense:
            cosine = np.concatenate([np.einsum("ij,ij->i", part[r[s : s + 50_000]], y[c[s : s + 50_000]]) for s in range(0, len(r), 50_000)] or [np.zeros(0)])
            r, c = r[cosine >= threshold], c[cosine >= threshold]
        rows.append((at + r).astype(np.int32))
        cols.append(c.astype(np.int32))
    r, c = np.concatenate(rows), np.concatenate(cols)
    nodes, place = np.unique(np.concatenate([x_nodes, y_nodes]), return_inverse=True)
    x_place, y_place = place[: len(x)][r], place[len(x) :][c]
    counts = np.bincount(x_place, copies[c], len(nodes)) + np.bincount(y_place, weights[r], len(nodes))
    low = local_stars(len(nodes), x_place, y_place)
    found = np.flatnonzero(counts > 0)
    return pd.DataFrame({"node": nodes[found], "n": counts[found], "other": nodes[low[found]]}).astype("int64")


def _within(group: pd.DataFrame, threshold: float, reach: float) -> pd.DataFrame:
    """What ``_met`` finds among all vectors of one length that one group holds, by one list of their own."""
    units = _units(np.stack(group["vector"].to_numpy()).astype(np.float64))
    q = fit(units, 1)
    q = Quantiser(q.centroids[:1], q.books, q.cuts)
    residuals = units - q.centroids[0]
    codes = q.codes(residuals)
    members = group.assign(
        list=0, codes=[c.tobytes() for c in codes], missed=np.sqrt(((residuals - q.decoded(codes)) ** 2).sum(1)),
        probes=[np.zeros(1, np.int32)] * len(group),
    )
    queries = pd.DataFrame({"asker": group["node"], "asked": group["vector"], "weight": group["copies"], "home": 0})
    return _met(members, queries, q, threshold, reach)


_LINKS = "node bigint, n bigint, other bigint"


def _links(classes: DataFrame, n: int, threshold: float, reach: float) -> DataFrame:
    """(node, n, other): links among n classes of vectors of one length, over inverted lists."""
    # twice the share of hashes that the sample needs, so that no task sends more than its part
    share = min(1.0, 2 * SAMPLE_ROWS / n)
    drawn = classes.select("vector", F.xxhash64("vector").alias("h")).where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30)))
    sampled = drawn.orderBy("h", "vector").limit(SAMPLE_ROWS).select("vector").toArrow()
    quantiser = fit(_units(_matrix(sampled["vector"].combine_chunks())), -(-n // LIST_ROWS))
    index = materialize(_indexed(classes, quantiser, reach), "vector-index")

    queries = index.select(
        F.col("node").alias("asker"), F.col("vector").alias("asked"), F.col("copies").alias("weight"),
        F.col("list").alias("home"), F.explode("probes").alias("list"),
    )
    sizes = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("m_blocks"))
    asked = queries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("q_blocks"))
    blocks = sizes.join(asked, "list")  # a row per list, MAX_LISTS at most

    def block(node: str, count: str) -> Column:
        return F.pmod(F.xxhash64(node), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    key = ["list", "m_block", "q_block"]
    members = index.select("list", "node", "copies", "vector", "codes", "missed", "probes").join(blocks, "list")
    members = members.withColumn("m_block", block("node", "m_blocks")).withColumn("q_block", every("q_blocks")).drop("m_blocks", "q_blocks")
    asking = queries.join(blocks, "list").withColumn("q_block", block("asker", "q_blocks")).withColumn("m_block", every("m_blocks")).drop("m_blocks", "q_blocks")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _met(left, right, quantiser, threshold, reach)

    return materialize(members.groupBy(*key).cogroup(asking.groupBy(*key)).applyInPandas(meet, _LINKS), "vector-links")


def linked(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding).

    Vectors of different lengths are never linked. Each length with more than
    BLOCK different vectors gets lists of its own; those of every other length
    meet in one group of that bounded size.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("given"))
    # zeros of either sign are equal; floats travel as they are
    kind = "float" if dict(rows.dtypes)["given"] == "array<float>" else "double"
    as_key = F.transform("given", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    keyed = rows.withColumn("vector", F.when(usable(F.col("given")), as_key))
    classes = keyed.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    # the number is written with its row and so the same for all readers
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("d", F.size("vector")), "vector-classes")
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + ROUNDING
    counted = classes.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    large = {r["d"]: r["n"] for r in counted.where(F.col("n") > BLOCK).collect()}  # fewer than rows / BLOCK
    small = classes.join(counted.where(F.col("n").between(2, BLOCK)), "d", "left_semi")
    met = small.select("d", "node", "copies", "vector").groupBy("d").applyInPandas(lambda g: _within(g, threshold, reach), _LINKS)
    met = materialize(met, "vector-links")
    for length, n in sorted(large.items()):
        met = met.unionByName(_links(classes.where(F.col("d") == length).drop("d"), n, threshold, reach))
    counts = met.groupBy("node").agg(F.sum("n").alias("n"))
    stars = components(met.where("node != other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = classes.join(counts, "node", "left").join(stars, "node", "left").select(
        "vector", "low", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    named = placed.join(lowest, "component").select(F.col("vector").alias("v"), "n_links", "component_id")
    return keyed.join(named, keyed["vector"] == named["v"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )


def brute_force(vectors: list[tuple[int, list[float] | None]], threshold: float = THRESHOLD) -> dict[int, tuple[int, int, bool]]:
    """The same by comparing all pairs; for tests on small tables with distinct ids of equal lengths."""
    good = [(i, np.array(v, np.float64)) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {i: (0, i, True) for i, _ in vectors}
    if good:
        units = _units(np.stack([v for _, v in good]))
        a, b = np.nonzero(units @ units.T >= threshold)
        a, b = a[a != b], b[a != b]
        ids = np.array([i for i, _ in good])
        order = np.argsort(ids)
        rank = np.argsort(order)
        low = ids[order][local_stars(len(ids), rank[a], rank[b])[rank]]
        n = np.bincount(a, minlength=len(ids))
        out |= {int(i): (int(k), int(c), bool(i == c)) for i, k, c in zip(ids, n, low)}
    return out
