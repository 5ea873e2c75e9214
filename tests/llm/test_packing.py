import random
from collections import Counter, defaultdict

import pandas as pd

from tidemark.llm import packing


def plain_best_fit(pieces, capacity, per_source):
    """Every bin is looked at for every piece."""
    bins, placed = [], []
    for size, source, cluster in pieces:
        fitting = [
            (b["room"], i) for i, b in enumerate(bins)
            if b["room"] >= size and cluster not in b["clusters"] and b["sources"][source] < per_source
        ]
        if fitting:
            i = min(fitting)[1]
        else:
            i = len(bins)
            bins.append({"room": capacity, "clusters": set(), "sources": Counter()})
        bins[i]["room"] -= size
        bins[i]["clusters"].add(cluster)
        bins[i]["sources"][source] += 1
        placed.append(i)
    return placed


def test_shard_as_plain_best_fit():
    draw = random.Random(5)
    for _ in range(30):
        n = draw.randint(0, 120)
        pieces = sorted(
            ((draw.randint(0, 20), draw.choice(["a", "a", "b", None]), draw.randint(0, 40)) for _ in range(n)), key=lambda p: -p[0]
        )
        frame = pd.DataFrame(pieces, columns=["size", "source", "cluster"])
        assert packing.pack_shard(frame, 20, 2).tolist() == plain_best_fit(pieces, 20, 2)


def test_whole_table_keeps_all_and_clashes_nowhere(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(docs, packing.packed(docs, capacity=512, shard_words=50_000).collect(), 512)


def check(docs, rows, capacity):
    words = {r.doc_id: len(packing_words(r.text)) for r in docs.collect()}
    total, bins = Counter(), defaultdict(list)
    for r in rows:
        total[r.doc_id] += r["size"]
        bins[r.shard, r.bin].append(r)
    assert total == Counter(words) and set(total) == set(words)
    for members in bins.values():
        assert sum(m["size"] for m in members) <= capacity
        assert len({m.cluster for m in members}) == len(members)
        assert max(Counter(m.source for m in members).values()) <= packing.PER_SOURCE


def packing_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(1, None, None, 1), (1, None, None, 1), (None, "a b", "s", 2), (3, "w " * 25, "s", 3), (3, "w " * 25, "s", 3), (4, "", "t", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin long")
    got = packing.packed(docs, capacity=10).collect()
    assert sorted((r.doc_id or 0, r.piece, r["size"]) for r in got) == sorted(
        [(1, 0, 0)] * 2 + [(0, 0, 2)] + [(3, 0, 10), (3, 1, 10), (3, 2, 5)] * 2 + [(4, 0, 0)]
    )
    assert packing.packed(docs.where("false")).count() == 0
