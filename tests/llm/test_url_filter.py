import pytest

from tidemark.llm import url_filter as uf

URLS = [
    "http://example.org/es/a", "https://WWW.Example.org/en/12", "http://example.org/en/2", "http://org", "http://x.com/fr/",
    "http://x.com/de/1?x=://", "http://x.com/fr", "nothing", None, "", "http://", "http:///de/", "http://notexample.org/es/",
    "ftp://a..com/de/#q", "http://example.org/es/a", "x\n://com/de/\n", "http://Äxample.ORG/ä",
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("limit", [uf.MAX_FILTER_BYTES, 0])
def test_judged_as_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(uf, "MAX_FILTER_BYTES", limit)  # 0: beyond the size that may be shipped
    pages = spark.createDataFrame([(i, u, "keys") for i, u in enumerate(URLS)], "page_id long, url string, keys string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judged(pages, uf.rules_frame(spark)).collect()}
    assert got == {i: brute(u, uf.RULES) for i, u in enumerate(URLS)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert uf.judged(pages.where("false"), uf.rules_frame(spark)).count() == 0
    [row] = uf.judged(pages, spark.createDataFrame([], uf.RULE_SCHEMA)).collect()
    assert (row.rule, row.verdict) == (None, "allow")


def test_cascade_is_exact_with_many_keys(spark):
    from pyspark.sql import functions as F

    def keyed(df):
        return df.select(F.concat(F.lit("k"), "id").alias("key")).withColumn("h", uf.key_hashes(F.col("key")))

    universe, listed = keyed(spark.range(40_000)), keyed(spark.range(0, 40_000, 7))
    cascade = uf.build_cascade(listed, universe)
    rows = universe.toArrow()
    h = rows["h"].combine_chunks()
    found = cascade.has(*(uf.low_bits(h.field(i).to_numpy()) for i in (0, 1)))
    got = {k for k, f in zip(rows["key"].to_pylist(), found) if f}
    assert got == {f"k{i}" for i in range(0, 40_000, 7)}
    assert len(cascade.levels) > 1
