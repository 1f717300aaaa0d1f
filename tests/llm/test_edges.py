"""Nulls, empty tables, ties, repeated rows, long values and clashing names, operator by operator."""

import random

from pyspark.sql import functions as F

from deltaloom.llm import op02_urls, op06_shards


def test_urls(spark):
    listed = spark.createDataFrame([("bad.example",), ("worse.example",), ("worse.example",), (None,), ("never.asked",), ("x",)], "key string")
    long = ".".join(["a" * 60] * 9)
    urls = [
        None, "", "no scheme", "http://", "http://bad.example/x", "HTTP://A.BAD.example?q", "http://notbad.example/", "http://ok.example#f", f"http://{long}.worse.example/p",
        f"http://{'z' * 400}/", "ftp://x", "http://a.x/", "http://x.a/", "http://ok.example#f", "http://a\nb.bad.example/c"]
    pages = spark.createDataFrame([(i, u, "mine", "kept") for i, u in enumerate(urls)], "page_id long, url string, host string, _fit string")
    hosts = pages.select(op02_urls.split_url(F.col("url"))[0].alias("host"))
    want = [False, False, False, False, True, True, False, False, True, False, True, True, False, False, True]
    for bits in (1 << 26, 16):  # one cascade, and one for each of several parts of the hosts
        held = op02_urls.filter_of(listed, hosts, max_bits=bits)
        assert (len(held.parts) > 1) == (bits == 16)
        out = op02_urls.judge(pages, [("allow", "bad.example/x")], held)
        assert sorted(out.columns) == sorted([*pages.columns, "path", "rule", "listed", "verdict"])
        got = {r["page_id"]: r for r in out.collect()}
        assert [got[i]["listed"] for i in range(len(urls))] == want
        assert [got[i]["verdict"] for i in range(len(urls))] == ["block" if w and i != 4 else "allow" for i, w in enumerate(want)]
        assert (got[4]["rule"], got[5]["host"], got[5]["path"], got[0]["host"], got[0]["_fit"]) == ("bad.example/x", "a.bad.example", "", "", "kept")
        assert op02_urls.judge(pages.limit(0), [], held).count() == 0
    empty = op02_urls.filter_of(listed.limit(0), hosts.limit(0))
    assert op02_urls.judge(pages, [], empty).where("listed").count() == 0


def test_a_cascade_of_several_levels(spark):
    rng = random.Random(5)
    names = [f"h{rng.randrange(10**9)}" for _ in range(6000)]
    keys = spark.createDataFrame([(n,) for n in names], "key string")
    cascade = op02_urls.build(keys.limit(0).unionByName(spark.createDataFrame([(n,) for n in names[:1500]], "key string")), keys, bits_per_key=3)
    assert len(cascade.levels) > 2
    got = {r[0] for r in keys.where(cascade.contains(F.col("key"))).collect()}
    assert got == set(names[:1500])


def test_shards_grow(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 50 == 49, None).otherwise(F.col("id")).alias("k"), F.lit("t").alias("slot"))
    counts = list(range(1, 41))
    out = rows.select("k", *[op06_shards.descend(F.col("k"), op06_shards.tree(n))["shard"].alias(f"s{n}") for n in counts])
    for r in out.collect():
        for n in counts[1:]:
            assert r[f"s{n}"] in (r[f"s{n - 1}"], n - 1)
    shares = {r[0]: r[1] for r in out.groupBy("s10").count().collect()}
    assert set(shares) == set(range(10)) and max(shares.values()) < 2 * 300


def test_a_weight_moves_rows_of_its_own_subtree_only(spark):
    rows = spark.range(4000)
    before, after = (op06_shards.descend(F.col("id"), op06_shards.tree(12, weights=w))["shard"] for w in (None, {5: 3.0}))
    moved = rows.select(before.alias("a"), after.alias("b")).where("a <> b").collect()
    assert moved and all(r["b"] == 5 for r in moved)


def test_shard_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "é", 2), (1, "é", 2), (None, "x" * 100_000, 3), (2, "", 4)], "doc_id long, text string, shard int")
    got = op06_shards.assign(docs, "doc_id", "text", 3).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 3, 3, 100_001]
    for s in {r["shard"] for r in got}:
        mine = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        ids = [r["doc_id"] for r in mine]
        assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert op06_shards.assign(docs.limit(0), "doc_id", "text", 3).count() == 0


