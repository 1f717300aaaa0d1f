"""Larger sketches recover every differing digest."""

from pyspark.sql import functions as F

from deltaloom.llm import op10_fingerprints as O


def test_recover_both_ways(spark):
    texts = [("a " * 9, "b c"), ("", ""), (" ".join(f"w{i}" for i in range(30_000)), " ".join(f"w{i}" for i in range(15_000, 60_000))), ("same words", "same words")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "id long, a string, b string").select(
        "id", O.paragraphs(F.col("a")).alias("left"), O.paragraphs(F.col("b")).alias("right"))
    want = {r["id"]: (len(set(r["left"]) - set(r["right"])), len(set(r["right"]) - set(r["left"]))) for r in rows.collect()}
    assert {r["id"]: (r["plus"], r["minus"]) for r in O.recover(rows).collect()} == want
    small = rows.where("id <> 2")
    got = O.recover_in_row(small).collect()
    assert all(r["done"] for r in got) and {r["id"]: (r["plus"], r["minus"]) for r in got} == {k: v for k, v in want.items() if k != 2}


def test_edges(spark):
    schema = "doc_id long, text string, fingerprint string"
    assert O.fingerprints(spark.createDataFrame([], schema)).count() == 0
    rows = [(3, None, "x"), (None, "one two", "y"), (5, "", None), (5, "", None), (7, "long " * 3000, "z")]
    got = sorted(O.fingerprints(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r["doc_id"] or -1, r["n_chars"]))
    assert [r["n_chars"] for r in got] == [7, 0, 0, 0, 15000]
    assert len({r["fingerprint"] for r in got}) == 3  # empty texts are alike
    assert got[1]["near_next"] == 1.0 and got[2]["near_edited"] == 1.0


def test_half_of_a_short_text_is_seen(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "ab"] + ["\n".join(" ".join(f"l{k}w{i}" for i in range(40)) for k in range(8))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in O.fingerprints(docs).collect()}
    assert all(r["near_edited"] > 0.2 and r["near_next"] == 0 for r in got.values())


def test_digest_by_chance(spark):
    """One of the cells of these digests' difference, 20 to a table, passes for a digest of its own."""
    left = [-4253034213823044707, 5343047360177023020]
    right = [
        2137694770393974898, 4998703913512098260, 8458547940694835619, 422171304492829550, 7212175395248180380, -4453387473303017554,
        -1039442485368365887, -5510481983948165122, 785725256247560218, 1581857543194812927, -853266883359334070, -8172985567224779438,
        -4002598287655996396, -763827844471988340, -7721389756147643897, 6377810909978301226, 8943395047108175341, -3317403643798011034,
        -6455980436060418036, 4624172207226272591]
    rows = spark.createDataFrame([(7, left, right)], "_uid long, left array<long>, right array<long>")
    got = O.compare(rows, {"x": ("left", "right")}, 20).collect()
    assert [(r["x_plus"], r["x_minus"]) for r in got] == [(2, 20)]


def test_recover_in_row_of_many(spark):
    rows = spark.range(6).select(
        "id", F.transform(F.sequence(F.lit(1), F.col("id") * 600 + 1), lambda i: F.lit(i).cast("long")).alias("i")).select(
        "id", *[O.paragraphs(F.concat_ws("\n", F.transform("i", lambda i: F.concat(F.lit("w"), (i + shift).cast("string"))))).alias(c) for c, shift in (("left", 0), ("right", 150))])
    got = {r["id"]: (r["plus"], r["minus"], r["done"]) for r in O.recover_in_row(rows).collect()}
    assert got == {k: (n := min(150, 600 * k + 1), n, True) for k in range(6)}


def test_only_hard_pairs_are_joined(spark, monkeypatch):
    """Rows move again only if one of their pairs has more digests than are recovered in a row."""
    digests = lambda c, low, high: O.paragraphs(F.concat_ws("\n", F.transform(F.sequence(F.lit(low), F.col("_uid") * high + low), lambda i: F.concat(F.lit("w"), i.cast("string"))))).alias(c)
    rows = spark.range(4).select(F.col("id").alias("_uid")).select("_uid", digests("a", 1, 150), digests("b", 100, 150))
    want = {r["_uid"]: (len(set(r["a"]) - set(r["b"])), len(set(r["b"]) - set(r["a"]))) for r in rows.collect()}
    for limit, joined in ((O.IN_ROW, False), (400, True)):
        monkeypatch.setattr(O, "IN_ROW", limit)
        out = O.compare(rows, {"x": ("a", "b"), "y": ("b", "a")})
        assert ("Join" in out._jdf.queryExecution().optimizedPlan().toString()) == joined
        got = {r["_uid"]: r for r in out.collect()}
        assert {u: (r["x_plus"], r["x_minus"]) for u, r in got.items()} == want
        assert {u: (r["y_minus"], r["y_plus"]) for u, r in got.items()} == want
