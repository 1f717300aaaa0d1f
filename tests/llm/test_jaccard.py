"""The join on families of near copies, edge cases and both thresholds, against brute force."""

import random

import numpy as np
import pyarrow as pa

from deltaloom.llm.op03_jaccard import Plan, _of_several, keep_one, near_groups, signatures

from .test_queries import components, shingles


def family(seed, copies, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(words)] = f"x{rng.randrange(40)}"
        out.append(" ".join(text))
    return out


def test_families(spark):
    texts = family(1, 60, 90, 7) + family(2, 30, 200, 12) + family(3, 30, 14, 2) + ["a b", "A  b", "a", "", None, " \n"]
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for plan in (Plan(3, 90, 100, 2, 1), Plan(), Plan(2, 7, 10, 4, 2)):
        sets = {i: shingles(t, plan.words) for i, t in rows}
        want = components(sets, plan.num, plan.den)
        got = {r["doc_id"]: r for r in near_groups(docs, plan).collect()}
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
        assert {r["doc_id"] for r in keep_one(docs, plan).collect()} == {i for i in sets if want[i] == i}


def test_edges(spark):
    schema = "doc_id long, text string, n long"
    assert near_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (None, "a b c d e f", 2), (2, None, 3), (2, None, 3)]
    docs = spark.createDataFrame(rows, schema)
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in near_groups(docs).collect()) == [(0, 1), (1, 1), (1, 1), (2, 2), (2, 2)]
    kept = [tuple(r) for r in keep_one(docs).collect()]
    assert sorted(kept) == [(1, "a b c d e f", 1), (2, None, 3), (2, None, 3)]


def test_sets_far_from_their_leader(spark):
    rng = random.Random(8)
    passage, texts = [f"p{k}" for k in range(60)], []
    for _ in range(60):
        own = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(20, 60))]
        for _ in range(rng.choice((1, 1, 2, 3))):
            again = list(own)
            again[rng.randrange(len(own))] = "other"
            at = rng.randrange(len(own))
            texts.append(" ".join(again[:at] + passage + again[at:] if rng.random() < 0.2 else passage + again))
    rows = list(enumerate(texts + family(5, 40, 80, 9)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: shingles(t, 5) for i, t in rows}
    want = components(sets, 8, 10)
    got = {r["doc_id"]: r["component_id"] for r in near_groups(docs).collect()}
    assert got == want


def test_signatures_meet():
    """Any two similar sets share as many signatures as is promised, whatever their sizes."""
    rng = np.random.default_rng(3)
    for plan in (Plan(), Plan(3, 90, 100, 2, 1), Plan(2, 7, 10, 4, 2)):
        instances = plan.instances(3000)
        for n in (1, 2, 4, 5, 6, 9, 10, 19, 33, 120, 700, 2300):
            for m in range(n, n * plan.den // plan.num + 1, max(1, n // 7)):
                # the least common part that still is similar
                common = -(-(n + m) * plan.num // (plan.num + plan.den))
                if common > n:
                    continue
                pool = np.unique(rng.integers(0, 1 << 63, 2 * (n + m) + 9, dtype=np.uint64))
                a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:common], pool[n:n + m - common])))
                if np.array_equal(a, b):
                    continue
                assert plan.similar(common, n, m)
                both = np.intersect1d(signatures(a, plan, instances), signatures(b, plan, instances)).size
                assert both >= plan.shared(np.array([n, m])).max() >= 1, (plan, n, m)


def test_scan_of_sorted_rows():
    rng = random.Random(2)
    rows = sorted((rng.randrange(60), rng.randrange(5)) for _ in range(150))
    classes = {}
    for s, c in rows:
        classes.setdefault(s, set()).add(c)
    want = [r for r in sorted(set(rows)) if len(classes[r[0]]) > 1]
    for size in (1, 2, 3, 7, 150):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i:i + size]], pa.int64()), pa.array([r[1] for r in rows[i:i + size]], pa.int64())], names=["sig", "cls"]) for i in range(0, 150, size)]
        got = [(a, c) for b in _of_several(iter(batches)) for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert got == want


def test_clashing_names_and_a_hot_id(spark):
    text = family(4, 2, 300, 2)
    rows = [(1, text[0], 5, "x")] * 40 + [(2, text[1], 6, "y"), (3, "", 7, None), (3, None, 8, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _digest string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=repr) == sorted([rows[0], rows[41], rows[42]], key=repr)
    assert sorted((r["component_id"], r["n_equal"]) for r in near_groups(docs).collect()) == [(1, 1)] + [(1, 40)] * 40 + [(3, 1)] * 2


def test_null_ids_link_to_near_copies(spark):
    texts = family(7, 3, 90, 2)
    other = family(9, 2, 90, 2)
    rows = [(None, texts[0])] * 4 + [(5, texts[0]), (6, texts[1]), (None, texts[2]), (None, texts[2])] + [(None, other[0]), (None, other[0]), (8, other[1]), (9, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = near_groups(docs).collect()
    assert sorted(r["component_id"] for r in got) == [5] * 8 + [8] * 3 + [9]
    assert sorted(r["doc_id"] for r in keep_one(docs).collect()) == [5, 8, 9]
