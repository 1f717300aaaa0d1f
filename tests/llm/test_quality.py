"""The quality classifier's parts against plain sums, and odd rows."""

from itertools import combinations

import numpy as np

from deltaloom.llm import op07_quality as Q

TEXTS = ["Plain words make a plain sentence.", "", "x " * 400, "!!! $$$ ###", "Ünïcode wörds \x00 here", "a", "one two\nthree"]


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = Q.Machine(0.3, rng.normal(0, 1, Q.FEATURES), rng.normal(0, 1, (Q.FEATURES, 3)))
    row, column, value, stats = Q.features([t.encode() for t in TEXTS])
    got = m.score([t.encode() for t in TEXTS])
    for i in range(len(TEXTS)):
        x = {int(c): float(v) for r, c, v in zip(row, column, value) if r == i} | {Q.WORD_BUCKETS + k: float(v) for k, v in enumerate(stats[i]) if v}
        z = m.w0 + sum(m.w[c] * v for c, v in x.items()) + sum(m.v[a] @ m.v[b] * x[a] * x[b] for a, b in combinations(x, 2))
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6


def test_features_of_runs_are_features_of_all():
    texts = [t.encode() for t in TEXTS] * 5
    for a, b in zip(Q.gathered(texts, 50), Q.features(texts)):
        assert np.allclose(a, b)


def test_odd_rows(spark):
    rows = [(k, TEXTS[k % 7] if k % 9 else None, "en", 1) for k in range(60)] + [(None, "n", "en", 1), (5, "again", None, None), (5, "again", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string, _y int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(5, 1, 0), (None, 1, 0), (7, None, 0), (9, 3, 0)], "doc_id bigint, quality int, toxic int")
    m = Q.train(docs, labels)
    got = Q.score(docs, m).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    kept = Q.keep(docs, m)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    again = Q.train(docs.repartition(5), labels)
    assert m.w0 == again.w0 and (m.w == again.w).all() and (m.v == again.v).all()
    assert Q.score(docs.limit(0), Q.train(docs.limit(0), labels)).count() == 0
    assert {r["score"] for r in Q.score(docs, Q.train(docs, labels.limit(0))).collect()} == {0.5}
