"""Trie-shared counts against plain forward scores: ties, long words and texts, odd rows."""

import math
import random

from deltaloom.llm import op05_tokens as T


def test_scores_are_probabilities():
    scores = T.zipf([f"p{k}" for k in range(50)])
    assert abs(sum(math.exp(s) for s in scores.values()) - 1) < 1e-9 and scores["p0"] > scores["p1"] > scores["p49"]


def test_counts(spark):
    rng = random.Random(1)
    alphabet = "abcé\U0001f600"
    ranked = list(dict.fromkeys("".join(rng.choice(alphabet[:4]) for _ in range(rng.randrange(1, 5))) for _ in range(60))) + [T.MARK, T.MARK + "a"]
    scores = T.zipf(ranked)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 12))) for _ in range(300)] + ["ab" * 300, "é" * 129, "q" * 128]
    want = {w: T.brute_force(T.MARK + w, scores) for w in words}
    counter = T.TrieCounter(scores)
    ordered = sorted(T.MARK + w for w in set(words))
    assert dict(zip(ordered, counter.count(ordered))) == {T.MARK + w: n for w, n in want.items()}
    assert all(counter.count_long(T.MARK + w) == n for w, n in want.items())

    texts = [" ".join(words), "\t\n ", "", None, "ab\u2003ab", "é" * 129 + " " + "é" * 129] + ["ab " * 10] * 3
    rows = [(k if k != 5 else None, t, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_tokens"]) for r in T.count_tokens(docs, scores).collect()), key=repr)
    split = [(t or "").split() for t in texts]
    assert got == sorted(((r[0], len(w), sum(T.brute_force(T.MARK + x, scores) for x in w)) for r, w in zip(rows, split)), key=repr)
    assert T.count_tokens(docs.limit(0), scores).count() == 0


def test_blocks(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 7)
    text = "one two  three " + "x" * 40 + " four"
    parts = list(T.blocks(text))
    assert "".join(parts) == text and [w for p in parts for w in p.split()] == text.split() and list(T.blocks("")) == []
