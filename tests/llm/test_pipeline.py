"""The pipeline's stages against brute force."""

import corpus_pipeline as P
from deltaloom.llm.queries import table

from .test_queries import components, shingles, windows_of


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_hashes_do_not_depend_on_the_batch():
    from deltaloom.llm.textvec import Words

    texts = [b"One two", b"", b"two   three\tfour ONE"]
    whole = Words(texts).hashes().tolist()
    assert whole == [h for t in texts for h in Words([t]).hashes().tolist()]
    assert whole[0] == whole[5] and whole[1] == whole[2] and len(set(whole)) == 4


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    source = rows_of(docs)
    bad = {r["doc_id"] for r in table(spark, sf, "labels").where("quality = 0").collect()}
    good = P.quality(spark, docs, sf)
    assert good.columns == docs.columns
    kept = rows_of(good)
    labelled = {r["doc_id"] for r in table(spark, sf, "labels").collect()}
    assert sum(i in kept for i in labelled - bad) >= 0.95 * len(labelled - bad)
    assert sum(i in kept for i in bad) <= 0.1 * len(bad)

    from deltaloom.llm.common import stage

    good = stage(good, "test")
    single = stage(P.near_duplicates(spark, good, sf), "test")
    assert single.columns == docs.columns
    want = components({i: shingles(t, 5) for i, t in kept.items()}, 80, 100)
    assert set(rows_of(single)) == {i for i, c in want.items() if i == c}

    clean = stage(P.decontamination(spark, single, sf), "test")
    assert clean.columns == docs.columns
    windows = {w for r in table(spark, sf, "benchmark").collect() for w in windows_of(r["text"])[1]}
    sizes = {len(w) for w in windows}

    def hit(text):
        words = windows_of(text)[0]
        return any(tuple(words[p:p + n]) in windows for n in sizes for p in range(len(words) - n + 1))

    assert set(rows_of(clean)) == {i for i, t in rows_of(single).items() if not hit(t)}
    packed = P.packing(spark, clean, sf).collect()
    assert {r["doc_id"] for r in packed} == set(rows_of(clean))
    full = sorted(sum(r["length"] for r in packed if r["sequence_id"] == s) for s in {r["sequence_id"] for r in packed})
    assert full[1:] == [2048] * (len(full) - 1)
    assert source
