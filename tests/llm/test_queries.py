"""Each query of the training-data operators against brute force over whole small tables."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from deltaloom.llm import queries as Q

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, sf, name):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {d["doc_id"]: d["text"] for d in table(spark, sf, "documents")}


def by_doc(df):
    rows = [r.asDict() for r in df.collect()]
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1_restores_the_order_of_turns(spark, sf):
    rows = [r.asDict() for r in Q.op1_chat(spark, sf).collect()]
    source = table(spark, sf, "conversations")
    assert len(rows) == len(source)
    for conv in {r["conv_id"] for r in source}:
        mine = sorted((r for r in rows if r["conv_id"] == conv and r["kind"] != "message"), key=lambda r: r["seq"])
        turns = [r["turn"] for r in mine]
        assert turns == sorted(turns)
    assert sum(a["position"] > b["position"] for a in rows for b in rows if a["conv_id"] == b["conv_id"] and a["turn"] < b["turn"]) > len(rows) // 4
    assert {"", "missing summary", "unexpected accents"} <= {r["errors"] for r in rows} and not any(r["on_cycle"] for r in rows)


def test_op2_rules(spark, sf):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    urls = {r["page_id"]: r["url"] for r in table(spark, sf, "pages")}
    for r in Q.op2_urls(spark, sf).collect():
        url = urls[r["page_id"]]
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        assert (r["host"], r["path"]) == (host, path)
        fit = [(len(x), x, v) for v, x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/"):])]
        listed = any(host == n or host.endswith("." + n) for n in Q.LISTED)
        assert r["listed"] == listed
        assert r["rule"] == (max(fit)[1] if fit else None)
        assert r["verdict"] == (max(fit)[2] if fit else "block" if listed else "allow")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


def components(sets, num, den):
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_op3_components(spark, sf, docs):
    sets = {i: shingles(t, 3) for i, t in docs.items()}
    want, got = components(sets, 90, 100), by_doc(Q.op3_jaccard(spark, sf))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(set(want.values())) < len(want)


def test_op4_pieces(spark, sf, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer())
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in Q.op4_packing(spark, sf).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(docs)
    for i, text in docs.items():
        ids, at = [*tok.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    fill = []
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        fill.append(at)
    assert max(fill) <= 2048 and sorted(fill)[1] == 2048  # all but one are full


def test_op5_counts(spark, sf, docs):
    from deltaloom.llm.op05_tokens import MARK, brute_force, pieces

    scores, known = pieces(Q.tokenizer("piece_bpe_32k.model")), {}
    got = by_doc(Q.op5_tokens(spark, sf))
    for i, text in list(docs.items()):
        words = (text or "").split()
        for w in words:
            if w not in known:
                known[w] = brute_force(MARK + w, scores)
        assert (got[i]["n_words"], got[i]["n_tokens"]) == (len(words), sum(known[w] for w in words))


def shard_of(key, shards):
    """The largest ln(u) of all shards, whatever their racks and regions."""
    start = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42)
    return max((math.log(((xxhash.xxh64_intdigest(f"s{s}".encode(), seed=start) >> 11) + 1) / 2**53), s) for s in range(shards))[1]


def test_op6_shards(spark, sf, docs):
    got = by_doc(Q.op6_shards(spark, sf))
    slots = defaultdict(list)
    for i, r in got.items():
        data = (docs[i] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert (r["shard"], r["grown_shard"]) == (shard_of(i, 16), shard_of(i, 17)) and r["grown_shard"] in (r["shard"], 16)
        assert (r["region"], r["rack"]) == (f"g{r['shard'] // 4}", f"g{r['shard'] // 4}/k{r['shard'] // 2}")
        slots[r["shard"]].append((r["slot"], i))
    assert set(slots) <= set(range(16))
    assert all([x[0] for x in sorted(s)] == list(range(len(s))) and [x[1] for x in sorted(s)] == sorted(x[1] for x in s) for s in slots.values())


def test_op7_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = by_doc(Q.op7_quality(spark, sf))
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels")}
    held = [(labels[i], r) for i, r in got.items() if r["held_out"] and i in labels]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([y == r["predicted"] for y, r in held]) > 0.93


def windows_of(text, width=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def test_op8_hits(spark, sf, docs):
    items = defaultdict(set)
    for r in table(spark, sf, "benchmark"):
        for w in windows_of(r["text"])[1]:
            items[w].add(str(r["item_id"]))
    sizes = {len(w) for w in items}
    got, some = by_doc(Q.op8_decontaminate(spark, sf)), 0
    for i, text in docs.items():
        words, hit, found = windows_of(text)[0], set(), set()
        for n in sizes:
            for p in range(len(words) - n + 1):
                if (w := tuple(words[p:p + n])) in items:
                    hit |= set(range(p, p + n))
                    found |= items[w]
        r, some = got[i], some + bool(hit)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(words), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert some


def test_op9_pages(spark, sf):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in table(spark, sf, "pages")}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = {r["page_id"]: r for r in Q.op9_warc(spark, sf).collect()}
    assert set(got) == set(pages)
    for i, html in pages.items():
        again = len(html) >= 100 and first[html] != i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha256(html).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[html]) if again else ("response", None))


def test_op10_fingerprints(spark, sf, docs):
    got, ids = by_doc(Q.op10_fingerprints_(spark, sf)), sorted(docs)

    def digests(text):
        return {m.rstrip(" ") for m in re.findall(r"(?:\S+[^\S\n]*){1,%d}" % Q.op10_fingerprints.PARAGRAPH, text)}

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, i in enumerate(ids):
        text, following = docs[i] or "", docs[ids[(k + 1) % len(ids)]] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(digests(text), digests(edited)))
        assert r["near_next"] == pytest.approx(like(digests(text), digests(following)))
    prints = defaultdict(set)
    for i in ids:
        prints[docs[i]].add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in prints.values()) and len({next(iter(x)) for x in prints.values()}) == len(prints)
