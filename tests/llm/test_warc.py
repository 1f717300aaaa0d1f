"""Archives that are whole, damaged, cut or odd."""

import hashlib
import random

import pytest

from deltaloom.llm import op09_warc as W


def record(k: int, body: bytes) -> bytes:
    digest = hashlib.sha256(body).hexdigest()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


BODIES = [random.Random(k).randbytes(40 * k * k) for k in range(30)]


@pytest.mark.parametrize("zipped", [False, True])
def test_whole_archive(zipped):
    made = [W.member(record(k, b)) if zipped else record(k, b) for k, b in enumerate(BODIES)]
    got = W.Salvage(b"".join(made)).run()
    assert [r.block for r in got.records] == BODIES and not got.gaps
    assert W.Salvage(b"").run().records == []


@pytest.mark.parametrize("zipped", [False, True])
def test_damaged_records_are_gaps_and_later_ones_are_found(zipped):
    made = [W.member(record(k, b)) if zipped else record(k, b) for k, b in enumerate(BODIES)]
    start = [sum(map(len, made[:k])) for k in range(31)]
    data = bytearray(b"".join(made))
    for k in (7, 8, 20):
        data[start[k] + len(made[k]) // 2] ^= 0x55
    got = W.Salvage(bytes(data[:-3])).run()
    assert [r.block for r in got.records] == [b for k, b in enumerate(BODIES) if k not in (7, 8, 20, 29)]
    assert [(g.offset, g.length) for g in got.gaps] == [(start[7], start[9] - start[7]), (start[20], start[21] - start[20]), (start[29], len(data) - 3 - start[29])]


def test_bad_record_inside_a_member_leaves_its_neighbours():
    parts = [record(k, BODIES[k]) for k in range(4, 8)]
    parts[1] = parts[1].replace(b"Content-Length: 1000", b"Content-Length: 1001")
    got = W.Salvage(W.member(b"".join(parts))).run()
    assert [r.block for r in got.records] == [BODIES[4], BODIES[6], BODIES[7]] and len(got.gaps) == 1


def test_member_ends_in_zero_for_large_records_too():
    body = bytes(17 << 20)
    data = W.member(record(1, body)) + W.member(record(2, b"x"))
    got = W.Salvage(data).run()
    assert data.endswith(b"\0") and [len(r.block) for r in got.records] == [len(body), 1] and not got.gaps


def test_round_trip_of_odd_rows(spark, tmp_path):
    html = ["a" * 99, "a" * 100, "b\r\n\r\nWARC/1.1\r\n" * 20, None, "", "\x00\x1f�\U0001f600" * 50, "z" * 3_000_000]
    rows = [(k, f"http://h/{k}\r\nX: y" if k % 2 else None, h, "t") for k, h in enumerate(html * 2)] + [(None, None, "b" * 200, "t"), (3, "u", "a" * 100, "t")] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload_digest string")
    W.write(pages, path := f"file://{tmp_path}/a")
    got = W.read(spark, path, payloads=True).collect()
    assert len(got) == len(rows) and all(r["kind"] == "record" for r in got)
    texts = {hashlib.sha256((r[2] or "").encode()).hexdigest(): (r[2] or "").encode() for r in rows}
    assert all(r["payload_bytes"] == len(texts[r["payload_digest"]]) for r in got)
    assert all(bytes(r["payload"]) == texts[r["payload_digest"]] for r in got if r["record_type"] == "response")
    again = sorted((r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit")
    assert again == sorted([(3, 1), (3, 1), (8, 1), (9, 2), (12, 5), (13, 6)])


def test_no_rows(spark, tmp_path):
    W.write(spark.createDataFrame([], "page_id bigint, url string, html string"), path := f"file://{tmp_path}/b")
    assert W.read(spark, path).count() == 0


def test_headers_of_any_length(spark, tmp_path):
    rows = [(k, "http://h/" + "u" * n, "b" * 200) for k, n in enumerate((5, 100_000, 3_000_000, 7))]
    W.write(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path := f"file://{tmp_path}/c")
    got = W.read(spark, path).collect()
    assert {(r["kind"], r["page_id"], r["url"], r["refers_to"]) for r in got} == {("record", k, url, 0 if k else None) for k, url, _ in rows}
    assert len(got) == len(rows)


def test_header_without_end_stops_at_the_next_version_line():
    cut = record(1, b"x" * 50)[:70]
    data = cut + b"\n" + record(2, b"y")
    got = W.Salvage(data).run()
    assert [r.block for r in got.records] == [b"y"] and [(g.offset, g.length) for g in got.gaps] == [(0, len(cut) + 1)]
