"""Logs whose calls stand before the calls they need, and cycles."""

from deltaloom.llm import op01_chat as C

SCHEMA = "conversation long, position long, kind string, call_id string, tool string, arguments map<string,string>, needs array<string>, content string"


def call(conversation, position, name, *needs):
    return (conversation, position, "call", name, "t", {}, list(needs), None)


def result(conversation, position, name):
    return (conversation, position, "result", name, None, None, None, "r")


def placed(spark, rows):
    schemas = spark.createDataFrame([], C.SCHEMA_COLUMNS)
    return C.format_chats(spark.createDataFrame(rows, SCHEMA), schemas).collect()


def test_calls_out_of_order(spark):
    rows = [
        call(1, 0, "c", "b"), result(1, 1, "c"), call(1, 2, "b", "a"), result(1, 3, "b"), call(1, 4, "a"), result(1, 5, "a"),
        result(2, 0, "x"), call(2, 1, "x"), call(2, 2, "y", "x", "none"),
        call(3, 0, "a"), result(3, 1, "a"), call(3, 2, "b", "a"), result(3, 3, "b")]
    got = sorted((r["conversation"], r["seq"], r["kind"], r["call_id"]) for r in placed(spark, rows))
    assert [(k, c) for n, _, k, c in got if n == 1] == [(k, c) for c in "abc" for k in ("call", "result")]
    assert [(k, c) for n, _, k, c in got if n == 2] == [("call", "x"), ("result", "x"), ("call", "y")]
    assert [(k, c) for n, _, k, c in got if n == 3] == [("call", "a"), ("result", "a"), ("call", "b"), ("result", "b")]


def test_cycles_are_marked(spark):
    rows = [
        call(1, 0, "after", "p"), call(1, 1, "p", "q"), result(1, 2, "p"), call(1, 3, "q", "p", "start"), result(1, 4, "q"),
        call(1, 5, "start"), result(1, 6, "start"), call(2, 0, "self", "self"), result(2, 1, "self")]
    got = {(r["conversation"], r["kind"], r["call_id"]): r for r in placed(spark, rows)}
    assert {k for k, r in got.items() if r["on_cycle"]} == {(n, k, c) for n, c in ((1, "p"), (1, "q"), (2, "self")) for k in ("call", "result")}
    seq = {k: r["seq"] for k, r in got.items()}
    assert seq[1, "result", "p"] < seq[1, "call", "after"] and seq[1, "result", "start"] < seq[1, "call", "q"]
    assert sorted(v for k, v in seq.items() if k[0] == 1) == list(range(7)) and seq[2, "call", "self"] == 0


def test_null_conversations_are_one(spark):
    rows = [call(None, 3, "b", "a"), result(None, 4, "b"), call(None, 5, "a"), result(None, 6, "a"), call(7, 0, "a"), (7, 1, "note", None, None, None, None, None)]
    got = {(r["conversation"], r["kind"], r["call_id"]): r for r in placed(spark, rows)}
    assert [got[None, k, c]["seq"] for c in "ab" for k in ("call", "result")] == [0, 1, 2, 3]
    assert {got[None, k, c]["link"] for c in "ab" for k in ("call", "result")} == {"linked"}
    assert got[7, "call", "a"]["link"] == "unanswered" and got[7, "note", None]["link"] == "message"


def test_links(spark):
    rows = [
        call(1, 0, "a"), call(1, 1, "a"), result(1, 2, "a"), result(1, 3, "a"), result(1, 4, "lost"), (1, 5, "call", None, "t", None, None, None),
        (1, 6, "result", None, None, None, None, "r"), (1, None, None, "a", None, None, None, None)]
    got = {r["position"]: r["link"] for r in placed(spark, rows)}
    assert got == {0: "linked", 1: "duplicate", 2: "linked", 3: "duplicate", 4: "orphan", 5: "unanswered", 6: "orphan", None: "message"}
    again = placed(spark, [call(1, 0, "a")] * 2)
    assert sorted(r["link"] for r in again) == ["duplicate", "unanswered"] and sorted(r["seq"] for r in again) == [0, 1]
    assert again[0]["errors"] == ["unknown tool"]


def test_arguments_and_json(spark):
    schemas = spark.createDataFrame([
        ("t", "n", "integer", True), ("t", "x", "number", False), ("t", "b", "boolean", False), ("t", "s", "string", False), ("t", "odd", "date", False),
        ("t", "n", "integer", True), (None, "n", "string", True)], C.SCHEMA_COLUMNS)
    cases = [
        ({"n": "-0", "x": "1.5e3", "b": "true", "s": 'q"\n\u00e9'}, [], '{"b":true,"n":0,"s":"q\\"\\n\u00e9","x":1.5e3}'),
        ({"n": "5\n", "b": "True"}, ["b is not boolean", "n is not integer"], '{"b":"True","n":"5\\n"}'),
        ({"z": "1", "odd": "x", "x": "01"}, ["missing n", "odd has no known type", "unexpected z", "x is not number"], '{"odd":"x","x":"01","z":"1"}'),
        ({}, ["missing n"], "{}"), (None, ["missing n"], None), ({"n": None}, ["missing n"], '{"n":null}')]
    rows = [(1, k, "call", f"c{k}", "t", a, None, None, "mine", k) for k, (a, _, _) in enumerate(cases)]
    frame = spark.createDataFrame(rows, SCHEMA + ", json string, extra long")
    out = C.format_chats(frame, schemas)
    got = {r["position"]: r for r in out.collect()}
    assert out.columns.count("json") == 1 and all(r["extra"] == k for k, r in got.items())
    for k, (_, errors, inside) in enumerate(cases):
        assert got[k]["errors"] == errors
        assert got[k]["json"] == "{" + (f'"arguments":{inside},' if inside else "") + f'"id":"c{k}","kind":"call","name":"t"' + "}"
    assert C.format_chats(frame.limit(0), schemas).count() == 0
