"""Texts, names and messages against expected values."""

import pytest
from pyspark.sql import functions as F

from deltaloom.functions import text as X
from deltaloom.functions import tokens as T


def column(spark, values, f, kind="string"):
    """f(c) of each value, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"k int, c {kind}")
    return [r[1] for r in sorted(rows.select("k", f(F.col("c"))).collect())]


def test_normal_form(spark):
    given = ["a \t\x0b\x0c\r\nb\rc  \n\n \n", "﻿x", "  lead\n\n in", "", None]
    assert column(spark, given, X.normal_form) == ["a\nb\nc", "x", "  lead\n\n in", "", None]
    assert column(spark, given[:1], X.plain_lines) == ["a \t\x0b\x0c\nb\nc  \n\n \n"]


def test_globs(spark):
    cases = [("dbo.a*", "dbo", "a.b", True), ("DBO.A?", "dbo", "aB", True), ("dbo.a?", "dbo", "a", False), ("s*.x", "sales", "X", True), ("dbo.a+", "dbo", "aa", False), ("dbo", "dbo", "x", False)]
    for pattern, schema, name, want in cases:
        assert spark.range(1).select(X.glob_matches(pattern, F.lit(schema), F.lit(name))).collect()[0][0] == want, pattern


REDACTIONS = [
    ("bad value 'secret-4711 cut", "bad value <redacted>"),
    ("k (1, f(2), 3)", "k <redacted>"),
    ("a (b (c (d) e) f) g (open (x) y", "a <redacted> g <redacted>"),
    ("name 'O'Neil' and \"q\" end", "name <redacted> and <redacted> end"),
    ("The duplicate key value is (1, 'x'). rest", "The duplicate key value is <redacted>"),
    ("Truncated value: 'abc'", "Truncated value: <redacted>"),
    ("There is already an object named 'sales.Order' in the database.", "There is already an object named 'sales.Order' in the database."),
    ("There is already an object named 'sales.Order' in the database. x", "There is already an object named <redacted> in the database. x"),
    ("Invalid column name 'nope'.", "Invalid column name <redacted>."),
    ("plain\n  text here) ok", "plain text here) ok"),
    ("()" * 3 + "((()))", "<redacted>" * 4),
    ("x" * 400, "x" * 300),
]


def test_redact(spark):
    assert column(spark, [g for g, _ in REDACTIONS], X.redact) == [w for _, w in REDACTIONS]
    kept = lambda c: X.redact(c, F.array(F.lit("nope"), F.lit("s")))
    assert column(spark, ["Invalid column name 'nope'.", "Invalid object name 's.t'."], kept) == ["Invalid column name 'nope'.", "Invalid object name <redacted>."]


def test_errors(spark):
    texts = ["Msg 1205, Level 13", "x exceeded. (1222) (SQLExecDirectW)", "[42000] (0)", "Lock request time out   period\nexceeded.", "Login failed for user 'x'.", "none", "ends (208)\n"]
    assert column(spark, texts, X.parse_number) == [1205, 1222, None, 1222, 18456, None, 208]
    rows = [(9002, None, "", False), (None, None, "Lock request time out period exceeded", False), (1205, "08S01", "", True), (40613, None, "", True), (40613, None, "", False),
            (None, None, "TCP Provider: Timeout error", True), (None, "08001", "TCP Provider: Timeout error", False), (None, "40003", "", False), (None, None, "", True)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, n int, s string, t string, c boolean")
    got = [r[1] for r in sorted(df.select("k", X.error_class(F.col("n"), F.col("s"), F.col("t"), F.col("c"))).collect())]
    assert got == ["governance", "lock_timeout", "deadlock", "transient_connect", "other", "transient_connect", "session_lost", "session_lost", "other"]


def test_names(spark):
    assert column(spark, ["a]b", "", None], X.quote) == ["[a]]b]", None, None]
    assert column(spark, ["it's", "a\\\nb", "nul\0"], X.sql_literal) == ["N'it''s'", None, None]
    keys = ["VIEW:[s].[a]]b]", "SCHEMA:[s]", "SCHEMA:[s].[t]", "VIEW:[s]", "THING:[a].[b]", "VIEW:[].[x]"]
    parts = column(spark, keys, X.key_parts)
    assert [p and tuple(p) for p in parts] == [("VIEW", "s", "a]b"), ("SCHEMA", None, "s"), None, None, None, None]
    paths = ["schema/views/s.v.sql", "schema/views/con.sql", "schema/x/a.sql", "schema/views/a?.sql", "views/a.sql", "schema/tables/s.t .sql"]
    assert [p and tuple(p) for p in column(spark, paths, X.key_for_path)] == [("VIEW", "s.v"), None, None, None, None, None]
    names = ["", "a:b", "a.", "NUL.txt", "com1", "x" * 256, "é" * 128, "fine"]
    assert column(spark, names, X.file_name_problem) == ["empty", "unsafe character", "ends with dot or space", "device name", "device name", "too long", "too long", None]
    assert column(spark, ["Straße", "ABC"], X.fold) == ["strasse", "abc"]


def test_secrets_and_sign_in(spark):
    texts = ["password = 'x'", "@password = 'x'", "Pwd=hunter2;", "secret=0xAB", "PASSWORD = @p", "DecryptByPassphrase( N'x'", "token = 'x'", None]
    assert column(spark, texts, X.secret_in_text) == [True, True, True, True, False, True, False, False]
    hidden = lambda c: X.hide_sign_in(c, "sa", "p}w")
    given = ["sa said p}w, also p}}w and {p}}w}.", "sap}w", "nothing", "p}wp}w"]
    assert column(spark, given, hidden) == ["<hidden> said <hidden>, also <hidden> and <hidden>.", "sa<hidden>", "nothing", "<hidden>"]
    assert column(spark, ["login sa: Server=x; UID=sa; PWD=p}"], lambda c: X.hide_echo(c, "sa", "p}w")) == ["login <hidden>: Server=x; <hidden>"]


def test_small_values(spark):
    one = lambda c: spark.range(1).select(c).collect()[0][0]
    assert one(X.span_seconds(F.lit("2024-01-01T00:00:00.000Z"), F.lit("2024-01-01T00:00:02.250Z"))) == "2.3 s" and one(X.span_seconds(F.lit("x"), F.lit("y"))) == "unknown"
    assert one(X.retention(F.lit(6), F.lit(5))).asDict() == {"n": 6, "unit": "MONTHS"} and one(X.retention(F.lit(-1), F.lit(5))) is None
    assert one(X.ascii_json(F.lit('{"a":"é\U0001f600"}'))) == '{"a":"\\u00e9\\ud83d\\ude00"}'
    masks = [("Partial(1,\"xX\",0)", None, 'partial(1, "xX", 0)'), ("random(1, 12.5)", 2, "random(1.00, 12.50)"), ("DEFAULT()", None, "default()"), ("odd", None, "odd"), ("random(007, 9)", None, "random(7, 9)")]
    df = spark.createDataFrame([(k, f, n) for k, (f, n, _) in enumerate(masks)], "k int, f string, n int")
    assert [r[1] for r in sorted(df.select("k", X.mask_spelling(F.col("f"), F.col("n"))).collect())] == [w for _, _, w in masks]
    assert one(X.trigger_events(F.lit("INSERT:0:1;UPDATE:1:0")))["UPDATE"].asDict() == {"first": True, "last": False}
    assert one(X.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)))) == {"a": 1, "b": 3}
    assert one(X.batch_tag(F.lit(" \n/* tool:read_state */ select"), "tool")) == "read_state" and one(X.batch_tag(F.lit("select /* tool:x */"), "tool")) is None
    assert one(X.cell(F.lit("a|b\n\\c"))) == "a\\|b \\\\c"


# ---- tokens ----------------------------------------------------------------------------------------------------

def kinds(source):
    return [(t.kind, t.text) for t in T.scan(source) if t.kind not in ("ws", "nl")]


def test_tokens():
    assert kinds("a[b]]c]\"d\"\"e\" N'x''y' 'z'") == [("word", "a"), ("bident", "[b]]c]"), ("qident", '"d""e"'), ("nstring", "N'x''y'"), ("string", "'z'")]
    assert kinds("/* a /* b */ c */ -- d\n@@x #t $1.5 0xAF 1e3 .5 a<>b ||") == [
        ("comment", "/* a /* b */ c */"), ("comment", "-- d"), ("var", "@@x"), ("word", "#t"), ("op", "$"), ("number", "1.5"), ("number", "0xAF"), ("number", "1e3"), ("number", ".5"),
        ("word", "a"), ("op", "<>"), ("word", "b"), ("op", "||")]
    source = "﻿select 1\r\n, [a]\r'x\ny' /* \n */ z"
    toks = T.scan(source)
    assert "".join(t.text for t in toks) == source[1:] and toks[-1].line == 5
    assert [t.value for t in toks if t.name or "string" in t.kind] == ["select", "a", "x\ny", "z"]


@pytest.mark.parametrize("source, line", [("a\n'open", 2), ("/* /* */", 1), ("[a\n]", 1), ('x "y', 1), ("1a", 1), ("nul\n\x00", 2), ("--\x01", 1), ("Ｄ", 1), ("a \\\n b", 1), ("⃠", 1)])
def test_unreadable(source, line):
    with pytest.raises(T.Unreadable) as e:
        T.scan(source)
    assert e.value.line == line


def test_batches():
    got = [(b.first_line, b.repeat, b.text) for b in T.batches("\n\na\nGO\nb GO\n/* x\nGO\n*/ go\ngo 5 -- c\n'GO\nGO'\nGO\n\n")]
    assert got == [(3, 1, "a"), (5, 5, "b GO\n/* x\nGO\n*/ go"), (10, 1, "'GO\nGO'")]
    assert T.batches(" \n") == [] and [b.text for b in T.batches("GO x\nGO")] == ["GO x"]


def test_headers_and_names():
    h = T.header("-- c\ncreate or alter proc [s].[a]]b] as select 1")
    assert (h.verb, h.kind, h.schema, h.name) == ("CREATE OR ALTER", "PROCEDURE", "s", "a]b")
    for bad in ("", "select 1", "create table t (a int)", "create view a.b.c as select 1", "create view [] as"):
        with pytest.raises(T.Unreadable):
            T.header(bad)
    assert T.names("select x.y, z from [s].[t].[c] where @v.m = 'q.r' -- n.o") == [
        ("dbo", "select", False), ("x", "y", True), ("dbo", "z", False), ("dbo", "from", False), ("s", "t", True), ("dbo", "where", False)]
    assert T.schema_bound("create view s.v with schemabinding as select 1") and not T.schema_bound("create view s.v as select 1 -- with schemabinding")
    assert T.stored_text("create or alter view v as select 1") == "create   view v as select 1" and T.stored_text("alter view v as x") == "CREATE view v as x"
    assert T.exported("create   view v as select 1", "s", "v") == "CREATE OR ALTER view [s].[v] as select 1"
    assert T.directives("-- t:a b c\nx -- t:no\n'-- t:no'\n-- t:z", "-- t:") == [T.Directive("a", "b c", 1), T.Directive("z", "", 4)]
    assert T.names_written("update [t] set c = \"v\" 'open") == []


def test_table_functions(spark):
    T.register(spark.range(1))
    spark.createDataFrame([(1, "a GO\nGO\nb"), (2, "'open"), (3, None)], "k int, t string").createOrReplaceTempView("texts")
    got = spark.sql("select k, first_line, batch, problem, at_line from texts, lateral split_batches(t) order by k, first_line").collect()
    assert [tuple(r) for r in got] == [(1, 1, "a GO", None, None), (1, 3, "b", None, None), (2, None, None, "string without end", 1)]
