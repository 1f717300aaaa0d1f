"""Definition statements, model differences, replays and what they need."""

import json

import pytest

from deltaloom.functions import ddl
from deltaloom.functions.tokens import Unreadable
from deltaloom.operators import model as M

TABLE = """CREATE TABLE [s].[T] (
  [id] int IDENTITY(1, 1) NOT NULL, [name] nvarchar(20) COLLATE Latin1_General_CI_AS NULL, price decimal(9, 2) NOT NULL CONSTRAINT DF_p DEFAULT ((0)),
  total AS ([price] * 2) PERSISTED, ref int NULL,
  CONSTRAINT PK_T PRIMARY KEY ([id]), CONSTRAINT UQ_T UNIQUE NONCLUSTERED (name DESC, price), CONSTRAINT CK_T CHECK (price > 0 AND [name] <> N'it''s'),
  CONSTRAINT FK_T FOREIGN KEY (ref) REFERENCES [s].[P] ([id]) ON DELETE SET NULL)"""


def obj(*statements):
    return ddl.object_of(list(statements))


STATEMENTS = [
    TABLE, "CREATE UNIQUE CLUSTERED INDEX IX ON s.T (a ASC, b DESC) INCLUDE (c) WHERE a IS NOT NULL;", "CREATE SCHEMA x AUTHORIZATION [dbo]", "CREATE SYNONYM s.n FOR t.[m]",
    "CREATE SEQUENCE s.q AS int START WITH 5 INCREMENT BY -1 MINVALUE -10 MAXVALUE 5 NO CYCLE CACHE 10", "CREATE TYPE s.code FROM varchar(max) NOT NULL", "ALTER TABLE s.T ADD c time(3) NULL",
    "ALTER TABLE s.T ADD CONSTRAINT DF_c DEFAULT (getdate()) FOR c", "ALTER TABLE s.T DROP COLUMN c", "ALTER TABLE s.T DROP CONSTRAINT CK_T", "ALTER TABLE s.T ALTER COLUMN name nvarchar(40) NOT NULL",
    "ALTER SEQUENCE s.q RESTART WITH 3 NO CACHE", "DROP INDEX IX ON s.T", "DROP TABLE s.T", "DROP SCHEMA x", "DROP TYPE s.code", "EXEC sp_rename N'[s].[T].[a]', N'b', 'COLUMN'", "EXEC sys.sp_rename 's.T', 'U'",
]


@pytest.mark.parametrize("source", STATEMENTS)
def test_statements_there_and_back(source):
    op = ddl.statement(source)
    assert ddl.statement(ddl.text_of(op)) == op


@pytest.mark.parametrize("source", ["", "SELECT 1", "CREATE TABLE t (a int NULL)", "CREATE TABLE s.t (a int)", "CREATE TABLE s.t (a foo NULL)", "CREATE TABLE s.t (a varchar NULL)",
                                    "CREATE TABLE s.t (a int NULL", "DROP VIEW s.v", "ALTER TABLE s.t DROP COLUMN a, b", "EXEC other 'x'", "EXEC sp_rename 'a', 'b'", "DROP TABLE s.t x"])
def test_what_the_grammar_lacks(source):
    with pytest.raises(Unreadable):
        ddl.statement(source)


def test_object_and_file():
    body = obj(TABLE, "CREATE INDEX B ON s.t (ref)", "CREATE INDEX A ON [S].[T] (price)")
    assert [x["name"] for x in body["indexes"]] == ["B", "A"] and body["columns"][3]["computed"] == {"expression": ["price", "*", "2"], "persisted": True}
    again = obj(*ddl.file_text(body).split("\nGO\n"))
    assert M.difference(body, again) == []
    with pytest.raises(Unreadable):
        obj(TABLE, "CREATE INDEX A ON s.other (price)")


def test_paths():
    a, b = obj(TABLE), obj(TABLE.replace("nvarchar(20)", "nvarchar(30)").replace("CK_T", "CK_U").replace("(name DESC, price)", "(price, name DESC)").replace("price > 0", "price > 1"))
    assert M.difference(a, b) == [
        "columns[name].type.length", f"constraints[ck_t] {M.ABSENT_IN_OTHER}", f"constraints[ck_u] {M.ABSENT_IN_SELF}", "constraints[uq_t].columns (order)"]
    c = obj(TABLE.replace("price > 0", "price > 1"))
    assert M.difference(a, c) == ["constraints[ck_t].expression"] and M.difference(a, obj(TABLE.replace("[name] nvarchar", "[NAME] nvarchar"))) == []
    moved = obj("CREATE TABLE s.t (a int NULL, b int NULL)"), obj("CREATE TABLE s.t (b int NULL, a int NULL)")
    assert M.difference(*moved) == ["columns (order)"] and M.difference(None, a) == [M.ABSENT_IN_SELF]


def ops_of(base, head):
    ops, refused = M.operations(base, head)
    return sorted((M.STEPS.index(M._step(o)), o.get("name") or o["body"]["name"], o["op"]) for o in ops), refused


def through(base, ops):
    body = base
    for op in sorted(ops, key=lambda o: M.STEPS.index(M._step(o))):
        body = M.apply(body, op)
    return body


def test_operations_make_the_head():
    base = obj("CREATE TABLE s.t (a int NOT NULL, b varchar(10) NULL CONSTRAINT d1 DEFAULT ('x'), c int NULL, CONSTRAINT pk PRIMARY KEY (a), CONSTRAINT k CHECK (c > 0))", "CREATE INDEX ix ON s.t (b)")
    head = obj("CREATE TABLE s.t (a int NOT NULL, b varchar(20) NULL CONSTRAINT d2 DEFAULT ('y'), e int NULL, CONSTRAINT pk PRIMARY KEY (a), CONSTRAINT u UNIQUE (b))", "CREATE INDEX ix ON s.t (b DESC)")
    ops, refused = M.operations(base, head)
    assert refused == [] and M.difference(through(base, ops), head) == []
    assert [n for _, _, n in ops_of(base, head)[0]] == ["drop constraint", "drop constraint", "drop index", "drop column", "add column", "alter column", "add constraint", "create index", "add constraint"]
    made, _ = M.operations(None, obj(TABLE, "CREATE INDEX B ON s.t (ref)"))
    assert [o["op"] for o in made] == ["create table", "add constraint", "create index"] and M.difference(through(None, made), obj(TABLE, "CREATE INDEX B ON s.t (ref)")) == []
    assert [o["op"] for o in M.operations(obj(TABLE), None)[0]] == ["drop constraint", "drop table"]
    assert M.operations(obj(TABLE), obj(TABLE)) == ([], [])


@pytest.mark.parametrize("a, b, code", [
    ("a int NULL, b int NULL", "b int NULL, a int NULL", "ORD001"), ("a int NULL, b int NULL", "a int NULL, x int NULL, b int NULL", "ORD001"), ("a int NOT NULL", "a int IDENTITY(1, 1) NOT NULL", "IDENTITY_CHANGE"),
    ("a int NULL, b AS (a)", "a int NULL, b AS (a + 1)", "COMPUTED_CHANGE"), ("a varchar(9) COLLATE x NULL", "a varchar(9) COLLATE y NULL", "COLLATION_CHANGE"),
    ("a int NULL, CONSTRAINT u UNIQUE (a)", "a bigint NULL, CONSTRAINT u UNIQUE (a)", "ALTER_COLUMN_DEPENDANTS")])
def test_refusals(a, b, code):
    assert [c for c, _ in M.operations(obj(f"CREATE TABLE s.t ({a})"), obj(f"CREATE TABLE s.t ({b})"))[1]] == [code]


@pytest.mark.parametrize("op, problem", [
    ("ALTER TABLE s.t ADD a int NULL", "the column a exists"), ("ALTER TABLE s.t ADD z int NOT NULL", "the column z takes no null and has no default"), ("ALTER TABLE s.t DROP COLUMN a", "the column a is in use"),
    ("ALTER TABLE s.t DROP COLUMN zz", "no column zz"), ("ALTER TABLE s.t ADD CONSTRAINT p2 PRIMARY KEY (a)", "a second primary key"), ("CREATE CLUSTERED INDEX i ON s.t (b)", "a second clustered index"),
    ("ALTER TABLE s.t DROP CONSTRAINT zz", "no constraint zz"), ("CREATE TABLE s.t (a int NULL)", "the object exists"), ("ALTER TABLE s.t ALTER COLUMN a bigint NOT NULL", "the column a is in use"),
    ("EXEC sp_rename 's.t.c', 'x', 'COLUMN'", "an expression names c")])
def test_violations(op, problem):
    body = obj("CREATE TABLE s.t (a int NOT NULL, b int NULL, c int NULL, CONSTRAINT pk PRIMARY KEY (a), CONSTRAINT k CHECK (c > 0))")
    with pytest.raises(M.Violation, match=problem):
        M.apply(body, ddl.statement(op))


def test_allows():
    base = obj("CREATE TABLE s.t (a varchar(10) NULL, b decimal(9, 2) NOT NULL, CONSTRAINT pk PRIMARY KEY (b))")
    cases = {
        "DROP TABLE s.t": ["DROP_TABLE"], "ALTER TABLE s.t ALTER COLUMN a varchar(5) NOT NULL": ["ALTER_COLUMN_LOSSY", "SET_NOT_NULL", "LONG_LOCK"], "ALTER TABLE s.t ALTER COLUMN a varchar(20) NULL": ["LONG_LOCK"],
        "ALTER TABLE s.t ALTER COLUMN b decimal(9, 4) NOT NULL": ["ALTER_COLUMN_LOSSY", "LONG_LOCK"], "ALTER TABLE s.t DROP CONSTRAINT pk": ["LONG_LOCK"], "ALTER TABLE s.t ADD c int NULL": [],
        "ALTER TABLE s.t ALTER COLUMN z int NOT NULL": ["ALTER_COLUMN_LOSSY", "SET_NOT_NULL", "LONG_LOCK"], "EXEC sp_rename 's.t', 'u'": ["RENAME"], "CREATE INDEX i ON s.t (a)": ["LONG_LOCK"]}
    for source, codes in cases.items():
        assert M.needs_allow(ddl.statement(source), base) == codes, source
    assert M.needs_allow(ddl.statement("CREATE INDEX i ON s.t (a)"), base, created=True) == []


def test_relations(spark):
    parent = "CREATE TABLE s.p (id int NOT NULL, x int NULL, CONSTRAINT {0} PRIMARY KEY {1} (id))"
    child = "CREATE TABLE s.c (id int NULL, CONSTRAINT fk FOREIGN KEY (id) REFERENCES s.p (id))"
    texts = [("p", parent.format("pk", "CLUSTERED")), ("c", child), ("bad", "CREATE TABLE s.x (a int NULL"), ("gone", "CREATE SYNONYM s.g FOR s.p")]
    base = M.parse_objects(spark.createDataFrame(texts, "path string, text string"))
    got = {r["path"]: r for r in base.collect()}
    assert got["bad"]["problem"] == "expected )" and got["bad"]["at_line"] == 1 and got["p"]["key"] == "table:[s].[p]"
    base = base.where("problem is null")
    head = M.parse_objects(spark.createDataFrame([("p", parent.format("pk", "NONCLUSTERED")), texts[1]], "path string, text string"))
    ops = M.diff(base, head).collect()
    order = [(M.STEPS[r["step"]], r["key"], r["name"]) for r in sorted(ops, key=lambda r: (r["step"], r["key"], r["name"]))]
    assert order == [("drop foreign key", "table:[s].[c]", "fk"), ("drop key", "table:[s].[p]", "pk"), ("add key", "table:[s].[p]", "pk"), ("add foreign key", "table:[s].[c]", "fk"), ("drop synonym", "synonym:[s].[g]", "g")]
    numbered = spark.createDataFrame([(r["key"], r["step"], r["op"]) for r in ops], "key string, seq long, op string")
    assert M.prove(base, numbered, head).count() == 0
    assert {tuple(r) for r in M.prove(base, numbered.where("seq <> 4"), head).collect()} == {("table:[s].[p]", "operation 0: pk exists")}
    assert {tuple(r) for r in M.diff_paths(base, head).collect()} == {("table:[s].[p]", "constraints[pk].clustered"), ("synonym:[s].[g]", M.ABSENT_IN_OTHER)}
    assert {(r["key"], r["code"]) for r in M.classified(numbered, base).collect()} == {("table:[s].[p]", "LONG_LOCK"), ("table:[s].[c]", "LONG_LOCK")}
    shown = {r["name"]: r["text"] for r in M.statements(M.diff(base, head)).collect() if r["step"] == 4}
    assert shown == {"pk": "ALTER TABLE [s].[p] DROP CONSTRAINT [pk]"}
    moved = M.renamed(base, spark.createDataFrame([("table:[s].[p]", "table:[s].[q]", "Q")], "key string, new_key string, new_name string")).collect()
    assert json.loads(next(r["body"] for r in moved if r["key"] == "table:[s].[q]"))["name"] == "Q"
