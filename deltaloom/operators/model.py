"""Models: relations of objects, their differences as operations, operations replayed, and what each needs.

A model is a relation (key, body): body is an object of `functions.ddl` as canonical JSON, key its folded identity.  Work
on one object is a function on its body; work between objects is joins.
"""

from __future__ import annotations

import copy
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.functions import ddl
from deltaloom.functions.tokens import Unreadable, batches
from deltaloom.operators import graph

#: The order in which operations run.
STEPS = [
    "rename", "drop foreign key", "drop check or default", "drop index", "drop key", "drop column", "drop table", "create schema", "create alias type", "create table type",
    "create sequence", "alter sequence", "create table", "add column", "drop column property", "alter column", "add column property", "rebuild table", "add key", "create index",
    "add check or default", "add foreign key", "drop synonym", "create synonym", "drop sequence", "drop table type", "drop alias type", "drop schema",
]
_TYPES = {"FK": "foreign key", "CK": "check or default", "DF": "check or default", "PK": "key", "UQ": "key"}
_KIND_STEP = {"SCHEMA": "schema", "TYPE": "alias type", "SEQUENCE": "sequence", "TABLE": "table", "SYNONYM": "synonym"}
ABSENT_IN_OTHER, ABSENT_IN_SELF = "(absent in other)", "(absent in self)"
UNORDERED = ("constraints", "indexes", "included")


def fold(name: str | None) -> str:
    return (name or "").casefold()


# ---- one object ------------------------------------------------------------------------------------------------

def _label(item) -> str | None:
    return fold(item["name"]) if isinstance(item, dict) and isinstance(item.get("name"), str) else None


def _plain(value, field: str = ""):
    """The form that is compared: names folded, lists without an order sorted, absent and null fields alike."""
    if isinstance(value, dict):
        return {k: _plain(v, k) for k, v in value.items() if v is not None and v is not False and v != [] and not (k.startswith("on_") and v == "NO ACTION")}
    if isinstance(value, list):
        items = [_plain(v, field) for v in value]
        return sorted(items, key=ddl.dumps) if field in UNORDERED else items
    return fold(value) if isinstance(value, str) and field not in ("expression", "filter") else value


def paths(a, b, at: str = "") -> list[str]:
    """Where two plain forms differ.  Lists meet by unique names, else by place; the text of an expression is not shown."""
    if a == b:
        return []
    if isinstance(a, dict) and isinstance(b, dict):
        if a.get("kind") != b.get("kind") or a.get("type") != b.get("type") and isinstance(a.get("type"), str):
            return [f"{at}.class" if at else "class"]
        return [p for k in sorted(a.keys() | b.keys()) for p in paths(a.get(k), b.get(k), f"{at}.{k}" if at else k)]
    if isinstance(a, list) and isinstance(b, list) and not at.rpartition(".")[2] in ("expression", "filter"):
        left, right = {_label(x): x for x in a}, {_label(x): x for x in b}
        if None in left or None in right or len(left) < len(a) or len(right) < len(b):
            if len(a) != len(b):
                return [f"{at} (count)"]
            return [p for i, (x, y) in enumerate(zip(a, b)) for p in paths(x, y, f"{at}[{i}]")]
        out = []
        for name in sorted(left.keys() | right.keys()):
            here = f"{at}[{name}]"
            out += [f"{here} {ABSENT_IN_OTHER}"] if name not in right else [f"{here} {ABSENT_IN_SELF}"] if name not in left else paths(left[name], right[name], here)
        return out or [f"{at} (order)"]
    return [at]


def difference(a: dict | None, b: dict | None) -> list[str]:
    if a is None or b is None:
        return [ABSENT_IN_SELF if a is None else ABSENT_IN_OTHER]
    return paths(_plain(a), _plain(b))


def _step(op: dict) -> str:
    kind, body = op["op"], op.get("body", {})
    if kind in ("add constraint", "drop constraint"):
        return f"{kind.split()[0]} {_TYPES[op.get('type') or body['type']]}"
    return {"create type": "create alias type", "drop type": "drop alias type"}.get(kind, kind)


def narrower(old: dict, new: dict) -> bool:
    size = lambda n: float("inf") if n == "max" else (n or 0)
    s, t = old.get("scale") or 0, new.get("scale") or 0
    if size(new.get("length")) < size(old.get("length")) or t < s:
        return True
    p, q = old.get("precision"), new.get("precision")
    return p is not None and q is not None and q - t < p - s


def operations(base: dict | None, head: dict | None) -> tuple[list[dict], list[tuple[str, str]]]:
    """(operations, refusals (code, name)) that make head of base, not in order yet.  Nothing is inferred: another name is
    another object; what has no safe statement is refused."""
    some = head or base
    kind = some["kind"]
    at = {"schema": some["schema"], "table": some["name"]}
    if base is None:
        if kind != "TABLE":
            return [{"op": f"create {kind.lower()}", "body": head}], []
        later = [c for c in head["constraints"] if c["type"] == "FK"]
        body = head | {"constraints": [c for c in head["constraints"] if c["type"] != "FK"], "indexes": []}
        return [{"op": "create table", "body": body}, *({"op": "add constraint", **at, "body": c} for c in later), *({"op": "create index", **at, "body": x} for x in head["indexes"])], []
    if head is None:
        drops = [{"op": "drop constraint", **at, "name": c["name"], "type": "FK"} for c in base.get("constraints", []) if c["type"] == "FK"]
        return [*drops, {"op": f"drop {kind.lower()}", "schema": base["schema"], "name": base["name"]}], []
    if _plain(base) == _plain(head):
        return [], []
    if kind == "SYNONYM":
        return [{"op": "drop synonym", "schema": base["schema"], "name": base["name"]}, {"op": "create synonym", "body": head}], []
    if kind == "SCHEMA":
        return [], [("SCHEMA_OWNER_CHANGE", head["name"])]
    if kind == "TYPE":
        return [], [("USER_TYPE_CHANGE", head["name"])]
    if kind == "SEQUENCE":
        changed = {k: v for k, v in head.items() if base.get(k) != v}
        if "type" in changed or "start" in changed or any(k not in head for k in base):
            return [], [("SEQUENCE_CHANGE", head["name"])]
        return [{"op": "alter sequence", "schema": base["schema"], "name": base["name"], "body": changed}], []
    ops: list[dict] = []
    refused: list[tuple[str, str]] = []
    old, new = ({fold(c["name"]): c for c in body["columns"]} for body in (base, head))
    kept = [n for n in old if n in new]
    if [n for n in new if n in old] != kept or [n for n in new][:len(kept)] != [n for n in new if n in old]:
        refused.append(("ORD001", head["name"]))
    for name, c in old.items():
        if name not in new:
            if c.get("default"):
                ops.append({"op": "drop constraint", **at, "name": c["default"]["name"], "type": "DF"})
            ops.append({"op": "drop column", **at, "name": c["name"]})
    for name, c in new.items():
        if name not in old:
            ops.append({"op": "add column", **at, "body": c})
            continue
        before = old[name]
        a, b = _plain(before), _plain(c)
        if a == b:
            continue
        if a.get("computed") != b.get("computed"):
            refused.append(("COMPUTED_CHANGE", c["name"]))
        elif a.get("identity") != b.get("identity"):
            refused.append(("IDENTITY_CHANGE", c["name"]))
        elif a.get("collation") != b.get("collation"):
            refused.append(("COLLATION_CHANGE", c["name"]))
        else:
            if a.get("default") != b.get("default"):
                if before.get("default"):
                    ops.append({"op": "drop constraint", **at, "name": before["default"]["name"], "type": "DF"})
                if c.get("default"):
                    ops.append({"op": "add constraint", **at, "body": {"type": "DF", **c["default"], "column": c["name"]}})
            if (a.get("type"), a.get("nullable")) != (b.get("type"), b.get("nullable")):
                users = column_users(base, before["name"])
                if users and not widens(before, c):
                    refused.append(("ALTER_COLUMN_DEPENDANTS", c["name"]))
                else:
                    ops.append({"op": "alter column", **at, "body": c})
    for field, made, gone in (("constraints", "add constraint", "drop constraint"), ("indexes", "create index", "drop index")):
        before, after = ({fold(x["name"]): x for x in body[field]} for body in (base, head))
        for name, x in before.items():
            if name not in after or _plain(x) != _plain(after[name]):
                ops.append({"op": gone, **at, "name": x["name"], **({"type": x["type"]} if field == "constraints" else {})})
        ops += [{"op": made, **at, "body": x} for name, x in after.items() if name not in before or _plain(x) != _plain(before[name])]
    return ops, refused


def widens(before: dict, after: dict) -> bool:
    """Only a longer text or binary type, and nothing else."""
    a, b = before["type"], after["type"]
    return (a["name"] == b["name"] and a["name"] in ("varchar", "nvarchar", "varbinary") and bool(before["nullable"]) == bool(after["nullable"]) and not narrower(a, b))


def column_users(table: dict, column: str) -> list[str]:
    """Names of the table's keys, checks, foreign keys, indexes and computed columns that use a column."""
    c = fold(column)
    listed = lambda cols: any(fold(x if isinstance(x, str) else x["name"]) == c for x in cols)
    out = [x["name"] for x in table["constraints"] if listed(x.get("columns", [])) or c in x.get("expression", [])]
    out += [x["name"] for x in table["indexes"] if listed(x["columns"]) or listed(x["included"]) or c in (x.get("filter") or [])]
    return out + [x["name"] for x in table["columns"] if c in x.get("computed", {}).get("expression", [])]


class Violation(ValueError):
    pass


def apply(body: dict | None, op: dict) -> dict | None:
    """The object after one operation; `Violation` where it doesn't fit."""
    kind, new = op["op"], op.get("body")
    if kind.startswith("create ") and kind != "create index":
        if body is not None:
            raise Violation("the object exists")
        if new["kind"] == "TABLE":
            seen: set = set()
            for c in new["columns"]:
                if fold(c["name"]) in seen:
                    raise Violation(f"the column {c['name']} is there twice")
                seen.add(fold(c["name"]))
        return copy.deepcopy(new)
    if body is None:
        raise Violation("no such object")
    if kind.startswith("drop ") and kind not in ("drop column", "drop constraint", "drop index"):
        return None
    body = copy.deepcopy(body)
    if kind == "alter sequence":
        return body | {k: v for k, v in new.items() if k != "restart"}
    columns = {fold(c["name"]): c for c in body["columns"]}

    def need(name: str) -> dict:
        if fold(name) not in columns:
            raise Violation(f"no column {name}")
        return columns[fold(name)]

    held = {fold(x["name"]) for x in (*body["constraints"], *body["indexes"])} | {fold(c["default"]["name"]) for c in body["columns"] if c.get("default")}
    if kind == "add column":
        if fold(new["name"]) in columns:
            raise Violation(f"the column {new['name']} exists")
        if new.get("nullable") is False and not new.get("default") and not new.get("computed") and not new.get("identity"):
            raise Violation(f"the column {new['name']} takes no null and has no default")
        body["columns"].append(new)
    elif kind == "drop column":
        c = need(op["name"])
        if c.get("default") or column_users(body, op["name"]):
            raise Violation(f"the column {op['name']} is in use")
        if len(columns) == 1:
            raise Violation("a table keeps a column")
        body["columns"] = [x for x in body["columns"] if x is not c]
    elif kind == "alter column":
        c = need(new["name"])
        if c.get("computed"):
            raise Violation(f"the column {new['name']} is computed")
        if column_users(body, new["name"]) and not widens(c, new):
            raise Violation(f"the column {new['name']} is in use")
        c |= {"type": new["type"], "nullable": new["nullable"]}
    elif kind in ("add constraint", "create index"):
        if fold(new["name"]) in held:
            raise Violation(f"{new['name']} exists")
        for x in new.get("columns", []) + new.get("included", []):
            need(x if isinstance(x, str) else x["name"])
        if new.get("type") == "DF":
            c = need(new["column"])
            if c.get("default"):
                raise Violation(f"the column {new['column']} has a default")
            c["default"] = {"name": new["name"], "expression": new["expression"]}
        else:
            if new.get("type") == "PK" and any(x["type"] == "PK" for x in body["constraints"]):
                raise Violation("a second primary key")
            if new.get("type") == "PK" and any(need(x["name"])["nullable"] for x in new["columns"]):
                raise Violation("a primary key on a column that takes null")
            if new.get("clustered") and any(x.get("clustered") for x in (*body["constraints"], *body["indexes"])):
                raise Violation("a second clustered index")
            body["constraints" if kind == "add constraint" else "indexes"].append(new)
    elif kind in ("drop constraint", "drop index"):
        field = "constraints" if kind == "drop constraint" else "indexes"
        left = [x for x in body[field] if fold(x["name"]) != fold(op["name"])]
        owner = next((c for c in body["columns"] if c.get("default") and fold(c["default"]["name"]) == fold(op["name"])), None) if field == "constraints" else None
        if owner is not None:
            owner.pop("default")
        elif len(left) == len(body[field]):
            raise Violation(f"no {kind.split()[1]} {op['name']}")
        body[field] = left
    elif kind == "rename" and op["what"] == "column":
        c = need(op["old"][2])
        if fold(op["new"]) in columns and fold(op["new"]) != fold(op["old"][2]):
            raise Violation(f"the column {op['new']} exists")
        was = fold(op["old"][2])
        if any(was in x.get("expression", []) for x in body["constraints"]) or any(was in (x.get("filter") or []) for x in body["indexes"]) or any(
                was in x.get("computed", {}).get("expression", []) for x in body["columns"]):
            raise Violation(f"an expression names {op['old'][2]}")
        c["name"] = op["new"]
        for x in (*body["constraints"], *body["indexes"]):
            for f in ("columns", "included"):
                x[f] = [op["new"] if y == op["old"][2] else y if isinstance(y, str) else y | {"name": op["new"] if fold(y["name"]) == was else y["name"]} for y in x.get(f, [])]
                if f == "included" and x in body["constraints"]:
                    x.pop(f)
    elif kind == "rename" and op["what"] == "object":
        body["name"] = op["new"]
    elif kind == "rename":
        x = next((x for x in body["indexes"] if fold(x["name"]) == fold(op["old"][2])), None)
        if x is None:
            raise Violation(f"no index {op['old'][2]}")
        x["name"] = op["new"]
    else:
        raise Violation(f"unknown operation {kind}")
    return body


def needs_allow(op: dict, before: dict | None, created: bool = False) -> list[str]:
    """The codes that an operation has to be allowed under; before: the object as it is (none: nothing can be ruled out)."""
    kind, body = op["op"], op.get("body", {})
    if kind in ("drop table", "drop column", "drop sequence", "drop type", "drop schema"):
        return [kind.upper().replace(" ", "_")]
    if kind == "rename":
        return ["RENAME"]
    there = before is not None and not created
    if kind == "create index":
        return ["LONG_LOCK"] if there else []
    if kind == "add constraint":
        return ["LONG_LOCK"] if there and body["type"] != "DF" else []
    if kind == "alter column":
        c = next((c for c in (before or {}).get("columns", []) if fold(c["name"]) == fold(body["name"])), None)
        if c is None or "type" not in c:
            lossy = retyped = True
            not_null = not body["nullable"]
        else:
            moved = fold(c.get("collation")) != fold(body.get("collation"))
            lossy = c["type"]["name"] != body["type"]["name"] or moved or narrower(c["type"], body["type"])
            retyped = moved or c["type"] != body["type"]
            not_null = c["nullable"] is not False and not body["nullable"]
        return [code for code, yes in (("ALTER_COLUMN_LOSSY", lossy), ("SET_NOT_NULL", not_null), ("LONG_LOCK", retyped and there)) if yes]
    if kind in ("drop index", "drop constraint"):
        items = (*(before or {}).get("constraints", []), *(before or {}).get("indexes", []))
        return ["LONG_LOCK"] if there and any(x.get("clustered") and fold(x["name"]) == fold(op["name"]) for x in items) else []
    return []


# ---- relations -------------------------------------------------------------------------------------------------

_PARSED = "{id} {kind}, key string, object_kind string, body string, problem string, at_line int"


def parse_objects(files: DataFrame, id_: str = "path", text: str = "text") -> DataFrame:
    """(id, key, object_kind, body, problem, at_line) of object files; a file that can't be read has its problem."""

    def read(source: str) -> tuple:
        try:
            body = ddl.object_of([b.text for b in batches(source or "")] or [""])
            return fold(ddl.key_of(body["kind"], body["schema"], body["name"])), body["kind"], ddl.dumps(body), None, None
        except Unreadable as e:
            return None, None, None, e.problem, e.line

    return _read_each(files, id_, text, read)


def parse_statements(rows: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, key, object_kind, body, problem, at_line): each text as one operation; object_kind holds its step."""

    def read(source: str) -> tuple:
        try:
            op = ddl.statement(source or "")
            return fold(op_key(op)), _step(op) if op["op"] != "drop constraint" else "drop constraint", ddl.dumps(op), None, None
        except Unreadable as e:
            return None, None, None, e.problem, e.line

    return _read_each(rows, id_, text, read)


def op_key(op: dict) -> str:
    """Identity of the object that an operation changes."""
    body = op.get("body", {})
    if op["op"] == "rename":
        return ddl.key_of("TABLE", op["old"][0], op["old"][1])
    if "table" in op:
        return ddl.key_of("TABLE", op["schema"], op["table"])
    return ddl.key_of(op["op"].split(" ")[1].upper(), op.get("schema", body.get("schema")), op.get("name") or body["name"])


def _read_each(rows: DataFrame, id_: str, text: str, read) -> DataFrame:
    def run(parts):
        for part in parts:
            got = [read(t) for t in part[text]]
            yield pd.DataFrame({id_: part[id_], **{c: [g[i] for g in got] for i, c in enumerate(("key", "object_kind", "body", "problem"))}, "at_line": pd.array([g[4] for g in got], "Int32")})

    return rows.select(id_, text).mapInPandas(run, _PARSED.format(id=id_, kind=rows.schema[id_].dataType.simpleString()))


def _pairs(base: DataFrame, head: DataFrame) -> DataFrame:
    return base.select("key", F.col("body").alias("a")).join(head.select("key", F.col("body").alias("b")), "key", "full").where("not a <=> b")


def _load(text) -> dict | None:
    return json.loads(text) if isinstance(text, str) else None


def diff_paths(base: DataFrame, head: DataFrame) -> DataFrame:
    """(key, path) of every difference between two models."""

    def run(parts):
        for part in parts:
            rows = [(k, p) for k, a, b in zip(part["key"], part["a"], part["b"]) for p in difference(_load(a), _load(b))]
            yield pd.DataFrame(rows, columns=["key", "path"])

    return _pairs(base, head).mapInPandas(run, "key string, path string")


def renamed(base: DataFrame, renames: DataFrame) -> DataFrame:
    """A model with renamed tables under their new keys and names; renames: key, new_key, new_name."""
    moved = base.join(renames, "key", "left")
    body = F.when(F.col("new_name").isNull(), F.col("body")).otherwise(
        F.regexp_replace("body", F.lit('(,"name":)"(?:[^"\\\\]|\\\\.)*"(,"schema":"(?:[^"\\\\]|\\\\.)*"\\})$'), F.concat(F.lit("$1"), F.to_json(F.array("new_name")).substr(F.lit(2), F.length(F.to_json(F.array("new_name"))) - 2), F.lit("$2"))))
    return moved.select(F.coalesce("new_key", "key").alias("key"), body.alias("body"))


def diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(step, key, name, op, code): the operations that make head of base, to be run in the order of step, key, name; code
    is set for a refusal, whose op is null.

    Each pair of objects gives its own operations.  Foreign keys that stay but reference a key that is dropped go before it
    and come again after, which takes a join of the foreign keys with the dropped keys.
    """

    def run(parts):
        for part in parts:
            rows = []
            for k, a, b in zip(part["key"], part["a"], part["b"]):
                base_, head_ = _load(a), _load(b)
                ops, refused = operations(base_, head_)
                for op in ops:
                    name = fold(op.get("name") or op.get("body", {}).get("name"))
                    key_columns = None
                    if op["op"] == "drop constraint" and op.get("type") in ("PK", "UQ"):
                        key_columns = sorted(fold(c["name"]) for x in base_["constraints"] if fold(x["name"]) == name for c in x["columns"])
                    rows.append((STEPS.index(_step(op)), k, name, ddl.dumps(op), None, key_columns))
                rows += [(-1, k, fold(n), None, code, None) for code, n in refused]
            yield pd.DataFrame(rows, columns=["step", "key", "name", "op", "code", "key_columns"])

    made = _pairs(base, head).mapInPandas(run, "step int, key string, name string, op string, code string, key_columns array<string>")
    from deltaloom.sources.staging import stage

    made = stage(made, "model-diff")

    def keys(parts):
        for part in parts:
            rows = []
            for k, body in zip(part["key"], part["body"]):
                b = json.loads(body)
                for c in b.get("constraints", []):
                    if c["type"] == "FK":
                        drop = {"op": "drop constraint", "schema": b["schema"], "table": b["name"], "name": c["name"], "type": "FK"}
                        add = {"op": "add constraint", "schema": b["schema"], "table": b["name"], "body": c}
                        rows.append((f"{k} {fold(c['name'])}", k, fold(c["name"]), fold(ddl.key_of("TABLE", c["ref_schema"], c["ref_table"])), sorted(map(fold, c["ref_columns"])), ddl.dumps(drop), ddl.dumps(add)))
            yield pd.DataFrame(rows, columns=["fk", "key", "name", "ref_table", "ref_columns", "drop", "add"])

    shape = "fk string, key string, name string, ref_table string, ref_columns array<string>, drop string, add string"
    foreign = head.mapInPandas(keys, shape).join(base.mapInPandas(keys, shape).select("fk"), "fk", "left_semi")
    dropped = made.where("key_columns is not null").select(F.col("key").alias("table"), F.col("key_columns").alias("columns"))
    again = foreign.join(graph.rebuilt_keys(foreign, dropped), "fk", "left_semi").join(
        made.where("op is not null").select("key", "name"), ["key", "name"], "left_anti")
    both = F.explode(F.array(F.struct(F.lit(STEPS.index("drop foreign key")).alias("step"), F.col("drop").alias("op")), F.struct(F.lit(STEPS.index("add foreign key")).alias("step"), F.col("add").alias("op"))))
    forced = again.select("key", "name", both.alias("x")).select("x.step", "key", "name", "x.op", F.lit(None).cast("string").alias("code"))
    return made.drop("key_columns").unionByName(forced)


def replay(base: DataFrame, ops: DataFrame) -> DataFrame:
    """(key, accepted, body, bad_index, problem): each object's operations in order; the first that doesn't fit stops the
    object.  base: key, body; ops: key, seq, op.  One object's operations are one array: they are few, however many
    objects there are."""

    def run(parts):
        for part in parts:
            rows = []
            for key, text, todo in zip(part["key"], part["body"], part["ops"]):
                body, done, problem = _load(text), 0, None
                for op in todo if todo is not None else ():
                    try:
                        body = apply(body, json.loads(op["op"]))
                    except Violation as e:
                        problem = str(e)
                        break
                    done += 1
                rows.append((key, done, ddl.dumps(body) if body else None, None if problem is None else done, problem))
            out = pd.DataFrame(rows, columns=["key", "accepted", "body", "bad_index", "problem"])
            yield out.astype({"bad_index": "Int64"})

    lists = ops.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "op"))).alias("ops")).select(F.col("key").alias("key"), F.col("ops").alias("ops"))
    whole = base.select(F.col("key").alias("key"), F.col("body").alias("body")).join(lists, "key", "full")
    return whole.select("key", "body", "ops").mapInPandas(run, "key string, accepted long, body string, bad_index long, problem string")


def prove(base: DataFrame, ops: DataFrame, head: DataFrame) -> DataFrame:
    """(key, path): what keeps the replay of ops over base from being head; empty if the operations are proven."""
    done = replay(base, ops)
    stopped = done.where("problem is not null").select("key", F.concat(F.lit("operation "), F.col("bad_index").cast("string"), F.lit(": "), F.col("problem")).alias("path"))
    return stopped.unionByName(diff_paths(done.where("body is not null").join(stopped, "key", "left_anti"), head.join(stopped, "key", "left_anti")))


def classified(ops: DataFrame, base: DataFrame) -> DataFrame:
    """(key, seq, code): what each operation has to be allowed for, against the model before the change."""

    def run(parts):
        for part in parts:
            rows = [(k, s, c) for k, s, o, b in zip(part["key"], part["seq"], part["op"], part["body"]) for c in needs_allow(json.loads(o), _load(b))]
            yield pd.DataFrame(rows, columns=["key", "seq", "code"])

    joined = ops.select("key", F.col("seq").cast("long").alias("seq"), "op").join(base.select("key", "body"), "key", "left")
    return joined.mapInPandas(run, "key string, seq long, code string")


def statements(ops: DataFrame) -> DataFrame:
    """ops (with op) and text, the statement."""

    def run(parts):
        for part in parts:
            yield part.assign(text=[ddl.text_of(json.loads(o)) if isinstance(o, str) else None for o in part["op"]])

    return ops.mapInPandas(run, _with_text(ops))


def _with_text(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", text string"


def files(model: DataFrame) -> DataFrame:
    """(key, text): each object as its file."""

    def run(parts):
        for part in parts:
            yield pd.DataFrame({"key": part["key"], "text": [ddl.file_text(json.loads(b)) for b in part["body"]]})

    return model.select("key", "body").mapInPandas(run, "key string, text string")


def text_differences(pairs: DataFrame) -> DataFrame:
    """(id, what, left, right) of pairs (id, a, b) of texts: runs of tokens that differ; unreadable texts are one run."""

    def run(parts):
        for part in parts:
            rows = []
            for i, a, b in zip(part["id"], part["a"], part["b"]):
                try:
                    rows += [(i, *d) for d in ddl.token_differences(a or "", b or "")]
                except Unreadable as e:
                    rows.append((i, "unreadable", e.problem, None))
            yield pd.DataFrame(rows, columns=["id", "what", "left", "right"])

    return pairs.mapInPandas(run, f"id {pairs.schema['id'].dataType.simpleString()}, what string, left string, right string")
