"""Readers of logs and small files: the log of migrations, migrations, tombstones, configuration, JSON lines.

A reader takes a relation of texts and gives rows; what can't be read becomes a row with its problem and line, beside the
good rows, so one bad text neither ends a job nor vanishes.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.functions import text as X
from deltaloom.functions import tokens as K

#: A file's name, the shape of a line, and the longest name.
FILE = r"[0-9]{4,}__[A-Za-z0-9_]+\.sql"
ENTRY = rf"^(\S+) sha256:([0-9a-f]{{64}}) (tx|nontx)( withdrawn)?(?: replaces=(\S+))?$"
NAME = 200


def chain(logs: DataFrame, header: str, log: str = "log", text: str = "text") -> DataFrame:
    """(log, pos, line, file, sha256, mode, withdrawn, replaces, problem) for each line after the header and, where a log
    lacks its header or the line break at its end, one row without a position.

    pos counts entries from 0; a first line 'baseline' is none but moves the lines down.  Problems: a line of another shape, a
    number not above every earlier one, a replaced file that is no earlier line, isn't withdrawn or has a replacement
    already.  Each log is one text, so windows inside a log are bounded by it.
    """
    lines = logs.select(F.col(log).alias("log"), F.split(X.plain_lines(F.col(text)), "\n").alias("l"))
    whole = lines.select("log", F.when(F.get("l", F.lit(0)) != header, "no header").when(F.element_at("l", -1) != "", "no line break at the end").alias("problem"),
                         F.when(F.get("l", F.lit(0)) != header, 1).otherwise(F.size("l")).alias("line"))
    broken = whole.where("problem is not null")
    rows = lines.join(broken.select("log"), "log", "left_anti").select("log", (F.get("l", F.lit(1)) == "baseline").alias("baseline"), F.posexplode(F.slice("l", F.lit(2), F.size("l") - 2)).alias("at", "raw"))
    rows = rows.where("not (baseline and at = 0)").withColumns({
        "line": F.col("at") + 2, "pos": F.col("at") - F.col("baseline").cast("int"), "shaped": F.col("raw").rlike(ENTRY),
        "file": F.regexp_extract("raw", ENTRY, 1), "sha256": F.regexp_extract("raw", ENTRY, 2), "mode": F.regexp_extract("raw", ENTRY, 3),
        "withdrawn": F.regexp_extract("raw", ENTRY, 4) != "", "replaces": F.regexp_extract("raw", ENTRY, 5)})
    valid = lambda c: F.col(c).rlike(f"^{FILE}$") & (F.length(c) <= NAME)
    good = F.col("shaped") & valid("file") & ((F.col("replaces") == "") | valid("replaces"))
    rows = rows.withColumn("good", good).withColumn("number", F.when(F.col("good"), F.split("file", "__")[0].cast("decimal(38,0)")))
    before = Window.partitionBy("log").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("log", "replaces").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"highest": F.max("number").over(before), "again": F.count(F.when(F.col("good") & (F.col("replaces") != ""), 1)).over(same)})
    target = rows.where("good").groupBy("log", F.col("file").alias("replaces")).agg(F.min(F.struct("at", "withdrawn")).alias("t"))
    rows = rows.join(target, ["log", "replaces"], "left")
    problem = (
        F.when(~F.col("good"), "not an entry").when(F.col("number") <= F.col("highest"), "number not above every earlier one")
        .when(F.col("replaces") != "", F.when(F.col("t").isNull() | (F.col("t.at") >= F.col("at")), "replaces no earlier line")
              .when(~F.col("t.withdrawn"), "replaces a line that is not withdrawn").when(F.col("again") > 0, "replaces a line that has a replacement")))
    kept = lambda c: F.when(F.col("good"), F.col(c))
    out = rows.select("log", F.col("pos").cast("int").alias("pos"), F.col("line").cast("int").alias("line"), *[kept(c).alias(c) for c in ("file", "sha256", "mode", "withdrawn")],
                      F.when(F.col("good") & (F.col("replaces") != ""), F.col("replaces")).alias("replaces"), problem.alias("problem"))
    none = {c: F.lit(None).cast(out.schema[c].dataType) for c in ("pos", "file", "sha256", "mode", "withdrawn", "replaces")}
    return out.unionByName(broken.withColumns(none).select(*out.columns))


def chain_text(entries: DataFrame, header: str) -> DataFrame:
    """(log, text): the log of entries again, the inverse of `chain`; a log is a text, and is put together as one."""
    line = F.concat(
        F.col("file"), F.lit(" sha256:"), F.col("sha256"), F.lit(" "), F.col("mode"), F.when(F.col("withdrawn"), " withdrawn").otherwise(""),
        F.when(F.col("replaces").isNotNull(), F.concat(F.lit(" replaces="), F.col("replaces"))).otherwise(""))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))), lambda x: F.concat(x["t"], F.lit("\n")))
    return entries.groupBy("log").agg(F.concat(F.lit(header + "\n"), F.array_join(rows, "")).alias("text"))


# ---- migrations ------------------------------------------------------------------------------------------------

_ALLOW = re.compile(r"([A-Z][A-Z0-9_]*)[ \t]+((?:\[(?:[^\]]|\]\])+\]|[^\s\[\]])+)[ \t]+reason:[ \t]*(\S.*)")
_RAW = re.compile(r"((?:\[(?:[^\]]|\]\])+\]|[^\s\[\]])+)[ \t]+reason:[ \t]*(\S.*)")
_TWO = re.compile(r"\[(?:[^\]]|\]\])+\]\.\[(?:[^\]]|\]\])+\]")
_MODE = re.compile(r"(tx|nontx)(?:[ \t]+expected-minutes:[ \t]*([0-9]+))?")


def migration(source: str, file: str, prefix: str) -> list[tuple]:
    """(batch, first line, kind, what, name, reason, line, mode, minutes, text) for each batch and each of its directives;
    what: 'batch', 'allow', 'deploy-module', 'unbind', 'raw'.  `Unreadable` for a text that breaks a rule."""
    if not re.fullmatch(FILE, file) or len(file) > NAME:
        raise K.Unreadable("the file name is no migration's", 1)
    head: dict[str, tuple[str, int]] = {}
    rows: list[tuple] = []
    starts: list[int] = []
    for number, part in enumerate(K.batches(source), 1):
        shift = part.first_line - 1
        if part.repeat != 1:
            raise K.Unreadable("a GO count is not allowed", part.first_line)
        toks = K.scan(part.text)
        code = [t.line for t in toks if t.kind not in K.TRIVIA]
        if not code:
            raise K.Unreadable("a batch without a statement", part.first_line)
        found = {d.line: d for d in K.directives(part.text, prefix)}
        kind, mine, first_line_of_batch = "model", [], True
        for t in toks:
            if t.kind in ("ws", "nl"):
                continue
            line, is_directive = shift + t.line, t.kind == "comment" and t.text.startswith(prefix)
            d = found.get(t.line) if is_directive else None
            if d is None:
                if is_directive:
                    raise K.Unreadable("a directive starts in the first column", line)
                first_line_of_batch = False
                continue
            above = t.line < code[0]
            if d.name in ("migration", "mode"):
                if number > 1 or not above:
                    raise K.Unreadable(f"{d.name} has to stand above the first statement", line)
                if d.name in head:
                    raise K.Unreadable(f"{d.name} is given twice", line)
                head[d.name] = (d.args, line)
                first_line_of_batch = True
                continue
            if d.name in ("data", "raw"):
                if not first_line_of_batch:
                    raise K.Unreadable(f"{d.name} has to be the first line of its batch", line)
                kind = d.name
                m = _RAW.fullmatch(d.args) if kind == "raw" else None
                if kind == "data" and d.args or kind == "raw" and not (m and re.fullmatch(rf"({'|'.join(X.FOLDERS)}):(?:\[(?:[^\]]|\]\])+\]\.?)+", m[1])):
                    raise K.Unreadable(f"{kind} has another form", line)
                if m:
                    mine.append(("raw", m[1], m[2], line))
            elif d.name == "allow":
                m = _ALLOW.fullmatch(d.args)
                if not m or code[-1] < d.line:
                    raise K.Unreadable("allow has another form" if not m else "allow has to stand above a statement", line)
                mine.append(("allow", f"{m[1]} {m[2]}", m[3], line))
            elif d.name in ("deploy-module", "unbind"):
                if not _TWO.fullmatch(d.args) or not above:
                    raise K.Unreadable(f"{d.name} has another form" if above else f"{d.name} has to stand above the first statement", line)
                mine.append((d.name, d.args, None, line))
            else:
                raise K.Unreadable("unknown directive", line)
            first_line_of_batch = False
        starts.append(part.first_line)
        rows.append((number, part.first_line, kind, "batch", None, None, part.first_line, part.text))
        rows += [(number, part.first_line, kind, *x, None) for x in mine]
    for name in ("migration", "mode"):
        if name not in head:
            raise K.Unreadable(f"{name} is missing above the first statement", 1)
    if head["migration"][0] != file.removesuffix(".sql"):
        raise K.Unreadable("migration is not the file's name", head["migration"][1])
    m = _MODE.fullmatch(head["mode"][0])
    minutes = int(m[2]) if m and m[2] else None
    if not m or minutes == 0:
        raise K.Unreadable("mode has another form", head["mode"][1])
    if m[1] == "nontx" and len(starts) != 1:
        raise K.Unreadable("a nontx migration is one batch", starts[1] if len(starts) > 1 else 1)
    return [(*r[:7], m[1], minutes, r[7]) for r in rows]


_MIGRATION = "batch int, first_line int, kind string, what string, name string, reason string, line int, mode string, minutes int, text string, problem string"


def migrations(files: DataFrame, prefix: str, file: str = "file", text: str = "text") -> DataFrame:
    """`migration` of each text, beside its file; an unreadable one is one row with its problem and line."""
    names = [x.split(" ")[0] for x in _MIGRATION.split(", ")]

    def run(parts):
        for part in parts:
            rows = []
            for f, t in zip(part[file], part[text]):
                try:
                    rows += [(f, *r, None) for r in migration(t or "", f or "", prefix)]
                except K.Unreadable as e:
                    rows.append((f, *[None] * 6, e.line, *[None] * 3, e.problem))
            out = pd.DataFrame(rows, columns=[file, *names])
            yield out.astype({c: "Int32" for c in ("batch", "first_line", "line", "minutes")})

    return files.select(file, text).mapInPandas(run, f"{file} string, {_MIGRATION}")


# ---- small files -----------------------------------------------------------------------------------------------

def tombstones(files: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, object, reason, problem) of files that hold [[drop]] tables of a module's key and a reason."""
    key = re.compile(rf"({'|'.join(X.MODULE_KINDS)}):\[(?:[^\]]|\]\])+\]\.\[(?:[^\]]|\]\])+\]")

    def read(source: str) -> list[tuple]:
        try:
            held = tomllib.loads(source.removeprefix("﻿"))
        except tomllib.TOMLDecodeError:
            return [(None, None, "not valid TOML")]
        drops = held.pop("drop", [])
        if held or not isinstance(drops, list):
            return [(None, None, "holds more than [[drop]] tables")]
        out, seen = [], set()
        for n, d in enumerate(drops, 1):
            if not isinstance(d, dict) or set(d) != {"object", "reason"} or not all(isinstance(v, str) for v in d.values()):
                return [(None, None, f"drop {n}: needs object and reason, no more")]
            if not d["reason"].strip() or not key.fullmatch(d["object"]) or d["object"] in seen:
                why = "has no reason" if not d["reason"].strip() else "is listed twice" if d["object"] in seen else "names no module"
                return [(None, None, f"drop {n}: {why}")]
            seen.add(d["object"])
            out.append((d["object"], d["reason"], None))
        return out

    def run(parts):
        for part in parts:
            rows = [(i, *r) for i, t in zip(part[id_], part[text]) for r in read(t or "")]
            yield pd.DataFrame(rows, columns=[id_, "object", "reason", "problem"])

    return files.select(id_, text).mapInPandas(run, f"{id_} {files.schema[id_].dataType.simpleString()}, object string, reason string, problem string")


#: Keys that a configuration may have, by table; no others.
CONFIG = {
    "project": {"name", "tenant_id", "table_model", "module_chunk"}, "identities": None, "scope": {"schemas", "exclude", "exclude_objects"},
    "env": {"plan_identity", "deploy_identity", "drift", "gated", "auth", "targets", "not_managed"}, "products": {"objects", "owners", "promote_to"},
}
#: Environments in the order of promotion.
PROMOTION = ["dev", "test", "acc", "prod"]


def config(source: str) -> Mapping:
    """A configuration file; ValueError names the first key that it doesn't know.  One small file on the driver."""
    held = tomllib.loads(source.removeprefix("﻿"))
    for table, body in held.items():
        if table not in CONFIG:
            raise ValueError(f"unknown table [{table}]")
        for name, value in ([(table, body)] if table in ("project", "scope") else body.items() if table in ("env", "products") else []):
            unknown = set(value) - CONFIG[table]
            if unknown:
                raise ValueError(f"unknown key {min(unknown)} in [{table}{'' if name == table else '.' + name}]")
    if "name" not in held.get("project", {}):
        raise ValueError("[project] needs a name")
    return held


def targets(spark: SparkSession, held: Mapping, env: str) -> DataFrame:
    """(id, server, database, plan_client, deploy_client, gated, auth): a row for each target of an environment."""
    if env not in held.get("env", {}):
        raise ValueError(f"no [env.{env}]")
    body, ids = held["env"][env], held.get("identities", {})
    shape = "id string, server string, database string, plan_client string, deploy_client string, gated boolean, auth string"
    rows = [(t["id"], t["server"], t["database"], ids.get(body.get("plan_identity")), ids.get(body.get("deploy_identity")), bool(body.get("gated", False)), body.get("auth", "oidc")) for t in body.get("targets", [])]
    return spark.createDataFrame(rows, shape)


# ---- events ----------------------------------------------------------------------------------------------------

EVENT = T.StructType([
    T.StructField("ts", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("session", T.StringType()),
    T.StructField("ms", T.StringType()), T.StructField("error", T.StringType()), T.StructField("n", T.LongType()), T.StructField("_bad", T.StringType()),
])


def events(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines of JSON as events: blank lines are none, a line that is no JSON object keeps its text in _bad.  ms stays text,
    so a value that is no number can count as 0 later."""
    t = F.trim(F.col(text))
    parsed = F.from_json(F.col(text), EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    others = [c for c in lines.columns if c != text]
    rows = lines.where(t != "").select(*others, parsed.alias("e"), t.startswith("{").alias("o"), F.col(text).alias("raw"))
    bad = F.when(~F.col("o") | F.col("e").isNull() | F.col("e._bad").isNotNull(), F.col("raw"))
    keep = [f.name for f in EVENT.fields if f.name != "_bad"]
    return rows.select(*others, bad.alias("_bad"), *[F.when(bad.isNull(), F.col(f"e.{c}")).alias(c) for c in keep])


def summary(found: DataFrame, by: str) -> DataFrame:
    """(by, runs, batches, ms, errors, last_kind, span, bad): the last run of each log, in sums that need no order but the
    largest run's; found: by, seq, kind, ts, ms, error, _bad."""
    runs = found.where("_bad is null and kind = 'run'").groupBy(by).agg(F.max("seq").alias("start"), F.count(F.lit(1)).alias("runs"))
    last = found.join(runs, by, "left").where("_bad is not null or start is null or seq >= start")
    is_batch = F.col("kind") == "batch"
    ms = F.coalesce(F.col("ms").try_cast("double"), F.lit(0.0)).cast("decimal(18,3)")
    out = last.groupBy(by).agg(
        F.coalesce(F.max("runs"), F.lit(0)).alias("runs"), F.count(F.when(is_batch, 1)).alias("batches"), F.coalesce(F.sum(F.when(is_batch, ms)), F.lit(0)).cast("double").alias("ms"),
        F.count(F.when(is_batch & F.col("error").isNotNull(), 1)).alias("errors"), F.max_by("kind", F.when(F.col("_bad").isNull(), F.col("seq"))).alias("last_kind"),
        F.min_by("ts", F.when(F.col("_bad").isNull(), F.col("seq"))).alias("a"), F.max_by("ts", F.when(F.col("_bad").isNull(), F.col("seq"))).alias("b"),
        F.count("_bad").alias("bad"))
    return out.select(by, "runs", "batches", "ms", "errors", "last_kind", X.span_seconds(F.col("a"), F.col("b")).alias("span"), "bad")
