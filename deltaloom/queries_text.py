"""Queries of the readers and text functions over texts that are made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.functions import text as X
from deltaloom.functions import tokens
from deltaloom.operators import graph
from deltaloom.plans import lint, rules
from deltaloom.registry import query, table
from deltaloom.sources import files, logs
from deltaloom.sources.staging import stage_path

PREFIX = "-- deltaloom:"


def lateral(df, function: str, columns: str, *more: str):
    """The rows of a table function over df's column t, beside the other columns."""
    tokens.register(df)
    df.createOrReplaceTempView("deltaloom_lateral")
    args = ", ".join(["t", *more])
    return df.sparkSession.sql(f"select {columns} from deltaloom_lateral, lateral {function}({args})")


_NAMES = "case p_partkey % 6 when 0 then p_name when 1 then 'con' when 2 then p_name || '.' when 3 then p_name || '?' when 4 then '' else p_name || ']x' end"


@query(f"""with n as (select p_partkey, p_brand as schema, {_NAMES} as name, case p_partkey % 5 when 0 then 'VIEW' when 1 then 'TABLE' when 2 then 'SCHEMA' when 3 then 'TRIGGER' else 'THING' end as kind from part),
q as (select *, '[' || replace(schema, ']', ']]') || ']' as qs, case when name <> '' then '[' || replace(name, ']', ']]') || ']' end as qn,
 case when name = '' and kind = 'SCHEMA' then 'empty' when name like '%?' then 'unsafe character' when name like '%.' then 'ends with dot or space' when name = 'con' and kind = 'SCHEMA' then 'device name' end as problem from n)
select p_partkey, case when kind = 'SCHEMA' then 'SCHEMA:' || qn when kind <> 'THING' then kind || ':' || qs || '.' || qn end as key, case when kind <> 'THING' and qn is not null then name end as back,
 case when kind = 'SCHEMA' then case when problem is null then 'schema/schemas/' || name || '.sql' end
  when kind <> 'THING' and (problem is null or problem = 'device name') and name <> '' then 'schema/' || case kind when 'VIEW' then 'views' when 'TABLE' then 'tables' else 'triggers' end || '/' || schema || '.' || name || '.sql' end as path from q""")
def object_names(spark, d):
    n = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("schema"), F.expr(_NAMES).alias("name"), F.expr(
        "case p_partkey % 5 when 0 then 'VIEW' when 1 then 'TABLE' when 2 then 'SCHEMA' when 3 then 'TRIGGER' else 'THING' end").alias("kind"))
    schema = F.when(F.col("kind") != "SCHEMA", F.col("schema"))
    keyed = n.withColumn("key", X.object_key(F.col("kind"), schema, F.col("name")))
    return keyed.select("p_partkey", "key", X.key_parts(F.col("key"))["name"].alias("back"), X.path_for(F.col("kind"), schema, F.col("name")).alias("path"))


@query("""select p_partkey, case p_partkey % 6 when 0 then null when 1 then 'device name' when 2 then 'ends with dot or space' when 3 then 'unsafe character' when 4 then 'empty' end as problem from part""")
def path_problems(spark, d):
    return table(spark, d, "part").select("p_partkey", X.path_problem(F.concat(F.lit("a/"), F.expr(_NAMES), F.lit("/b.sql"))).alias("problem"))


@query("""select p_partkey, '[' || p_brand || '].[' || p_partkey || ']' as name, p_partkey % 2 = 0 as bound, 'CREATE OR ALTER' as verb, case when p_partkey % 3 = 0 then 'VIEW' else 'PROCEDURE' end as kind,
 case when p_partkey % 7 = 6 then 'no module header' end as problem from part where p_partkey % 7 <> 6 union all select p_partkey, null, null, null, null, 'no module header' from part where p_partkey % 7 = 6""")
def module_headers(spark, d):
    kind = F.when(F.col("p_partkey") % 3 == 0, " view ").otherwise(" proc ")
    option = F.when(F.col("p_partkey") % 2 == 0, " with /* as */ schemabinding").otherwise("")
    source = F.when(F.col("p_partkey") % 7 == 6, "select 1").otherwise(F.concat(F.lit("-- c\ncreate Or alter"), kind, F.lit("["), "p_brand", F.lit("].["), F.col("p_partkey").cast("string"), F.lit("]"), option, F.lit("\nAS select 'x'")))
    rows = lateral(table(spark, d, "part").select("p_partkey", source.alias("t")), "module_header", "p_partkey, verb, kind, schema, name, bound, problem")
    return rows.select("p_partkey", X.qualified(F.col("schema"), F.col("name")).alias("name"), "bound", "verb", "kind", "problem")


@query("""with e as (select p_partkey as node, p_partkey // 2 as need from part where p_partkey > 1 union select p_partkey, p_partkey + 1 from part where p_partkey % 10 = 0 and p_partkey + 1 <= (select max(p_partkey) from part))
select distinct node, need from e where not (node % 9 = 0 and need = node // 2) and node <> need""")
def text_dependencies(spark, d):
    # each part's text names the part of half its number; a stated need is added, an ignored one taken away
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    source = F.concat(F.lit("select [x], 'p.p3' from p.[p"), F.floor(F.col("node") / 2).cast("string"), F.lit("] -- p.p1\nwhere @v.p1 = 1"))
    objects = p.select("node", F.lit("p").alias("schema"), F.concat(F.lit("p"), F.col("node").cast("string")).alias("name"))
    named = lateral(p.where("node > 1").select("node", source.alias("t")), "object_names", "node, schema, name").select("node", X.fold(F.col("schema")).alias("schema"), X.fold(F.col("name")).alias("name"))
    stated = lambda rows, need: rows.select("node", F.lit("p").alias("schema"), F.concat(F.lit("p"), need.cast("string")).alias("name"))
    return graph.text_edges(named, objects, stated(p.where("node % 10 = 0"), F.col("node") + 1), stated(p.where("node % 9 = 0"), F.floor(F.col("node") / 2)))


@query("""select p_partkey, first_line, repeat, batch from (select p_partkey, 1 as first_line, 1 as repeat, 'a ' || p_name || chr(10) || '/* GO' || chr(10) || 'GO */' || chr(10) || '  ' as batch from part
 union all select p_partkey, 5, p_size, '''x' || chr(10) || 'GO''' from part union all select p_partkey, 8, 1, 'GO x' from part where p_partkey % 2 = 0)""")
def go_batches(spark, d):
    source = F.concat(F.lit("a "), "p_name", F.lit("\n/* GO\nGO */\n  go -- end\n'x\nGO'\nGO "), F.col("p_size").cast("string"), F.lit("\n"), F.when(F.col("p_partkey") % 2 == 0, "GO x").otherwise("\n"))
    return lateral(table(spark, d, "part").select("p_partkey", source.alias("t")), "split_batches", "p_partkey, first_line, repeat, batch")


@query("""select p_partkey, 'allow' as name, p_name as args, 1 as line from part union all select p_partkey, 'mode', 'tx', 3 from part where p_partkey % 3 = 0""")
def text_directives(spark, d):
    source = F.concat(F.lit(PREFIX + "allow "), "p_name", F.lit(f"\n /* {PREFIX}no */ select '\n'"), F.when(F.col("p_partkey") % 3 == 0, f"\n{PREFIX}mode tx").otherwise(f" {PREFIX}mode tx"))
    source = F.regexp_replace(source, "select '\n'", "select 1")
    return lateral(table(spark, d, "part").select("p_partkey", source.alias("t")), "directives", "p_partkey, name, args, line", f"'{PREFIX}'")


_LOG = "sum 1"


@query("""with f as (select p_partkey as log, lpad(cast(p_partkey + 1 as varchar), 4, '0') as n, sha256(p_name) as s from part)
select log, 0 as pos, 2 + cast(log % 4 = 1 as int) as line, n || '__a.sql' as file, s as sha256, 'tx' as mode, log % 5 <> 2 as withdrawn, null as replaces, null as problem from f where log % 7 <> 3
union all select log, 1, 3 + cast(log % 4 = 1 as int), case when log % 6 = 4 then '0000' else '9' || n end || '__b.sql', s, 'nontx', false, n || '__a.sql',
 case when log % 6 = 4 then 'number not above every earlier one' when log % 5 = 2 then 'replaces a line that is not withdrawn' end from f where log % 7 <> 3
union all select log, 2, 4 + cast(log % 4 = 1 as int), case when log % 3 > 0 then '99' || n || '__c.sql' end, case when log % 3 > 0 then s end, case when log % 3 > 0 then 'tx' end, case when log % 3 > 0 then false end,
 case when log % 3 > 0 then n || '__a.sql' end, case when log % 3 = 0 then 'not an entry' when log % 5 = 2 then 'replaces a line that is not withdrawn' else 'replaces a line that has a replacement' end from f where log % 7 <> 3
union all select log, null, case when log % 2 = 0 then 1 else 4 end, null, null, null, null, null, case when log % 2 = 0 then 'no header' else 'no line break at the end' end from f where log % 7 = 3""")
def chain_log(spark, d):
    k, n = F.col("p_partkey"), F.lpad((F.col("p_partkey") + 1).cast("string"), 4, "0")
    sha = F.concat(F.lit(" sha256:"), F.sha2(F.col("p_name").cast("binary"), 256))
    a = F.concat(n, F.lit("__a.sql"), sha, F.lit(" tx"), F.when(k % 5 != 2, " withdrawn").otherwise(""), F.lit("\r\n"))
    b = F.concat(F.when(k % 6 == 4, "0000").otherwise(F.concat(F.lit("9"), n)), F.lit("__b.sql"), sha, F.lit(" nontx replaces="), n, F.lit("__a.sql\n"))
    c = F.when(k % 3 == 0, F.concat(n, F.lit("__c.sql  two blanks\n"))).otherwise(F.concat(F.lit("99"), n, F.lit("__c.sql"), sha, F.lit(" tx replaces="), n, F.lit("__a.sql\n")))
    good = F.concat(F.lit(_LOG + "\n"), F.when(k % 4 == 1, "baseline\n").otherwise(""), a, b, c)
    broken = F.when(k % 2 == 0, "other\n").otherwise(F.concat(F.lit(f"{_LOG}\n\n\nx")))
    return logs.chain(table(spark, d, "part").select(k.alias("log"), F.when(k % 7 == 3, broken).otherwise(good).alias("text")), _LOG)


@query("""select p_partkey as log, sha256('sum 1' || chr(10) || lpad(cast(p_partkey as varchar), 4, '0') || '__a.sql sha256:' || sha256(p_name) || ' tx withdrawn' || chr(10) || '9' || lpad(cast(p_partkey as varchar), 4, '0') || '__b.sql sha256:' || sha256(p_name)
 || ' tx replaces=' || lpad(cast(p_partkey as varchar), 4, '0') || '__a.sql' || chr(10)) as sha from part""")
def chain_text(spark, d):
    n, sha = F.lpad(F.col("p_partkey").cast("string"), 4, "0"), F.sha2(F.col("p_name").cast("binary"), 256)
    source = F.concat(F.lit(_LOG + "\n"), n, F.lit("__a.sql sha256:"), sha, F.lit(" tx withdrawn\n9"), n, F.lit("__b.sql sha256:"), sha, F.lit(" tx replaces="), n, F.lit("__a.sql\n"))
    held = logs.chain(table(spark, d, "part").select(F.col("p_partkey").alias("log"), source.alias("text")), _LOG)
    return logs.chain_text(held.where("problem is null"), _LOG).select("log", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query("""with f as (select p_partkey, lpad(cast(p_partkey as varchar), 4, '0') || '__m.sql' as file, case when p_partkey % 3 = 0 and p_partkey > 0 then p_partkey end as minutes from part),
g as (select * from f where p_partkey % 8 <> 5)
select file, 1 as batch, 'batch' as what, null as name, 'model' as kind, 1 as line, minutes, null as problem from g
union all select file, 1, 'allow', 'DROP_TABLE [s].[t' || p_partkey || ']', 'model', 3, minutes, null from g
union all select file, 2, 'batch', null, 'data', 6, minutes, null from g union all select file, 2, 'unbind', '[s].[v]', 'data', 7, minutes, null from g
union all select file, null, null, null, null, 5, null, 'unknown directive' from f where p_partkey % 8 = 5""")
def migration_reader(spark, d):
    k = F.col("p_partkey")
    file = F.concat(F.lpad(k.cast("string"), 4, "0"), F.lit("__m.sql"))
    minutes = F.when((k % 3 == 0) & (k > 0), F.concat(F.lit(" expected-minutes: "), k.cast("string"))).otherwise("")
    head = F.concat(F.lit(PREFIX + "migration "), F.regexp_replace(file, "\\.sql", ""), F.lit(f"\n{PREFIX}mode tx"), minutes)
    body = F.concat(F.lit(f"\n{PREFIX}allow DROP_TABLE [s].[t"), k.cast("string"), F.lit(f"] reason: old\nDROP TABLE s.t\nGO\n{PREFIX}data\n{PREFIX}unbind [s].[v]\nUPDATE s.t SET a = 1\n"))
    source = F.concat(head, F.when(k % 8 == 5, f"\nSELECT 1\nGO\n{PREFIX}what\nSELECT 2\n").otherwise(body))
    rows = logs.migrations(table(spark, d, "part").select(file.alias("file"), source.alias("text")), PREFIX)
    return rows.select("file", "batch", "what", "name", "kind", "line", F.col("minutes").cast("long").alias("minutes"), "problem")


@query("""select s_suppkey as id, 'VIEW:[s].[' || s_name || ']' as object, 'old' as reason, null as problem from supplier where s_suppkey % 4 < 2 union all select s_suppkey, null, null, 'drop 1: names no module' from supplier where s_suppkey % 4 = 2
 union all select s_suppkey, null, null, 'not valid TOML' from supplier where s_suppkey % 4 = 3""")
def tombstone_reader(spark, d):
    kind = F.expr("case s_suppkey % 4 when 2 then 'TABLE' else 'VIEW' end")
    source = F.concat(F.lit('[[drop]]\nobject = "'), kind, F.lit(":[s].["), "s_name", F.lit(']"\nreason = "old"'), F.when(F.col("s_suppkey") % 4 == 3, "x").otherwise("\n"))
    return logs.tombstones(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), source.alias("text")))


@query("""select 'n' || n_nationkey as id, 'r' || n_regionkey || '.example' as server, n_name as database, 'id1' as plan_client, 'id2' as deploy_client, true as gated, 'oidc' as auth from nation where n_regionkey = 1""")
def target_matrix(spark, d):
    # a configuration of a fixed size: the nations of each region are its environment's targets
    rows = table(spark, d, "nation").collect()
    text = '[project]\nname = "x"\n[identities]\na = "id1"\nb = "id2"\n'
    for r in sorted({x["n_regionkey"] for x in rows}):
        held = ", ".join(f'{{id = "n{x["n_nationkey"]}", server = "r{r}.example", database = "{x["n_name"]}"}}' for x in rows if x["n_regionkey"] == r)
        text += f'[env.e{r}]\nplan_identity = "a"\ndeploy_identity = "b"\ngated = {str(r % 2 == 1).lower()}\ntargets = [{held}]\n'
    return logs.targets(spark, logs.config(text), "e1")


def _lines(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    kind = F.when(F.col("event_id") % 10 == 0, "run").otherwise("batch")
    ms = F.when(F.col("event_id") % 3 == 0, F.lit('"slow"')).otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    error = F.when(F.col("event_type") == "error", F.lit(',"error":{"number":1205}')).otherwise("")
    good = F.concat(F.lit('{"ts":"2024-01-01T00:00:'), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit('.000Z","seq":'), F.col("event_id").cast("string"), F.lit(',"kind":"'), kind, F.lit('","ms":'), ms, error, F.lit("}"))
    return e.select("user_id", F.when(F.col("event_id") % 17 == 5, F.substring(good, 1, 20)).when(F.col("event_id") % 17 == 6, "[1]").when(F.col("event_id") % 17 == 7, "  ").otherwise(good).alias("value"))


_EVENTS = """e as (select user_id, event_id as seq, case when event_id % 10 = 0 then 'run' else 'batch' end as kind, case when event_id % 3 = 0 then 0 else cast(value as decimal(18,2)) end as ms, event_type = 'error' as failed,
 event_id % 17 in (5, 6) as bad from events where event_id % 17 <> 7)"""


@query(f"with {_EVENTS} select user_id, case when not bad then seq end as seq, case when not bad then kind end as kind, bad, not bad and failed as failed from e")
def json_events(spark, d):
    found = logs.events(_lines(spark, d))
    return found.select("user_id", "seq", "kind", F.col("_bad").isNotNull().alias("bad"), F.col("error").isNotNull().alias("failed"))


@query(f"""with {_EVENTS}, g as (select * from e where not bad), r as (select user_id, max(seq) as start, count(*) as runs from g where kind = 'run' group by 1),
l as (select g.*, r.runs from g left join r using (user_id) where start is null or seq >= start), b as (select user_id, count(*) as bad from e where bad group by 1),
s as (select user_id, coalesce(max(runs), 0) as runs, count(*) filter (where kind = 'batch') as batches, cast(coalesce(sum(ms) filter (where kind = 'batch'), 0) as double) as ms, count(*) filter (where kind = 'batch' and failed) as errors,
 arg_max(kind, seq) as last_kind, arg_max(seq % 60, seq) - arg_min(seq % 60, seq) as span from l group by 1)
select user_id, coalesce(runs, 0) as runs, coalesce(batches, 0) as batches, coalesce(ms, 0) as ms, coalesce(errors, 0) as errors, last_kind, case when span is null then 'unknown' else span || '.0 s' end as span, coalesce(bad, 0) as bad from s full join b using (user_id)""")
def log_summary(spark, d):
    return logs.summary(logs.events(_lines(spark, d)), "user_id")


def _tree(spark, d, changed: bool):
    """The folder of a revision: a file for each nation, in a folder of its own."""
    n = table(spark, d, "nation")
    if changed:
        n = n.where("n_nationkey <> 3").withColumn("n_name", F.expr("case when n_nationkey % 7 = 1 then n_name || '!' else n_name end")).unionByName(n.where("n_nationkey = 4").withColumn("n_nationkey", F.lit(99)))
    root = stage_path(spark, "tree")
    n.select("n_nationkey", F.col("n_name").alias("value")).coalesce(1).write.partitionBy("n_nationkey").text(root)
    return root


def _plain(df):
    return df.withColumn("path", F.regexp_extract("path", r"(n_nationkey=[0-9]+)/", 1))


@query("""select 'n_nationkey=' || n_nationkey as path, sha256(n_name || chr(10)) as sha256, length(n_name) + 1 as bytes from nation""")
def working_tree(spark, d):
    return _plain(files.tree(spark, _tree(spark, d, False), "*.txt")).select("path", "sha256", "bytes")


@query("""select 'n_nationkey=' || n_nationkey as path, case when n_nationkey = 3 then 'removed' else 'changed' end as change from nation where n_nationkey = 3 or n_nationkey % 7 = 1 union all select 'n_nationkey=99', 'added'""")
def revision_changes(spark, d):
    held = _plain(files.revisions(spark, {"base": _tree(spark, d, False), "head": _tree(spark, d, True)}))
    return files.revision_changes(held, "base", "head")


@query("""select 'n_nationkey=' || n_nationkey as path, case when n_nationkey = 3 then 'missing' else 'other content' end as problem from nation where n_nationkey = 3 or n_nationkey % 7 = 1 union all select 'n_nationkey=99', 'not listed'""")
def bundle_check(spark, d):
    manifest = table(spark, d, "nation").select(F.concat(F.lit("n_nationkey="), F.col("n_nationkey").cast("string")).alias("path"), F.sha2(F.concat("n_name", F.lit("\n")).cast("binary"), 256).alias("sha256"))
    return files.check_bundle(_plain(files.tree(spark, _tree(spark, d, True), "*.txt")), manifest)


@query("""select row_number() over (order by n_name) - 1 as pos, '{"path":"' || n_name || '","sha256":"' || sha256(n_name) || '"}' as line from nation""")
def manifest_lines(spark, d):
    path = stage_path(spark, "manifest")
    files.write_manifest(table(spark, d, "nation").select(F.col("n_name").alias("path"), F.sha2(F.col("n_name").cast("binary"), 256).alias("sha256")), path)
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


@query("""select l_partkey as file, min(l_orderkey) as release from lineitem group by 1""")
def first_seen(spark, d):
    return files.first_seen(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("release"), F.col("l_partkey").alias("file")))


@query("""select p_partkey, case p_partkey % 4 when 0 then 'nvarchar(' || p_size || ')' when 1 then 'varchar(max)' when 2 then 'decimal(' || p_size || ', 2)' else 'int' end as type,
 case when p_partkey % 3 = 0 then p_size || ' MONTHS' end as kept, p_size < 20 as narrower, p_size > 20 as widens, 'partial(' || p_size || ', "x, Y", 0)' as mask from part""")
def type_values(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    name = F.expr("case p_partkey % 4 when 0 then 'nvarchar' when 1 then 'varchar' when 2 then 'decimal' else 'int' end")
    length = F.expr("case p_partkey % 4 when 0 then 2 * p_size when 1 then -1 else 5 end")
    kept = X.retention(F.when(k % 3 == 0, F.col("p_size")).otherwise(-1), F.lit(5))
    of = lambda n: F.struct(F.lit("varchar").alias("name"), n.alias("length"), F.lit(None).cast("int").alias("precision"), F.lit(None).cast("int").alias("scale"))
    return p.select(
        "p_partkey", X.type_text(name, length, F.col("p_size"), F.lit(2)).alias("type"), F.concat(kept["n"].cast("string"), F.lit(" "), kept["unit"]).alias("kept"),
        X.narrower(of(F.lit(20)), of(F.col("p_size"))).alias("narrower"), X.only_widens(of(F.lit(20)), of(F.col("p_size"))).alias("widens"),
        X.mask_spelling(F.concat(F.lit('Partial( '), F.lpad(F.col("p_size").cast("string"), 5, "0"), F.lit(',"x, Y" ,0)')), F.lit(None).cast("int")).alias("mask"))


@query("""select event_id, '<hidden> sent <hidden> to ' || event_type || '; <hidden>' as message, 'a\\|b ' || event_type as shown, event_type as tag from events""")
def log_texts(spark, d):
    e = table(spark, d, "events")
    message = F.concat(F.lit("bob sent p}}w to "), "event_type", F.lit("; UID=bob;PWD=p}w;"), F.col("event_id").cast("string"))
    return e.select("event_id", X.hide_echo(message, "bob", "p}w").alias("message"), X.cell(F.concat(F.lit("a|b\n"), "event_type")).alias("shown"), X.batch_tag(F.concat(F.lit("/* t:"), "event_type", F.lit(" */ x")), "t").alias("tag"))


@query("""select p_partkey as id, code, object, line from (select p_partkey, 'NO_WHERE' as code, '[s].[' || p_name || ']' as object, 1 as line from part union all select p_partkey, 'DROP_TABLE', '[s].[t]', 2 from part where p_partkey % 2 = 0
 union all select p_partkey, 'FORBIDDEN', 'USE', 2 from part where p_partkey % 2 = 1)""")
def batch_findings(spark, d):
    second = F.when(F.col("p_partkey") % 2 == 0, "drop table if exists s.t").otherwise("USE master")
    source = F.concat(F.lit("delete from s.["), "p_name", F.lit("]; update s.u set a = (select 1 where 1 = 1) where b = 2;\n"), second)
    return lint.batch_findings(table(spark, d, "part").select(F.col("p_partkey").alias("id"), source.alias("text")))


@query("""select p_partkey as id, 'INSERT [s].[' || p_name || ']; BEGIN TRANSACTION; ' || case when p_partkey % 2 = 0 then 'CREATE UNIQUE INDEX [i] ON [s].[t]' else 'EXEC [s].[p]' end as heads from part""")
def batch_outlines(spark, d):
    last = F.when(F.col("p_partkey") % 2 == 0, "create unique index i on s.t (a)").otherwise("exec @r = s.p 'secret'")
    source = F.concat(F.lit("insert into s.["), "p_name", F.lit("] values ('x;y', 5);begin tran ;; "), last)
    out = lint.outlines(table(spark, d, "part").select(F.col("p_partkey").alias("id"), source.alias("text")))
    return out.select("id", F.array_join("heads", "; ").alias("heads"))


def _files(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.expr("case p_partkey % 5 when 0 then 'schema/views/' when 1 then 'SCHEMA/views/' else 'schema/odd/' end"), F.lit("s."), F.when(k % 5 < 2, F.floor(k / 5).cast("string")).otherwise(k.cast("string")), F.when(k % 5 == 4, "?").otherwise(""), F.lit(".sql"))
    return table(spark, d, "part").select(path.alias("path"), F.when(k % 3 == 0, F.concat(F.lit("a\nPassword = N'x'"), F.when(k % 2 == 0, "\x07").otherwise(""))).otherwise("fine").alias("text"))


@query("""with f as (select p_partkey as k, case p_partkey % 5 when 0 then 'schema/views/' when 1 then 'SCHEMA/views/' else 'schema/odd/' end || 's.' || case when p_partkey % 5 < 2 then p_partkey // 5 else p_partkey end || case when p_partkey % 5 = 4 then '?' else '' end || '.sql' as path from part)
select distinct * from (select 'PATH' as code, 'error' as severity, path as key, 'unsafe character' as message from f where k % 5 = 4 union all select 'LAYOUT', 'error', path, 'not an object''s path' from f where k % 5 in (2, 3)
 union all select 'CASE_TWIN', 'error', path, 'another path differs in letter case only' from f where lower(path) in (select lower(path) from f group by 1 having count(distinct path) > 1)
 union all select 'CONTROL', 'error', path, 'a control character' from f where k % 6 = 0 union all select 'SECRET_LITERAL', 'error', path || ':2', 'a secret is never written' from f where k % 3 = 0)""")
def lint_files(spark, d):
    return rules.findings({"files": _files(spark, d)}, lint.ONE_REVISION)
