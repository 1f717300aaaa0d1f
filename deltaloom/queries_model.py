"""Queries of models: each part is a table or a synonym, and the model after it changes some of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.operators import model
from deltaloom.registry import query, table
from deltaloom.sources.staging import stage


def _text(changed: bool):
    """A part's definition.  Odd parts are tables of an id, a name as long as the part's size, and a price; each tenth part is a
    synonym.  In the changed model names grow for size below 20, some tables gain a column, some change their key."""
    k = F.col("p_partkey")
    text = k.cast("string")
    length = F.when(F.lit(changed) & (F.col("p_size") < 20), F.col("p_size") + 50).otherwise(F.col("p_size"))
    more = F.when(F.lit(changed) & (k % 7 == 0), ", extra int NULL").otherwise("")
    cluster = F.when(F.lit(changed) & (k % 11 == 0), " NONCLUSTERED").otherwise("")
    made = F.concat(
        F.lit("CREATE TABLE [s].[t"), text, F.lit("] ([id] int NOT NULL, name varchar("), length.cast("string"), F.lit(") NULL, price decimal(9, 2) NOT NULL CONSTRAINT d"), text, F.lit(" DEFAULT ((0))"), more,
        F.lit(", CONSTRAINT pk"), text, F.lit(" PRIMARY KEY"), cluster, F.lit(" (id))"))
    broken = F.lit("CREATE TABLE [s].[t (id int NOT NULL)")
    synonym = F.concat(F.lit("CREATE SYNONYM s.[t"), text, F.lit("] FOR s.x"), F.when(F.lit(changed), "2").otherwise("1"))
    return F.when(k % 10 == 9, synonym).when(k % 29 == 1, broken).otherwise(made)


def _files(spark, d, changed: bool):
    gone = "p_partkey % 23 <> 4" if changed else "p_partkey % 19 <> 6"
    return table(spark, d, "part").where(gone).select(F.col("p_partkey").alias("path"), _text(changed).alias("text"))


def _models(spark, d):
    return tuple(stage(model.parse_objects(_files(spark, d, c)).where("problem is null"), "model") for c in (False, True))


_PARTS = """b as (select p_partkey as k, p_size as n from part where p_partkey % 19 <> 6 and not (p_partkey % 29 = 1 and p_partkey % 10 <> 9)), h as (select p_partkey as k, p_size as n from part where p_partkey % 23 <> 4 and not (p_partkey % 29 = 1 and p_partkey % 10 <> 9)),
paired as (select b.k, b.n, k % 10 = 9 as synonym from b join h using (k)), added as (select k, k % 10 = 9 as synonym from h where k not in (select k from b)), gone as (select k, k % 10 = 9 as synonym from b where k not in (select k from h))"""


@query("""select p_partkey as path, case when p_partkey % 10 = 9 then 'synonym:[s].[t' || p_partkey || ']' when p_partkey % 29 <> 1 then 'table:[s].[t' || p_partkey || ']' end as key,
 case when p_partkey % 10 = 9 then 'SYNONYM' when p_partkey % 29 <> 1 then 'TABLE' end as object_kind, case when p_partkey % 10 <> 9 and p_partkey % 29 = 1 then 'identifier without end' end as problem from part where p_partkey % 19 <> 6""")
def ddl_objects(spark, d):
    return model.parse_objects(_files(spark, d, False)).select("path", "key", "object_kind", "problem")


@query("""select p_partkey as id, 'table:[s].[t' || p_partkey || ']' as key, case p_partkey % 5 when 0 then 'add column' when 1 then 'drop constraint' when 2 then 'rename' when 3 then 'create index' end as step,
 case when p_partkey % 5 = 4 then 'expected a whole number' end as problem from part where p_partkey % 5 <> 4 union all select p_partkey, null, null, 'expected a whole number' from part where p_partkey % 5 = 4""")
def ddl_statements(spark, d):
    name = F.concat(F.lit("[s].[T"), F.col("p_partkey").cast("string"), F.lit("]"))
    part = lambda a, b="": F.concat(F.lit(a), name, F.lit(b))
    source = (
        F.when(F.col("p_partkey") % 5 == 0, part("alter table ", " add c int null")).when(F.col("p_partkey") % 5 == 1, part("ALTER TABLE ", " DROP CONSTRAINT x;")).when(F.col("p_partkey") % 5 == 2, part("exec sp_rename '", "', 'u'"))
        .when(F.col("p_partkey") % 5 == 3, part("create index i on ", " (a desc)")).otherwise(part("alter table ", " add c varchar(x) null")))
    return model.parse_statements(table(spark, d, "part").select(F.col("p_partkey").alias("id"), source.alias("text"))).select("id", "key", F.col("object_kind").alias("step"), "problem")


@query(f"""with {_PARTS} select 'synonym:[s].[t' || k || ']' as key, '(absent in ' || 'other)' as path from gone where synonym union all select 'table:[s].[t' || k || ']', '(absent in other)' from gone where not synonym
union all select case when synonym then 'synonym' else 'table' end || ':[s].[t' || k || ']', '(absent in self)' from added union all select 'synonym:[s].[t' || k || ']', 'target_name' from paired where synonym
union all select 'table:[s].[t' || k || ']', 'columns[name].type.length' from paired where not synonym and n < 20 union all select 'table:[s].[t' || k || ']', 'columns[extra] (absent in self)' from paired where not synonym and k % 7 = 0
union all select 'table:[s].[t' || k || ']', 'constraints[pk' || k || '].clustered' from paired where not synonym and k % 11 = 0""")
def model_paths(spark, d):
    return model.diff_paths(*_models(spark, d))


_OPS = f"""{_PARTS}, ops as (select 4 as step, k, 'pk' || k as name from paired where not synonym and k % 11 = 0 union all select 18, k, 'pk' || k from paired where not synonym and k % 11 = 0
union all select 15, k, 'name' from paired where not synonym and n < 20 union all select 13, k, 'extra' from paired where not synonym and k % 7 = 0 union all select 12, k, 't' || k from added where not synonym
union all select 6, k, 't' || k from gone where not synonym), syn as (select 22 as step, k, 't' || k as name from paired where synonym union all select 23, k, 't' || k from paired where synonym union all select 22, k, 't' || k from gone where synonym union all select 23, k, 't' || k from added where synonym)"""


@query(f"""with {_OPS} select step, 'table:[s].[t' || k || ']' as key, name, cast(null as varchar) as code from ops union all select step, 'synonym:[s].[t' || k || ']', name, null from syn""")
def model_diff(spark, d):
    return model.diff(*_models(spark, d)).select("step", "key", "name", "code")


@query(f"""with {_OPS} select 'table:[s].[t' || k || ']' as key, count(*) as accepted, cast(null as varchar) as problem from ops group by 1 union all select 'synonym:[s].[t' || k || ']', count(*), null from syn group by 1
union all select case when synonym then 'synonym' else 'table' end || ':[s].[t' || k || ']', 0, null from paired where k not in (select k from ops union select k from syn)""")
def model_replay(spark, d):
    base, head = _models(spark, d)
    ops = model.diff(base, head).select("key", F.struct("step", "name").alias("order"), "op")
    numbered = ops.select("key", (F.col("order.step") * 1000).cast("long").alias("seq"), "op")
    return model.replay(base, numbered).select("key", "accepted", "problem")


@query("""select cast(null as varchar) as key, cast(null as varchar) as path where false""")
def model_proof(spark, d):
    base, head = _models(spark, d)
    return model.prove(base, model.diff(base, head).select("key", F.col("step").cast("long").alias("seq"), "op"), head)


@query(f"""with {_PARTS} select 'table:[s].[t' || k || ']' as key, 'no column extra' as path from paired where not synonym and k % 3 = 0""")
def model_unproven(spark, d):
    base, head = _models(spark, d)
    shared = base.join(head.select("key"), "key", "left_semi").where("object_kind = 'TABLE'")
    number = F.regexp_extract("key", r"\[t([0-9]+)\]", 1).cast("long")
    ops = shared.where(number % 3 == 0).select("key", F.lit(0).cast("long").alias("seq"), F.concat(
        F.lit('{"op":"drop column","schema":"s","table":"t'), number.cast("string"), F.lit('","name":"extra"}')).alias("op"))
    return model.prove(shared, ops, shared).select("key", F.regexp_replace("path", "operation 0: ", "").alias("path"))


@query(f"""with {_OPS} select 'table:[s].[t' || k || ']' as key, step, code from (select k, step, 'LONG_LOCK' as code from ops where step in (4, 18, 15) union all select k, step, 'DROP_TABLE' from ops where step = 6)""")
def needed_allows(spark, d):
    base, head = _models(spark, d)
    return model.classified(model.diff(base, head).select("key", F.col("step").alias("seq"), "op"), base).select("key", F.col("seq").cast("int").alias("step"), "code")


@query(f"""with {_OPS} select 'ALTER TABLE [s].[t' || k || '] ALTER COLUMN [name] varchar(' || (n + 50) || ') NULL' as text from paired where not synonym and n < 20 union all select 'ALTER TABLE [s].[t' || k || '] ADD [extra] int NULL' from paired where not synonym and k % 7 = 0""")
def model_statements(spark, d):
    made = model.statements(model.diff(*_models(spark, d)).where("step in (13, 15)").select("step", "op"))
    return made.select("text")


@query("""select 'table:[s].[t' || p_partkey || ']' as key, 'CREATE TABLE [s].[t' || p_partkey || '] (' || chr(10) || '    [id] int NOT NULL,' || chr(10) || '    [name] varchar(' || p_size || ') NULL,' || chr(10)
 || '    [price] decimal(9, 2) NOT NULL CONSTRAINT [d' || p_partkey || '] DEFAULT (( 0 )),' || chr(10) || '    CONSTRAINT [pk' || p_partkey || '] PRIMARY KEY CLUSTERED ([id])' || chr(10) || ')' || chr(10) as text
from part where p_partkey % 19 <> 6 and p_partkey % 10 <> 9 and p_partkey % 29 <> 1 union all select 'synonym:[s].[t' || p_partkey || ']', 'CREATE SYNONYM [s].[t' || p_partkey || '] FOR [s].[x1]' || chr(10) from part where p_partkey % 19 <> 6 and p_partkey % 10 = 9""")
def model_files(spark, d):
    return model.files(_models(spark, d)[0])


@query("""select p_partkey as id, what, l as "left", r as "right" from (select p_partkey, 'replace' as what, 'a' as l, 'b' as r from part where p_partkey % 3 = 0 union all select p_partkey, 'insert', '', ', [order]' from part where p_partkey % 3 = 1
 union all select p_partkey, 'unreadable', 'string without end', null from part where p_partkey % 3 = 2 and p_partkey % 2 = 0)""")
def token_differences(spark, d):
    k = F.col("p_partkey")
    right = F.when(k % 3 == 0, "select  B, [C] from t -- x").when(k % 3 == 1, "SELECT [a], c, [order] FROM t").when(k % 2 == 0, "'").otherwise("select a , \"C\" from [t]")
    return model.text_differences(table(spark, d, "part").select(k.alias("id"), F.lit("select A, c from T").alias("a"), right.alias("b")))


@query(f"""with {_PARTS} select 'table:[s].[' || case when k % 5 = 0 then 'u' else 't' end || k || ']' as key, case when k % 5 = 0 then 'U' else 't' end || k as name from b where k % 10 <> 9""")
def renamed_model(spark, d):
    base, _ = _models(spark, d)
    number = F.regexp_extract("key", r"\[t([0-9]+)\]", 1)
    renames = base.where("object_kind = 'TABLE'").where(number.cast("long") % 5 == 0).select("key", F.concat(F.lit("table:[s].[u"), number, F.lit("]")).alias("new_key"), F.concat(F.lit("U"), number).alias("new_name"))
    return model.renamed(base.where("object_kind = 'TABLE'"), renames).select("key", F.get_json_object("body", "$.name").alias("name"))
