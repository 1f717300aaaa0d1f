"""Queries of release planning: parts stand for migrations, orders and events for what a database records."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.plans import lint, release, rules
from deltaloom.registry import query, table

# lines 4k and 4k + 1 are plain, 4k + 2 is withdrawn and 4k + 3 replaces it
_CHAIN = """c as (select p_partkey as pos, 'm' || p_partkey as file, sha256('m' || p_partkey) as sha256, p_partkey % 4 = 2 as withdrawn, case when p_partkey % 4 = 3 then p_partkey - 1 end as target from part),
o as (select *, coalesce(target, pos) as root, case when target is null then 0 else 1 end as depth from c)"""


def _chain(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("pos"), F.concat(F.lit("m"), k.cast("string")).alias("file"), F.sha2(F.concat(F.lit("m"), k.cast("string")).cast("binary"), 256).alias("sha256"),
        (k % 4 == 2).alias("withdrawn"), F.when(k % 4 == 3, F.concat(F.lit("m"), (k - 1).cast("string"))).alias("replaces"))


@query(f"""with {_CHAIN}, a as (select file, case when pos % 50 = 0 then 'x' else sha256 end as sha, pos from c where pos < 120 and pos % 6 <> 1),
w as (select o.*, a.sha, exists (select 1 from a b where b.pos = o.pos or b.pos = o.target) as met, o.pos % 30 = 1 as aside, o.pos % 30 = 7 as freed, (select max(root * 2 + depth) from o p join a using (file)) as last from o left join a on a.file = o.file)
select file, root, depth, case when sha is not null and sha <> sha256 then 'diverged' when sha is not null then 'applied' when withdrawn then 'withdrawn' when met then 'satisfied' when aside then 'set aside'
 when root * 2 + depth < last and target is not null then 'late' when root * 2 + depth < last and not freed then 'hole' else 'pending' end as status from w union all select 'gone', null, null, 'unknown'""")
def pending_entries(spark, d):
    c = _chain(spark, d)
    applied = c.where("pos < 120 and pos % 6 <> 1").select("file", F.expr("case when pos % 50 = 0 then 'x' else sha256 end").alias("sha256")).unionByName(spark.createDataFrame([("gone", "x")], "file string, sha256 string"))
    return release.pending(c, applied, c.where("pos % 30 = 1"), c.where("pos % 30 = 7"), 3, 3)


@query(f"""with {_CHAIN}, a as (select file, pos from c where pos < 120 and pos % 4 < 2),
w as (select o.*, a.file is not null as there, exists (select 1 from a b where b.pos = o.target) as met, (select max(root * 2 + depth) from o p join a using (file)) as last from o left join a on a.file = o.file)
select file, case when there then 'applied' when withdrawn then 'withdrawn' when met then 'satisfied' when pos % 8 = 3 then 'set aside' else 'ahead' end as status from w""")
def ahead_entries(spark, d):
    c = _chain(spark, d)
    return release.pending(c, c.where("pos < 120 and pos % 4 < 2").select("file", "sha256"), c.where("pos % 8 = 3"), c.limit(0), 4, 3).select("file", "status")


@query("""select true as is_prefix""")
def applied_prefix(spark, d):
    c = _chain(spark, d)
    applied = c.select(F.col("pos").alias("place"), "file")
    return release.is_prefix(applied, c.where("pos < 50"))


@query("""select 'm' || p_partkey as file, p_size as release, case when p_size > 40 then 'not listed' when p_size = 40 then 'run' when p_size >= 30 then 'carried' else 'behind' end as ruling from part""")
def catch_up(spark, d):
    added = table(spark, d, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("file"), F.col("p_size").alias("release"))
    withdrawn = spark.createDataFrame([("w1",), ("w2",)], "file string")
    more = added.unionByName(spark.createDataFrame([("w1", 30), ("w2", 10)], "file string, release int"))
    return release.caught_up(added, more, 40, 20, withdrawn)


@query("""with f as (select user_id, max(event_id) as run_id from events where event_type = 'error' and event_id % 3 <> 0 group by 1), u as (select user_id, max(event_id) as e from events where event_type = 'purchase' group by 1)
select 'm' || user_id as file, run_id, 'BATCH_FAILED' as reason, e is null or e <= run_id as active from f left join u using (user_id)""")
def parked_migrations(spark, d):
    e = table(spark, d, "events")
    file = F.concat(F.lit("m"), F.col("user_id").cast("string"))
    failed = e.where("event_type = 'error'").select(F.col("event_id").alias("run_id"), F.when(F.col("event_id") % 3 == 0, "module:x").otherwise(F.concat(file, F.lit("#2"))).alias("step"), F.lit("BATCH_FAILED").alias("reason"))
    steps = e.select(F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "purchase", "resolve").otherwise("batch").alias("kind"), F.lit("ok").alias("status"), F.concat(F.lit("unpark "), file).alias("note"))
    return release.parked(failed, steps)


def _steps(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("migration"), F.col("o_orderkey").alias("run_id"), F.expr("case o_orderstatus when 'P' then 'not_applied' when 'F' then 'ok' else 'failed' end").alias("status"),
                    F.when(F.col("o_orderkey") % 2 == 0, "not_managed in dev").otherwise("by hand").alias("note"))


@query("""select 'm' || o_custkey as file, max(o_orderkey) as run_id from orders where o_orderstatus = 'P' and o_orderkey % 2 = 0 group by 1""")
def skipped_migrations(spark, d):
    return release.skipped(_steps(spark, d))


@query("""select 'm' || o_custkey as file, max(o_orderkey) as run_id from orders where o_orderstatus = 'P' and o_orderkey % 2 = 0 and o_custkey not in (select o_custkey from orders where o_orderstatus = 'F') and o_custkey % 5 <> 0 group by 1""")
def aside_in_force(spark, d):
    withdrawn = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("file"))
    return release.in_force(release.skipped(_steps(spark, d)), _steps(spark, d), withdrawn)


_TOUCHED = "select l_orderkey as file, p_brand as schema, p_name as name from lineitem join part on p_partkey = l_partkey"


def _touched(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), "l_partkey")
    return l.join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select("file", F.col("p_brand").alias("schema"), F.col("p_name").alias("name"))


@query(f"""with t as ({_TOUCHED}), g as (select file, bool_and(starts_with(schema, 'Brand#1') or name like '%ring') as whole, bool_or(starts_with(schema, 'Brand#1') or name like '%ring') as part from t group by 1)
select cast(file as varchar) as file, case when whole then 'skipped' else 'mixed' end as ruling from g where part""")
def unmanaged_skips(spark, d):
    return release.unmanaged_skips(_touched(spark, d), ["brand#1*.*", "*.*RING"])


@query("""select lower(p_brand) as schema from part group by 1 having bool_and(p_size > 3)""")
def hidden_schemas(spark, d):
    o = table(spark, d, "part").select(F.col("p_brand").alias("schema"), F.when(F.col("p_size") > 3, F.concat(F.lit("x"), "p_name")).otherwise(F.col("p_name")).alias("name"))
    return release.hidden_schemas(o, ["*.x*"])


_PATTERNS = [("alpha", "*.red *"), ("alpha", "Brand#2*.*"), ("beta", "*.*ring"), ("gamma", "*.small *")]


@query(f"""with t as ({_TOUCHED}), m as (select file, unnest(list_filter([case when name like 'red %' or starts_with(schema, 'Brand#2') then 'alpha' when name like '%ring' then 'beta' when name like 'small %' then 'gamma' end], lambda x: x is not null)) as product from t),
h as (select distinct cast(file as varchar) as file, product, product in ('alpha', 'gamma') as held from m) select file, arg_min(product, (not held, product)) as product, bool_or(held) as held from h group by 1""")
def held_migrations(spark, d):
    products = spark.createDataFrame([("alpha", "dev"), ("beta", None), ("gamma", "test")], "product string, promote_to string")
    return release.held(_touched(spark, d), products, _PATTERNS, "acc")


@query("""with f as (select p_partkey, p_brand as schema, p_name as name, p_partkey % 2 as odd, case when p_name like 'red %' or starts_with(p_brand, 'Brand#2') then 'alpha' when p_name like '%ring' then 'beta' when p_name like 'small %' then 'gamma' end as product from part),
s as (select *, 'f' || odd as folder, schema || '.' || name as stem from f),
g(product, rx, gl) as (values ('alpha', '^.*[.]red .*$', '*.red *'), ('alpha', '^Brand#2.*[.].*$', 'Brand#2*.*'), ('beta', '^.*[.].*ring$', '*.*ring'), ('gamma', '^.*[.]small .*$', '*.small *')),
m as (select g.*, s.folder, s.p_partkey, s.product as own from s, g where regexp_matches(stem, rx)), ok as (select product, gl, folder from m group by 1, 2, 3 having bool_and(coalesce(own = product, false))),
covered as (select m.p_partkey, ok.gl, ok.product, ok.folder, case ok.gl when '*.red *' then 0 when 'Brand#2*.*' then 1 when '*.*ring' then 2 else 3 end as o from m join ok using (product, gl, folder)),
first as (select p_partkey, arg_min(gl, o) as gl, arg_min(product, o) as product, arg_min(folder, o) as folder from covered group by 1),
lines as (select distinct product, '/' || folder || '/' || gl || '.sql' as line from first union select product, '/' || folder || '/' || p_partkey || '.sql' from s where product is not null and p_partkey not in (select p_partkey from first))
select product, replace(line, ' ', '\\ ') || ' @' || product as line from lines where product <> 'gamma'""")
def code_owners(spark, d):
    p = table(spark, d, "part")
    folder = F.concat(F.lit("f"), (F.col("p_partkey") % 2).cast("string"))
    files = p.select(F.concat(folder, F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".sql")).alias("path"), folder.alias("folder"), F.col("p_brand").alias("schema"), F.col("p_name").alias("name"))
    return release.owners_lines(files, _PATTERNS, {"alpha": "@alpha", "beta": "@beta"})


@query("""select p_partkey as pos, lpad(cast(row_number() over (order by p_partkey) + 500 as varchar), 4, '0') || '__x' || p_partkey || '__y.sql' as new_file from part""")
def renumbered_files(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("0007__x"), F.col("p_partkey").cast("string"), F.lit("__y.sql")).alias("file"))
    return release.renumbered(c, 500).select("pos", "new_file")


@query("""with a as (select l_orderkey as id, l_partkey as object, l_linenumber % 2 = 0 as touches from lineitem where l_orderkey % 5 = 0), w as (select l_orderkey as id, l_partkey as object, l_linenumber % 3 = 0 as touches from lineitem where l_orderkey % 5 <> 0)
select w.id as work, a.id as aside, min(object) as shared from w join a using (object) where w.touches or a.touches group by 1, 2""")
def change_dependencies(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("object"), "l_linenumber")
    how = lambda n: F.when(F.col("l_linenumber") % n == 0, "touches").otherwise("names").alias("how")
    return release.dependencies(l.where("id % 5 <> 0").select("id", "object", how(3)), l.where("id % 5 = 0").select("id", "object", how(2)))


_CHANGES = """m as (select s_suppkey as k, 'VIEW:[s].[' || s_name || ']' as key from supplier), ch as (select key, case when k % 7 = 0 and k % 5 = 0 then 'conflict' when k % 7 = 0 then case when k % 3 = 0 then 'drop' end when k % 5 = 1 then 'orphan'
 when k % 3 <> 0 then 'create' when k % 2 = 0 then 'overwrite' when k % 9 = 3 then 'alter' end as action, k from m where not (k % 5 = 1 and k % 3 <> 0 and k % 7 <> 0))"""


def _changes(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").withColumn("key", F.concat(F.lit("VIEW:[s].["), "s_name", F.lit("]")))
    files = s.where("s_suppkey % 7 <> 0 and s_suppkey % 5 <> 1 or s_suppkey % 7 = 0 and s_suppkey % 5 = 0").select("key", F.lit("sum").alias("checksum"))
    recorded = s.where("s_suppkey % 3 = 0").select(F.upper("key").alias("key"), F.when(k % 2 == 0, F.lit(None)).when(k % 9 == 3, "other").otherwise("sum").alias("sha256"), F.lit("managed").alias("status"))
    return release.module_changes(files, recorded, s.where("s_suppkey % 7 = 0").select("key"))


@query(f"""with {_CHANGES} select case when action = 'orphan' then lower(key) else key end as key, action from ch where action is not null""")
def module_changes(spark, d):
    return _changes(spark, d)


@query(f"""with {_CHANGES}, w as (select 'm' || p_partkey as object, 'batch' as kind, 0 as phase from part where p_partkey % 40 = 0 union all select key, case when action = 'drop' then 'drop_module' else 'deploy_module' end, case when action = 'drop' then 2 else 1 end from ch
 where action in ('create', 'overwrite', 'alter', 'drop')) select *, 'NONTX_NOT_ALONE' as problem from w""")
def release_work(spark, d):
    lines = _chain(spark, d).where("pos % 40 = 0").select("file", F.col("pos").alias("root"), F.lit(0).alias("depth"))
    return release.work(lines, _changes(spark, d), lines.where("root = 0").select("file")).select("object", "kind", F.col("step.phase").alias("phase"), "problem")


@query("""select p_partkey as key, case when p_size % 4 = 0 then 0 else 1 end as phase, p_size as rows, case when p_size % 4 in (1, 2) then '-- ' else '' end || 'x' || p_partkey as statement, case p_size % 4 when 1 then 'REVIEW: loses data' when 2 then 'REVIEW: not null' end as review from part where p_size % 5 <> 0""")
def alignment_plan(spark, d):
    note = F.expr("case when p_size % 5 = 0 then 'only live' when p_size % 4 = 0 then 'absent' when p_size % 4 = 1 then 'loses data' when p_size % 4 = 2 then 'not null' else 'plain' end")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), note.alias("note"), F.col("p_size").alias("rows"), F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("statement"))
    return release.alignment(p)


@query("""with f as (select p_partkey as k, 'VIEW:[s].[v' || p_partkey || ']' as key from part)
select 'REMOVED' as code, 'error' as severity, key, 'gone without a tombstone' as message from f where k % 10 = 1 union all select 'KIND_CHANGE', 'error', key, 'another kind under this name' from f where k % 10 = 2
union all select 'REMOVED', 'error', key, 'gone without a tombstone' from f where k % 10 = 2 union all select 'CASE_RENAME', 'warning', key, 'only letter case changed' from f where k % 10 = 3
union all select 'REMOVED', 'error', key, 'gone without a tombstone' from f where k % 10 = 3 union all select 'RESIDUE', 'error', key, 'names an object that is gone' from f where (k + 1) % 10 in (1, 4) and k + 1 <= (select max(k) from f)""")
def lint_changes(spark, d):
    k = F.col("p_partkey")
    text = k.cast("string")
    base = table(spark, d, "part").select(k, F.concat(F.lit("VIEW:[s].[v"), text, F.lit("]")).alias("key"), F.lit("VIEW").alias("kind"), F.lit("s").alias("schema"), F.concat(F.lit("v"), text).alias("name"))
    kind, letter = F.when(k % 10 == 2, "PROCEDURE").otherwise("VIEW"), F.when(k % 10 == 3, "V").otherwise("v")
    head = table(spark, d, "part").where("p_partkey % 10 not in (1, 4)").select(F.concat(kind, F.lit(":[s].["), letter, text, F.lit("]")).alias("key"), kind.alias("kind"), F.lit("s").alias("schema"), F.concat(letter, text).alias("name"))
    dead = base.where("p_partkey % 10 = 4").select("key")
    named = base.select("key", F.lit("s").alias("schema"), F.concat(F.lit("v"), (k + 1).cast("string")).alias("name")).join(head.where("name like 'V%' or kind = 'PROCEDURE'").select(F.lower("name").alias("name")), "name", "left_anti")
    return rules.findings({"base": base.drop("p_partkey"), "head": head, "tombstones": dead, "named": named}, lint.TWO_REVISIONS)


@query("""select 'CHAIN_FILE' as code, 'error' as severity, 'm' || p_partkey || '.sql' as key, 'no file of this line' as message from part where p_partkey % 11 = 0 and p_partkey % 13 <> 0
union all select 'CHAIN_LINE', 'error', 'm' || p_partkey || '.sql', 'no line of this file' from part where p_partkey % 13 = 0 and p_partkey % 11 <> 0 union all select 'PRODUCT_OVERLAP', 'error', '[' || p_brand || '].[' || p_name || ']', 'more than one product' from part where starts_with(p_brand, 'Brand#2') and p_name like '%ring' group by 3""")
def lint_chain(spark, d):
    p = table(spark, d, "part")
    file = F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".sql"))
    files = p.where("p_partkey % 11 <> 0").select(F.concat(F.lit("migrations/"), file).alias("path"))
    objects = release.products_of(p.select(F.col("p_brand").alias("schema"), F.col("p_name").alias("name")), [("a", "Brand#2*.*"), ("b", "*.*ring")])
    return rules.findings({"files": files, "chain": p.where("p_partkey % 13 <> 0").select(file.alias("file")), "objects": objects}, [lint.chain_files, lint.overlaps])


@query("""select p_partkey, case when p_name like '%ring' then '*.*ring' when starts_with(p_brand, 'Brand#2') then 'brand#2?.*' end as pattern from part where p_brand <> 'Brand#2'""")
def first_patterns(spark, d):
    return table(spark, d, "part").where("p_brand <> 'Brand#2'").select("p_partkey", rules.first_pattern(F.col("p_brand"), F.col("p_name"), ["*.*ring", "brand#2?.*"]).alias("pattern"))


@query("""select n_name, case when n_regionkey = 0 then n_nationkey % 4 < 2 when n_regionkey = 1 then n_nationkey % 4 < 1 else false end as held from nation where n_regionkey < 3 and n_nationkey % 4 < 3""")
def held_products(spark, d):
    n = table(spark, d, "nation").where("n_regionkey < 3 and n_nationkey % 4 < 3")
    reach = F.expr("element_at(array('dev', 'test', 'acc'), n_nationkey % 4 + 1)")
    held = F.when(F.col("n_regionkey") == 0, release.is_held(reach, "acc")).when(F.col("n_regionkey") == 1, release.is_held(reach, "test")).otherwise(release.is_held(reach, "live tests"))
    return n.select("n_name", held.alias("held"))


