"""The reference workload's operators over the test tables, each with the same question as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.functions import text as X
from deltaloom.functions import tokens
from deltaloom.operators import compare, graph, ordered
from deltaloom.plans import release, rules
from deltaloom.registry import QUERIES, SQL, micros, query, table
from deltaloom.streaming import events as streaming


# ---- comparisons of snapshots ------------------------------------------------------------------------------

#: A live copy of orders: one key in eleven gone, the status of one in five changed.
def _orders_live(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.expr("case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end"))


_LIVE = """live as (select o_orderkey, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_orderpriority,
  o_custkey from orders where o_orderkey % 11 <> 0), stored as (select o_orderkey, o_orderstatus, o_orderpriority, o_custkey from orders where o_orderkey % 7 <> 0)"""
_LONG = "select o_orderkey, '{c}' as property, sha256(cast({c} as varchar)) as hash from {t}"


def _long(t: str) -> str:
    return " union all ".join(_LONG.format(c=c, t=t) for c in ("o_orderstatus", "o_orderpriority", "o_custkey"))


@query(f"""with {_LIVE}, s as ({_long('stored')}), l as ({_long('live')})
select s.o_orderkey, 'managed' as cls, s.property, s.hash as stored_hash, l.hash as live_hash from s join l using (o_orderkey, property) where s.hash is distinct from l.hash
union all select o_orderkey, 'missing', null, null, null from stored where o_orderkey not in (select o_orderkey from live)
union all select o_orderkey, 'unmanaged', null, null, null from live where o_orderkey not in (select o_orderkey from stored)""")
def drift_items(spark, d):
    return compare.drift(table(spark, d, "orders").where("o_orderkey % 7 <> 0"), _orders_live(spark, d), "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query(f"""with {_LIVE}, s as ({_long('stored')}), l as ({_long('live')} ),
l2 as (select * from l where property <> 'o_orderpriority')
select s.o_orderkey, s.property, s.hash as stored_hash, l2.hash as live_hash from s left join l2 using (o_orderkey, property) where s.hash is distinct from l2.hash""")
def property_diff(spark, d):
    columns = ["o_orderstatus", "o_orderpriority", "o_custkey"]
    stored = compare.long_form(table(spark, d, "orders").where("o_orderkey % 7 <> 0"), "o_orderkey", columns)
    live = compare.long_form(_orders_live(spark, d), "o_orderkey", columns).where("property <> 'o_orderpriority'")
    return compare.property_diff(stored, live, "o_orderkey")


@query("""with b as (select c_custkey, c_name, case when c_custkey % 6 = 0 then c_mktsegment || '!' else c_mktsegment end as c_mktsegment from customer where c_custkey % 9 <> 0),
a as (select c_custkey, c_name, c_mktsegment from customer where c_custkey % 8 <> 0)
select coalesce(a.c_custkey, b.c_custkey) as c_custkey, case when b.c_custkey is null then 'only here' when a.c_custkey is null then 'missing here'
 when a.c_name is not distinct from b.c_name and a.c_mktsegment is not distinct from b.c_mktsegment then 'equal' else 'differs' end as status
from a full join b on a.c_custkey = b.c_custkey""")
def baseline_compare(spark, d):
    c = table(spark, d, "customer")
    b = c.where("c_custkey % 9 <> 0").withColumn("c_mktsegment", F.expr("case when c_custkey % 6 = 0 then c_mktsegment || '!' else c_mktsegment end"))
    return compare.baseline(c.where("c_custkey % 8 <> 0"), b, "c_custkey", ["c_name", "c_mktsegment"])


@query("""select s_suppkey, case when s_suppkey % 5 = 0 then 'create' when s_suppkey % 7 = 0 then 'overwrite' when s_suppkey % 3 = 0 then 'alter' else 'none' end as action from supplier""")
def change_detection(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", X.checksum(F.col("s_name")).alias("sha"))
    recorded = s.where("s_suppkey % 5 <> 0").withColumn("sha", F.expr("case when s_suppkey % 7 = 0 then null when s_suppkey % 3 = 0 then concat('0', sha) else sha end"))
    return compare.changes(s, recorded, "s_suppkey", "sha")


@query("""with base as (select l_orderkey, 'line[' || l_linenumber || '].flag' as path, min(l_returnflag) as value from lineitem group by 1, 2
 union all select l_orderkey, 'line[' || l_linenumber || '].status', min(l_linestatus) from lineitem group by 1, l_linenumber),
h as (select l_orderkey, path, case when l_orderkey % 10 = 0 and path like '%.flag' then value || '2' else value end as value from base where not (l_orderkey % 13 = 0 and path like 'line[1]%')),
j as (select coalesce(b.l_orderkey, h.l_orderkey) as l_orderkey, coalesce(b.path, h.path) as path, case when b.path is null then 'absent in left' when h.path is null then 'absent in right'
 when b.value is distinct from h.value then 'differs' end as note from base b full join h on b.l_orderkey = h.l_orderkey and b.path = h.path) select * from j where note is not null""")
def path_diff(spark, d):
    # an order with its lines as one nested object, flattened to paths
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    name = lambda part: F.concat(F.lit("line["), F.col("l_linenumber").cast("string"), F.lit("]." + part))
    base = lines.select("l_orderkey", F.explode(F.array(*[F.struct(name(p).alias("path"), F.col(p).alias("value")) for p in ("flag", "status")])).alias("x")).select("l_orderkey", "x.*")
    head = base.where("not (l_orderkey % 13 = 0 and path like 'line[1]%')").withColumn(
        "value", F.expr("case when l_orderkey % 10 = 0 and path like '%.flag' then value || '2' else value end"))
    return compare.path_diff(base, head, "l_orderkey")


@query("""select o_orderkey as pos, case when o_orderkey % 101 = 0 then 'removed' else 'changed' end as problem from orders where o_orderkey % 101 = 0 or o_orderkey % 103 = 0""")
def immutable_prefix(spark, d):
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderstatus", "o_orderpriority")
    head = base.where("pos % 101 <> 0").withColumn("o_orderstatus", F.expr("case when pos % 103 = 0 then o_orderstatus || '*' else o_orderstatus end"))
    return compare.prefix_violations(base, head, "pos", ["o_orderstatus", "o_orderpriority"])


@query("""select p_partkey, 'differs' as status from part where p_partkey % 17 = 0 and p_partkey % 2 <> 0""")
def untouched_rows(spark, d):
    p = table(spark, d, "part")
    after = p.withColumn("p_brand", F.expr("case when p_partkey % 17 = 0 or p_partkey % 2 = 0 then p_brand || '?' else p_brand end"))
    return compare.untouched_changes(p, after, p.where("p_partkey % 2 = 0").select("p_partkey"), "p_partkey", ["p_brand", "p_name"])


@query("""with g as (select p_brand, p_type, p_size, count(*) c, min(p_partkey) as old from part where p_partkey % 2 = 0 group by 1, 2, 3 having count(*) = 1),
n as (select p_brand, p_type, p_size, count(*) c, min(p_partkey) as new from part where p_partkey % 2 = 1 group by 1, 2, 3 having count(*) = 1)
select p_brand, p_type, p_size, old, new from g join n using (p_brand, p_type, p_size)""")
def rename_candidates(spark, d):
    p = table(spark, d, "part")
    return compare.unique_pairs(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), ["p_brand", "p_type", "p_size"], "p_partkey")


@query("""with a as (select * from customer where c_custkey % 3 <> 0), b as (select * from customer where c_custkey % 5 <> 0),
ra as (select c_custkey, c_mktsegment, c_nationkey, row_number() over (partition by c_mktsegment, c_nationkey order by c_custkey) n from a where c_custkey not in (select c_custkey from b)),
rb as (select c_custkey, c_mktsegment, c_nationkey, row_number() over (partition by c_mktsegment, c_nationkey order by c_custkey) n from b where c_custkey not in (select c_custkey from a))
select a.c_custkey as left_key, b.c_custkey as right_key, 'name' as how from a join b using (c_custkey)
union all select ra.c_custkey, rb.c_custkey, 'value' from ra join rb using (c_mktsegment, c_nationkey, n)""")
def greedy_match(spark, d):
    c = table(spark, d, "customer")
    return compare.greedy_match(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 5 <> 0"), "c_custkey", ["c_mktsegment", "c_nationkey"])


@query("""with w as (select user_id, epoch_us(ts) // 604800000000 as week from events where event_type = 'error' group by 1, 2)
select user_id, week from w where not exists (select 1 from w v where v.user_id = w.user_id and v.week = w.week - 1)""")
def new_findings(spark, d):
    w = micros(table(spark, d, "events").where("event_type = 'error'")).select("user_id", F.floor(F.col("us") / 604800000000).cast("bigint").alias("week")).distinct()
    return compare.new_only(w, w.withColumn("week", F.col("week") + 1), ["user_id", "week"])


@query("""with s as (select distinct user_id, event_type from events where value > 30 or user_id % 4 = 0), p as (select user_id from s group by 1)
select a.user_id as work, b.user_id as aside, min(a.event_type) as shared from s a join s b on a.event_type = b.event_type and a.user_id = b.user_id + 1 group by 1, 2""")
def token_overlap_dependency(spark, d):
    s = table(spark, d, "events").where("value > 30 or user_id % 4 = 0").select("user_id", "event_type").distinct()
    a, b = s.withColumnRenamed("user_id", "work"), s.withColumnRenamed("user_id", "aside")
    return a.join(b.withColumn("work", F.col("aside") + 1), ["work", "event_type"]).groupBy("work", "aside").agg(F.min("event_type").alias("shared"))


@query("""with live as (select c_custkey, c_name, c_custkey % 4 as v from customer where c_custkey % 2 = 0), inc as (select c_custkey, c_name || '+' as c_name, c_custkey % 3 as v from customer)
select i.c_custkey, case when l.c_custkey is null or i.v >= l.v then i.c_name else l.c_name end as c_name, case when l.c_custkey is null or i.v >= l.v then i.v else l.v end as v from inc i left join live l using (c_custkey)""")
def upsert_latest(spark, d):
    c = table(spark, d, "customer")
    live = c.where("c_custkey % 2 = 0").select("c_custkey", "c_name", F.expr("c_custkey % 4").alias("v"))
    return compare.upsert(live, c.select("c_custkey", F.concat("c_name", F.lit("+")).alias("c_name"), F.expr("c_custkey % 3").alias("v")), "c_custkey", "v")


@query("""select s_suppkey, case when s_nationkey = 7 then s_name || ' v2' else s_name end as s_name, s_nationkey from supplier""")
def snapshot_overlay(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return compare.overlay(s, s.withColumn("s_name", F.concat("s_name", F.lit(" v2"))), "s_nationkey", 7)


@query("""with h as (select sha256('{"bal":' || cast(c_acctbal as decimal(18,2)) || ',"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') as h from customer)
select sha256(string_agg(h, '' order by h)) as digest from h""")
def relation_digest(spark, d):
    c = table(spark, d, "customer").withColumn("bal", F.col("c_acctbal").cast("decimal(18,2)"))
    return compare.digest(c, ["c_custkey", "c_name", "c_nationkey", "bal"])


# ---- scope, patterns, state --------------------------------------------------------------------------------

@query("""select p_partkey, case when p_brand = 'Brand#5' then 'schema excluded' when p_brand not in ('Brand#1', 'Brand#11', 'Brand#12', 'Brand#13', 'Brand#14') then 'schema not listed'
 when p_name like 'small %' then 'exclude_objects brand#1*.small *' when regexp_matches(p_name, '^.*.o.t$') then 'not_managed *.*?o?t' end as reason from part""")
def scope_filter(spark, d):
    reason = rules.scope_reason(
        F.col("p_brand"), F.col("p_name"), ["brand#5", "Brand#1", "Brand#11", "Brand#12", "Brand#13", "brand#14"], ["Brand#5"], ["brand#1*.small *"], ["*.*?o?t"])
    return table(spark, d, "part").select("p_partkey", reason.alias("reason"))


_GROUPS = [("ring", "*.*ring*"), ("widget", "*.*widget"), ("red", "Brand#1*.red *"), ("small", "*.SMALL ?*")]


@query("""with g(product, s, rx) as (values ('ring', '', 'ring'), ('widget', '', 'widget$'), ('red', 'Brand#1', '^red '), ('small', '', '^small .'))
select p_partkey, count(*) as n, string_agg(product, ',' order by product) as products from part, g where starts_with(p_brand, s) and regexp_matches(p_name, rx) group by 1 having count(*) > 1""")
def product_overlap(spark, d):
    # a few patterns: an array of the ones that fit, in one pass, instead of a join on patterns
    named = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("schema"), F.col("p_name").alias("name"))
    fit = release.products_of(named, _GROUPS).where("size(products) > 1")
    return fit.select("p_partkey", F.size("products").cast("bigint").alias("n"), F.array_join("products", ",").alias("products"))


@query("""select user_id, arg_max(event_id, (epoch_us(ts), event_id)) as event_id, arg_max(event_type, (epoch_us(ts), event_id)) as event_type from events group by 1""")
def latest_state(spark, d):
    return ordered.latest(micros(table(spark, d, "events")).select("user_id", "us", "event_id", "event_type"), "user_id", ["us", "event_id"]).select("user_id", "event_id", "event_type")


@query("""with r as (select user_id, event_id, epoch_us(ts) us, event_type, case when event_type in ('error', 'view') then 'open' else 'closed' end st from events),
l as (select user_id, max(us) m from r group by 1)
select r.user_id, r.event_id, r.st as status from r join l using (user_id) where r.us = l.m or (r.st = 'open' and r.event_type = 'error')""")
def open_and_latest_runs(spark, d):
    r = micros(table(spark, d, "events")).withColumn("status", F.when(F.col("event_type").isin("error", "view"), "open").otherwise("closed"))
    last = r.groupBy("user_id").agg(F.max("us").alias("m"))
    return r.join(last, "user_id").where("us = m or event_type = 'error'").select("user_id", "event_id", "status")


@query("""with f as (select user_id, max(event_id) as event_id from events where event_type = 'error' group by 1)
select user_id, event_id from f where not exists (select 1 from events e where e.user_id = f.user_id and e.event_type = 'purchase' and e.event_id > f.event_id)""")
def parked_entities(spark, d):
    e = table(spark, d, "events")
    failed = e.where("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return ordered.uncleared(failed, e.where("event_type = 'purchase'"), "user_id", "event_id")


# ---- aggregates --------------------------------------------------------------------------------------------

@query("""select l_suppkey, cast(count(*) as bigint) as n, cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as returned,
 cast(sum(case when l_linestatus = 'O' then cast(l_quantity as decimal(18,2)) end) as double) as open_qty from lineitem group by 1""")
def conditional_sums(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("decimal(18,2)"))).cast("double").alias("open_qty"))


@query("""select o_orderkey, count(l_orderkey) as lines, max(l_linenumber) as last_line, count(distinct (l_partkey, l_suppkey)) filter (where l_orderkey is not null) as pairs
from orders left join lineitem on l_orderkey = o_orderkey group by 1""")
def correlated_stats(spark, d):
    stats = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.max("l_linenumber").alias("last_line"), F.count_distinct(F.struct("l_partkey", "l_suppkey")).alias("pairs"))
    o = table(spark, d, "orders").select("o_orderkey")
    return o.join(stats, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), "last_line", F.coalesce("pairs", F.lit(0)).alias("pairs"))


@query("""select r_name, string_agg(n_name, ';' order by n_name) as nations, count(*) as n from region join nation on n_regionkey = r_regionkey group by 1""")
def string_agg_events(spark, d):
    j = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ";").alias("nations"), F.count(F.lit(1)).alias("n"))


@query("""select doc_id, first_id from (select doc_id, min(doc_id) over (partition by sha256(rtrim(text))) as first_id from documents) where doc_id <> first_id""")
def duplicates(spark, d):
    # copies are found by an aggregate of digests, so a text with very many copies is reduced before it moves
    k = table(spark, d, "documents").select("doc_id", F.sha2(F.rtrim("text").cast("binary"), 256).alias("h"))
    first = k.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return k.join(first, "h").where("doc_id <> first_id").select("doc_id", "first_id")


@query("""select e.event_type, count(*) as n, cast(sum(coalesce(cast(json_extract_string(props, '$.k') as double), 0)) as double) as total_k from events e group by 1""")
def json_props(spark, d):
    k = F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') as double)"), F.lit(0.0))
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total_k"))


# ---- ordered logs ------------------------------------------------------------------------------------------

@query("""select o_orderkey, cast((row_number() over (partition by o_orderstatus order by o_orderkey) - 1) // 100 as bigint) as chunk from orders""")
def chunk_assignment(spark, d):
    return ordered.chunks(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey", 100).select("o_orderkey", F.col("chunk").cast("bigint").alias("chunk"))


@query("""with e as (select user_id, event_id, value, max(value) over (partition by user_id order by epoch_us(ts), event_id rows between unbounded preceding and 1 preceding) as highest from events)
select user_id, event_id, highest from e where value <= highest""")
def monotonic_check(spark, d):
    return ordered.not_rising(micros(table(spark, d, "events")), "user_id", ["us", "event_id"], "value").select("user_id", "event_id", "highest")


@query("""with l as (select o_custkey, o_orderkey, o_orderstatus = 'F' as applied from orders), m as (select o_custkey, max(o_orderkey) as last_applied from l where applied group by 1)
select l.o_custkey, l.o_orderkey, m.last_applied from l join m using (o_custkey) where not l.applied and l.o_orderkey < m.last_applied""")
def holes_and_prefix(spark, d):
    log = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("applied"))
    return ordered.holes(log, "o_custkey", "o_orderkey", "applied").select("o_custkey", "o_orderkey", "last_applied")


@query("""with s as (select user_id, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by epoch_us(ts), event_id) as segment from events)
select user_id, cast(segment as bigint) as segment, count(*) as n from s group by 1, 2""")
def segment_by_marker(spark, d):
    s = ordered.segments(micros(table(spark, d, "events")), "user_id", ["us", "event_id"], F.col("event_type") == "signup")
    return s.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"))


@query("""with a as (select user_id, event_id, epoch_us(ts) us from events), b as (select *, case when us - lag(us) over (partition by user_id order by us, event_id) > 3600000000 then 1 else 0 end late from a),
c as (select *, sum(late) over (partition by user_id order by us, event_id) as session from b)
select user_id, cast(session as bigint) as session, count(*) as n, min(us) as begins, max(us) as ends from c group by 1, 2""")
def session_gap(spark, d):
    s = ordered.sessions(micros(table(spark, d, "events")), "user_id", "us", "event_id", 3_600_000_000)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("begins"), F.max("us").alias("ends"))


@query("""with e as (select *, epoch_us(ts) us, row_number() over (partition by user_id, event_type order by epoch_us(ts) desc, event_id desc) rn from events)
select user_id, count(*) as batches, count(*) filter (where event_type = 'error') as errors, cast(sum(cast(value as decimal(18,2))) as double) as total, arg_max(event_type, (us, event_id)) as last_kind,
 coalesce(string_agg(case when event_type = 'error' and rn <= 3 then cast(event_id as varchar) end, ',' order by rn), '') as last_errors, max(us) - min(us) as span from e group by 1""")
def trace_summary(spark, d):
    e = micros(table(spark, d, "events")).select("user_id", "us", "event_id", "event_type", "value")
    last = ordered.top(e.where("event_type = 'error'"), "user_id", ["us", "event_id"], 3).groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("last_errors"))
    sums = e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("batches"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"),
        F.max_by("event_type", F.struct("us", "event_id")).alias("last_kind"), (F.max("us") - F.min("us")).alias("span"))
    return sums.join(last, "user_id", "left").withColumn("last_errors", F.coalesce("last_errors", F.lit("")))


@query("""with recursive c as (select conv_id * 100 + turn as pos, case when turn > 0 and turn % 3 = 0 then conv_id * 100 + turn - 2 end as replaces from conversations),
r as (select pos, pos as root, 0 as depth from c where replaces is null union all select c.pos, r.root, r.depth + 1 from c join r on c.replaces = r.pos) select * from r""")
def effective_order(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("pos"), F.expr("case when turn > 0 and turn % 3 = 0 then conv_id * 100 + turn - 2 end").alias("replaces"))
    return ordered.effective_order(c)


_MACHINE = {"start": {"signup": "known", "view": "known", "click": "known"}, "known": {"view": "known", "click": "known", "purchase": "buyer"}, "buyer": {"view": "buyer", "purchase": "buyer", "click": "buyer"}}


@query("""with recursive e as (select user_id, event_type, row_number() over (partition by user_id order by epoch_us(ts), event_id) as n from events),
f as (select user_id, cast(0 as bigint) as accepted, 'start' as state, cast(null as varchar) as bad_op, cast(1 as bigint) as n from (select distinct user_id from events)
 union all select f.user_id, case when x.nxt is null then f.accepted else f.accepted + 1 end, coalesce(x.nxt, f.state), case when x.nxt is null then e.event_type end, f.n + 1
 from f join e on e.user_id = f.user_id and e.n = f.n left join (values ('start','signup','known'), ('start','view','known'), ('start','click','known'), ('known','view','known'), ('known','click','known'),
 ('known','purchase','buyer'), ('buyer','view','buyer'), ('buyer','purchase','buyer'), ('buyer','click','buyer')) x(st, op, nxt) on x.st = f.state and x.op = e.event_type where f.bad_op is null)
select user_id, accepted, state, case when bad_op is not null then accepted end as bad_index, bad_op from (select *, row_number() over (partition by user_id order by n desc) k from f) where k = 1""")
def replay_orders(spark, d):
    return ordered.replay(micros(table(spark, d, "events")), "user_id", ["us", "event_id"], "event_type", _MACHINE, "start")


# ---- graphs ------------------------------------------------------------------------------------------------

def _tree(spark, d):
    return table(spark, d, "customer").where("c_custkey > 0").select(F.floor(F.col("c_custkey") / 2).cast("bigint").alias("src"), F.col("c_custkey").alias("dst"))


@query("""with recursive r as (select cast(3 as bigint) as node, 0 as depth, cast(null as bigint) as parent, '3' as path union all
select c.c_custkey, r.depth + 1, r.node, r.path || '>' || c.c_custkey from r join customer c on c.c_custkey // 2 = r.node and c.c_custkey > r.node) select *, false as capped from r""")
def closure_paths(spark, d):
    found = graph.reach(_tree(spark, d), spark.createDataFrame([(3,)], "node long"))
    return found.withColumn("path", F.array_join(F.transform("path", lambda n: n.cast("string")), ">"))


@query("""with recursive r as (select cast(0 as bigint) as node, 0 as round union all select c.c_custkey, r.round + 1 from r join customer c on c.c_custkey // 2 = r.node and c.c_custkey > 0) select * from r""")
def level_order(spark, d):
    t = _tree(spark, d)
    return graph.level_order(t.select(F.col("dst").alias("node"), F.col("src").alias("need")), table(spark, d, "customer").select(F.col("c_custkey").alias("node")))


@query("""select c_custkey as node, c_custkey - c_custkey % 5 as component from customer where c_custkey - c_custkey % 5 + 4 <= (select max(c_custkey) from customer)""")
def scc(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    ring = c.select(F.col("k").alias("src"), F.expr("k - k % 5 + (k % 5 + 1) % 5").alias("dst"))
    cross = c.select(F.col("k").alias("src"), (F.col("k") + 7).alias("dst"))
    top = c.agg(F.max("k").alias("m"))
    edges = ring.unionByName(cross).join(F.broadcast(top)).where("dst <= m").select("src", "dst")
    return graph.scc(edges, graph.LOCAL)


@query("""with n as (select n_regionkey as part, n_name as node, row_number() over (partition by n_regionkey order by n_nationkey) as ord, count(*) over (partition by n_regionkey) as c from nation)
select part, case when part > 0 then cast(ord as bigint) end as ord, node, case when part = 0 then 'refused: ' || (select string_agg(node, ' -> ' order by node) from n where part = 0 and ord in (1, c)) || ' -> ' || (select min(node) from n where part = 0 and ord in (1, c)) end as note from n""")
def topo_order(spark, d):
    # each nation needs the one before it in its region; in one region the first and the last also need each other
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("part"), F.col("n_name").alias("node"), F.col("n_nationkey").alias("k"))
    other = n.select("part", F.col("node").alias("need"), F.col("k").alias("b"))
    before = n.join(other, "part").where("b < k").groupBy("part", "node").agg(F.max_by("need", "b").alias("need"))
    ends = n.where("part = 0").groupBy("part").agg(F.min_by("node", "k").alias("node"), F.max_by("node", "k").alias("need"))
    more = ends.unionByName(ends.select("part", F.col("need").alias("node"), F.col("node").alias("need")))
    return graph.heap_order(before.unionByName(more), n.select("part", "node", (F.col("k") % 2).cast("long").alias("rank")))


@query("""with recursive gone as (select c_custkey as node from customer where c_custkey % 50 = 13 union all select c.c_custkey from gone g join customer c on c.c_custkey // 2 = g.node and c.c_custkey > g.node)
select c_custkey as node, c_custkey not in (select node from gone) as kept, case when c_custkey in (select node from gone) then c_custkey // 2 end as reason from customer where c_custkey % 50 <> 13""")
def dependency_trim(spark, d):
    t = _tree(spark, d)
    objects = table(spark, d, "customer").where("c_custkey % 50 <> 13").select(F.col("c_custkey").alias("node"))
    return graph.trim(objects, t.select(F.col("dst").alias("node"), F.col("src").alias("need")))


@query("""select distinct l_partkey as part, kind, key from (select l_partkey, 'order' as kind, l_orderkey as key from lineitem
 union all select l_partkey, 'supplier', l_suppkey from lineitem union all select p_partkey, 'size', p_size from part)""")
def column_dependants(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    branch = lambda df, part, kind, key: df.select(F.col(part).alias("part"), F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("key"))
    return branch(l, "l_partkey", "order", "l_orderkey").unionByName(branch(l, "l_partkey", "supplier", "l_suppkey")).unionByName(branch(p, "p_partkey", "size", "p_size")).distinct()


# ---- text --------------------------------------------------------------------------------------------------

@query(r"""select doc_id, sha256(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\x0B\f]+\n', chr(10), 'g'), '[ \t\x0B\f\n]+$', '')) as sha from documents""")
def normal_form_checksum(spark, d):
    return table(spark, d, "documents").select("doc_id", X.checksum(F.col("text")).alias("sha"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents) select doc_id, n - 1 as pos, length(line) as n_chars from l""")
def line_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.length("line").cast("bigint").alias("n_chars"))


@query(r"""select doc_id from documents where regexp_matches(text, '(?i)(^|[^\w@#$])(password|secret)\s*=\s*(N?''|0x[0-9a-f])')
 or regexp_matches(text, '(?i)(password|passwd|pwd|secret|passphrase)\w*[\]"]?(\s+(AS\s+)?\[?[a-z_]+\]?(\s*\([^)]*\))?)?\s*=\s*\(?\s*(N?''|0x[0-9a-f])|(password|pwd)=[^\s;''"@]|(EN|DE)CRYPTBYPASSPHRASE\s*\(\s*N?''')""")
def secret_scan(spark, d):
    return table(spark, d, "documents").where(X.secret_in_text(F.col("text"))).select("doc_id")


@query(r"""with recursive q as (select doc_id, regexp_replace(regexp_replace(text, '''(?:[^'']|''\w)*(?:''|$)', '<redacted>', 'g'), '"[^"]*(?:"|$)', '<redacted>', 'g') as t from
  (select doc_id, regexp_replace(text, '(?is)(The duplicate key value is|Truncated value:).*', '\1 <redacted>') as text from documents)),
r as (select doc_id, t, 0 as n from q union all select doc_id, regexp_replace(t, '\([^()]*\)', '<redacted>', 'g'), n + 1 from r where regexp_matches(t, '\([^()]*\)')),
l as (select doc_id, arg_max(t, n) as t from r group by 1)
select doc_id, substr(trim(regexp_replace(regexp_replace(t, '(?s)\(.*', '<redacted>'), '[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), 1, 300) as message from l""")
def redact_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.redact(F.col("text")).alias("message"))


@query()
def tokenize_stats(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    tokens.register(docs)
    docs.createOrReplaceTempView("deltaloom_texts")
    return spark.sql("""select doc_id, coalesce(kind, problem) as kind, count(*) as n, max(coalesce(line, at_line)) as lines from deltaloom_texts, lateral tokenize_text(text)
 group by doc_id, coalesce(kind, problem)""")


@query(r"""with r as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as target from pages), known as (select distinct '/' || regexp_extract(text, '^(\w+)', 1) as target from documents)
select page_id, target, count(*) as n from r where target in (select target from known) group by 1, 2""")
def reference_scan(spark, d):
    refs = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    known = table(spark, d, "documents").select(F.concat(F.lit("/"), F.regexp_extract("text", r"^([0-9A-Za-z_]+)", 1)).alias("target")).distinct()
    return refs.join(known, "target", "left_semi").groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


@query("""with e as (select event_id, event_type, cast(json_extract_string(props, '$.k') as integer) as k from events),
c as (select *, case when k % 20 = 1 then 1222 when k % 20 = 2 then 1205 when k % 20 = 3 then 40613 when k % 20 = 4 then 9002 when k % 20 = 5 then 99 end as given, case when k % 6 = 0 then '08S01' end as state,
 case when event_type = 'view' then 1222 when event_type = 'purchase' then 208 end as known from e), n as (select *, coalesce(given, known) as number from c)
select event_id, case when number = 9002 then 'governance' when number = 1222 then 'lock_timeout' when number = 1205 then 'deadlock' when event_type = 'click' and number = 40613 then 'transient_connect'
 when state is not null then 'session_lost' else 'other' end as class,
 case when event_type = 'view' then 1222 when event_type = 'error' then 4711 when event_type = 'purchase' then 208 end as written from n""")
def error_classification(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    number = F.when(k % 20 == 1, 1222).when(k % 20 == 2, 1205).when(k % 20 == 3, 40613).when(k % 20 == 4, 9002).when(k % 20 == 5, 99)
    state, kind = F.when(k % 6 == 0, "08S01"), F.col("event_type")
    message = F.when(kind == "view", "x: Lock request time out\n period exceeded.").when(kind == "error", "Msg 4711, Level 16").when(kind == "purchase", "[42S02] (0) Invalid object name 't'.").otherwise(kind)
    return table(spark, d, "events").select("event_id", X.error_class(number, state, message, kind == "click").alias("class"), X.parse_number(message).alias("written"))


# ---- rules and plans ---------------------------------------------------------------------------------------

@query("""select distinct * from (select 'ORD001' as code, 'error' as severity, cast(o_orderkey as varchar) as key, 'order without lines' as message from orders where o_orderkey not in (select l_orderkey from lineitem)
union all select 'LIN001', 'warning', cast(l_orderkey as varchar), 'high discount' from lineitem where l_discount > 0.09 union all select 'LIN002', 'error', cast(l_orderkey as varchar), 'line without part' from lineitem where l_partkey not in (select p_partkey from part)
union all select 'LIN003', 'error', cast(l_orderkey as varchar), 'line number twice' from lineitem group by l_orderkey, l_linenumber having count(*) > 1)""")
def findings_union(spark, d):
    t = {n: table(spark, d, n) for n in ("orders", "lineitem", "part")}
    return rules.findings(t, [
        lambda t: rules.finding(t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"), "ORD001", "error", F.col("o_orderkey"), "order without lines"),
        lambda t: rules.finding(t["lineitem"].where("l_discount > 0.09"), "LIN001", "warning", F.col("l_orderkey"), "high discount"),
        lambda t: rules.finding(t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey"), "left_anti"), "LIN002", "error", F.col("l_orderkey"), "line without part"),
        lambda t: rules.finding(t["lineitem"].groupBy("l_orderkey", "l_linenumber").count().where("count > 1"), "LIN003", "error", F.col("l_orderkey"), "line number twice"),
    ])


@query("""with i as (select distinct l_orderkey, l_returnflag from lineitem where l_discount > 0.08), a as (select distinct l_orderkey, l_returnflag from lineitem where l_tax > 0.07)
select *, 'needs allow' as problem from (select * from i except select * from a) union all select *, 'stray allow' from (select * from a except select * from i)""")
def allow_matching(spark, d):
    l = table(spark, d, "lineitem")
    on = ["l_orderkey", "l_returnflag"]
    return rules.allow_mismatches(l.where("l_discount > 0.08").select(*on).distinct(), l.where("l_tax > 0.07").select(*on).distinct(), on)


@query("""with n as (select *, row_number() over (order by n_regionkey, n_nationkey) - 1 as o from nation),
h as (select sha256('{"_ord":' || o || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') as h from n) select sha256(string_agg(h, '' order by h)) as plan_hash from h""")
def plan_identity(spark, d):
    return rules.plan_hash(table(spark, d, "nation"), ["n_regionkey", "n_nationkey"], ["n_name", "n_regionkey"])


# ---- example schema's queries ------------------------------------------------------------------------------

@query("""with t as (select o_custkey, o_orderkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(38,2)) as total from orders join lineitem on l_orderkey = o_orderkey group by 1, 2)
select c_custkey, count(t.o_orderkey) as orders, cast(coalesce(sum(t.total), 0) as double) as revenue, cast(max(t.total) as double) as largest from customer left join t on t.o_custkey = c_custkey and t.total > 1000 group by 1""")
def customer_revenue(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    sums = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"))
    t = o.join(sums, F.col("o_orderkey") == F.col("l_orderkey")).where("total > 1000")
    per = t.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("total").alias("revenue"), F.max("total").alias("largest"))
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)).alias("revenue"), F.col("largest").cast("double").alias("largest"))


@query("""select l_orderkey, count(*) as lines, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as total from lineitem group by 1""")
def order_totals(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""select o_orderkey, c_name, case o_orderstatus when 'O' then 'open' when 'P' then 'partial' else 'final' end as status_name from orders join customer on c_custkey = o_custkey where o_orderstatus in ('O', 'P')""")
def open_orders(spark, d):
    name = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "partial").otherwise("final")
    o = table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P"))
    return o.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name", name.alias("status_name"))


@query("""with u as (select l_partkey, cast(sum(cast(l_quantity as decimal(18,2))) as double) as used from lineitem group by 1)
select p_partkey, p_name, coalesce(used, 0) as used, s_name from part left join u on l_partkey = p_partkey join supplier on s_suppkey = p_partkey % 10 where coalesce(used, 0) > p_size * 20""")
def low_stock(spark, d):
    used = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("used"))
    p = table(spark, d, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("used", F.coalesce("used", F.lit(0.0)))
    return p.where("used > p_size * 20").join(table(spark, d, "supplier"), F.expr("s_suppkey = p_partkey % 10")).select("p_partkey", "p_name", "used", "s_name")


@query("""select p_partkey, cast(cast(p_retailprice as decimal(18,2)) as double) as old_price, cast(cast(p_retailprice as decimal(18,2)) + 1 as double) as new_price from part where p_partkey % 4 = 0""")
def price_history_capture(spark, d):
    before = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    after = before.select("p_partkey", F.expr("cast(case when p_partkey % 4 = 0 then price + 1 else price end as decimal(18,2))").alias("new"))
    return after.join(before, "p_partkey", "left").where(~F.col("price").eqNullSafe(F.col("new"))).select("p_partkey", F.col("price").cast("double").alias("old_price"), F.col("new").cast("double").alias("new_price"))


@query("""select p_partkey, regexp_matches(p_brand, '^[A-Za-z]+#[0-9]+$') and not regexp_matches(p_name, '[^a-z ]') as valid from part""")
def valid_sku(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_brand").rlike("^[A-Za-z]+#[0-9]+$") & ~F.col("p_name").rlike("[^a-z ]")).alias("valid"))


# ---- streams -----------------------------------------------------------------------------------------------

@query("""select epoch_us(ts) // 3600000000 as hour, event_type, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total from events group by 1, 2""")
def stream_windows(spark, d):
    schema = table(spark, d, "events").schema
    stream = streaming.window_counts(streaming.read_events(spark, f"{d}/events.parquet*", schema), "1 hour", "2 hours")
    out = streaming.drain(stream, "complete", "windows")
    return out.select(F.floor(F.unix_micros("begin") / 3600000000).cast("bigint").alias("hour"), "event_type", "n", "total")


def queries() -> dict:
    from deltaloom import queries_catalog, queries_model, queries_release, queries_text  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


__all__ = ["oracle_sql", "queries"]
