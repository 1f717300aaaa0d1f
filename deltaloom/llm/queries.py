"""The queries of the training-data operators over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.llm import op01_chat, op02_urls, op03_jaccard, op04_packing, op05_tokens, op06_shards, op07_quality
from deltaloom.llm import op08_decontaminate, op09_warc, op10_fingerprints
from deltaloom.llm.common import stage_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: What the tools of a conversation take.
CHAT_SCHEMA = [
    ("ask", "text", "string", True), ("ask", "turn", "integer", True), ("ask", "first", "boolean", True),
    ("tell", "text", "string", True), ("tell", "turn", "integer", True), ("tell", "summary", "string", True), ("tell", "accents", "integer", False),
]


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """User turns as calls, assistant turns as results of the turn before, other turns as plain messages.

    The conversations hold no tool calls of their own, so they are read as the log of a client that sends its calls all at
    once: a row's position is (5 * turn + conv_id) modulo the number 8 of turns in a block, which is not the turns' order.
    A call needs the result of the call two turns before, so the order has to be found from identifiers.  A call is an
    'ask' below 200 characters, else a 'tell'; its arguments are what the text has: the first line where there are
    several is its summary, and its characters beyond ASCII are counted as accents.
    """
    name = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    role, turn, text = F.col("role"), F.col("turn"), F.col("text")
    short = F.length(text) < 200
    accents = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    arguments = F.map_filter(F.create_map(
        F.lit("text"), text, F.lit("turn"), turn.cast("string"), F.lit("first"), F.when(short, (turn < 2).cast("string")),
        F.lit("summary"), F.when(~short & text.contains("\n"), F.substring_index(text, "\n", 1)),
        F.lit("accents"), F.when(accents > 0, accents.cast("string"))), lambda k, v: v.isNotNull())
    return conversations.select(
        F.col("conv_id").alias("conversation"), ((turn - F.pmod(turn, F.lit(8))) + F.pmod(turn * 5 + F.col("conv_id"), F.lit(8))).cast("bigint").alias("position"),
        F.when(role == "user", "call").when(role == "assistant", "result").otherwise("message").alias("kind"),
        F.when(role == "user", name(turn)).when(role == "assistant", name(turn - 1)).alias("call_id"),
        F.when(role == "user", F.when(short, "ask").otherwise("tell")).alias("tool"),
        F.when(role == "user", arguments).alias("arguments"),
        F.when(role == "user", F.array(name(turn - 2))).alias("needs"),
        F.when(~F.coalesce(role == "user", F.lit(False)), text).alias("content"), turn.cast("bigint").alias("turn"))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.createDataFrame(CHAT_SCHEMA, op01_chat.SCHEMA_COLUMNS)
    out = op01_chat.format_chats(conversation_messages(table(spark, sf_dir, "conversations")), schemas)
    return out.select(
        F.col("conversation").alias("conv_id"), "turn", "position", "kind", "call_id", "link", "seq", "on_cycle", F.array_join("errors", "; ").alias("errors"), "json")


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: The list of unwanted domains: one relation of names, which stand for their subdomains too.
LISTED = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = spark.createDataFrame([(name,) for name in LISTED], "key string")
    held = op02_urls.filter_of(listed, pages.select(op02_urls.split_url(F.col("url"))[0].alias("host")))
    return op02_urls.judge(pages, RULES, held).select("page_id", "host", "path", "rule", "verdict", "listed")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_jaccard.near_groups(table(spark, sf_dir, "documents"), op03_jaccard.Plan(words=3, num=90, den=100, n2=2, k2=1))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_tokens.count_tokens(table(spark, sf_dir, "documents"), op05_tokens.pieces(tokenizer("piece_bpe_32k.model")))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_shards.assign(table(spark, sf_dir, "documents"), "doc_id", "text", 16)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op07_quality.score(docs, op07_quality.train(docs, table(spark, sf_dir, "labels")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op08_decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "op9-archives")
    op09_warc.write(table(spark, sf_dir, "pages"), path)
    found = op09_warc.read(spark, path)
    # these archives are whole: a gap would be a lost page, so it ends the query instead of leaving the result short
    gap = F.raise_error(F.concat_ws(" ", F.lit("gap:"), "reason", "path", F.col("position").cast("string"))).cast("bigint")
    page = F.when(F.col("kind") == "record", F.col("page_id")).otherwise(gap).alias("page_id")
    return found.select(page, "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_fingerprints_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_chat": op1_chat, "op2_urls": op2_urls, "op3_jaccard": op3_jaccard, "op4_packing": op4_packing, "op5_tokens": op5_tokens,
        "op6_shards": op6_shards, "op7_quality": op7_quality, "op8_decontaminate": op8_decontaminate, "op9_warc": op9_warc,
        "op10_fingerprints": op10_fingerprints_,
    }


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op1_chat": """with t as (select conv_id, cast(turn as bigint) as turn, role, text, turn - turn % 8 + (turn * 5 + conv_id) % 8 as position, length(text) < 200 as short,
 length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) as accents, case when length(text) >= 200 and contains(text, chr(10)) then split_part(text, chr(10), 1) end as summary,
 cast(conv_id as varchar) || '-' as c, lead(role) over (partition by conv_id order by turn) as follows, lag(role) over (partition by conv_id order by turn) as leads,
 role in ('user', 'assistant') as chained from conversations),
p as (select *, max(position) over (partition by conv_id, chained order by turn) as top from t),
r as (select *, row_number() over (partition by conv_id, chained, top order by turn) as step from p),
s as (select *, row_number() over (partition by conv_id order by top, step) - 1 as seq, to_json(text) as jtext from r)
select conv_id, turn, cast(position as bigint) as position, case role when 'user' then 'call' when 'assistant' then 'result' else 'message' end as kind,
 case role when 'user' then c || turn when 'assistant' then c || (turn - 1) end as call_id,
 case when role = 'user' then case when follows = 'assistant' then 'linked' else 'unanswered' end when role = 'assistant' then case when leads = 'user' then 'linked' else 'orphan' end else 'message' end as link,
 cast(seq as bigint) as seq, false as on_cycle,
 case when role = 'user' then concat_ws('; ', case when not short and summary is null then 'missing summary' end, case when short and accents > 0 then 'unexpected accents' end) end as errors,
 case when role = 'user' then '{"arguments":{' || concat_ws(',', case when accents > 0 then '"accents":' || case when short then '"' || accents || '"' else cast(accents as varchar) end end,
   case when short then '"first":' || case when turn < 2 then 'true' else 'false' end end, case when summary is not null then '"summary":' || to_json(summary) end, '"text":' || jtext, '"turn":' || turn)
   || '},"id":"' || c || turn || '","kind":"call","name":"' || case when short then 'ask' else 'tell' end || '"}'
  when role = 'assistant' then '{"content":' || jtext || ',"id":"' || c || (turn - 1) || '","kind":"result"}'
  else '{"content":' || jtext || ',"kind":"message"}' end as json from s""",
    "op2_urls": f"""with u as (select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
h as (select page_id, {_LOWER.format("regexp_extract(r, '^([^/?#]*)', 1)")} as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from u),
f as (select *, case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
 when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
 when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/' when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule,
 {" or ".join(f"host = '{n}' or ends_with(host, '.{n}')" for n in LISTED)} as listed from h)
select page_id, host, path, rule, listed, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null or listed then 'block' else 'allow' end as verdict from f""",
    "op8_decontaminate": f"""with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark),
win as (select distinct item_id, list_slice(w, p, p + 9) as k from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as p from b where len(w) > 0)),
sizes as (select distinct len(k) as n from win), sp as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n),
occ as (select a.doc_id, a.p, a.n, win.item_id from sp a join win on list_slice(a.w, a.p, a.p + a.n - 1) = win.k),
hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from occ) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as s from (select distinct doc_id, cast(item_id as varchar) as i from occ) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)""",
    "op9_warc": """with p as (select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and first_id <> page_id then 'revisit' else 'response' end as record_type,
 case when payload_bytes >= 100 and first_id <> page_id then first_id end as refers_to from f""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
