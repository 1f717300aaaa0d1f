"""Tool-call linking for chat data: hash join by identifier, topological order, schema checks, canonical JSON.

Input: a relation of messages with one row for each call or result,

    conversation  bigint|string   the conversation
    position      bigint          place in the log; need not be dense, and need not be the order of the calls
    kind          string          'call', 'result' or anything else (plain message)
    call_id       string          identifier that a call and its results share
    tool          string          tool of a call
    arguments     map<string,string>   a call's arguments, as they were written
    needs         array<string>   identifiers of calls whose results the call uses
    content       string          body of a result or plain message

Schemas: a relation (tool, field, type, required); types are string, integer, number, boolean.

All steps are joins and aggregations by key.  No conversation is gathered into one row or one task: the order
comes from a relaxation over edges that need it, the numbers from a range exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.llm.common import drop, indexed, stage, with_position
from deltaloom.operators import graph

SCHEMA_COLUMNS = T.StructType([
    T.StructField("tool", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("required", T.BooleanType()),
])
INPUT = ["conversation", "position", "kind", "call_id", "tool", "arguments", "needs", "content"]
#: Columns that this module adds or uses on the way.
OWN = [
    "uid", "link", "call_uid", "call_position", "result_uid", "rank", "rank_position", "rank_step", "on_cycle", "fields", "errors", "json", "seq", "_at",
    "_start", "_m",
]

#: Patterns that a value of a type matches.
_TYPES = {
    "integer": r"\A-?(0|[1-9][0-9]*)\z",
    "number": r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z",
    "boolean": r"\A(true|false)\z",
    "string": r"(?s)\A.*\z",
}


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """left joined to right on keys of which the first, the conversation, may be null on both sides."""
    first, *rest = keys
    named = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = F.col(first).eqNullSafe(F.col(f"_k_{first}"))
    for k in rest:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    return left.join(named, on, how).drop(*[f"_k_{k}" for k in keys])


def link(messages: DataFrame) -> DataFrame:
    """Adds uid, link ('linked', 'unanswered', 'orphan', 'duplicate', 'message'), call_uid and call_position.

    Of calls with one identifier in a conversation the earliest counts, the others are 'duplicate'; so are
    later results of one call.  A result without a call is 'orphan', and so is one without an identifier; a call without
    one is 'unanswered'.
    """
    staged = stage(with_position(messages, "uid"), "op1-messages")
    keys = ["conversation", "call_id"]
    narrow = staged.where("kind in ('call', 'result') and call_id is not null").select(*keys, "kind", "position", "uid")
    first = narrow.groupBy(*keys).agg(
        F.min(F.when(F.col("kind") == "call", F.struct("position", "uid"))).alias("c"),
        F.min(F.when(F.col("kind") == "result", F.struct("position", "uid"))).alias("r"),
    ).select(
        *keys, F.col("c.uid").alias("call_uid"), F.col("c.position").alias("call_position"),
        F.col("r.uid").alias("result_uid"),
    )
    joined = same(staged, first, keys, "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    return joined.withColumn(
        "link",
        F.when(~F.coalesce(is_call | is_result, F.lit(False)), "message")
        .when(is_call & F.col("call_id").isNull(), "unanswered")
        .when(F.col("call_uid").isNull(), "orphan")
        .when(is_call & (F.col("uid") != F.col("call_uid")), "duplicate")
        .when(is_result & (F.col("uid") != F.col("result_uid")), "duplicate")
        .when(is_call & F.col("result_uid").isNull(), "unanswered")
        .otherwise("linked"),
    )


def order(linked: DataFrame) -> DataFrame:
    """Adds rank_position, rank_step and on_cycle: sorting a conversation by the first two puts each call after the
    results it needs and each result after its call, wherever they stand in the log, and changes nothing in a log
    that is already in such an order.

    Rows on a cycle have no such order: on_cycle marks them.  The edges inside a cycle are left out, so these rows
    keep the order of the log among themselves, but stand after what they need from outside and before what needs them.
    A node's rank is the largest of its own (position, 0) and (p, s + 1) over its predecessors' ranks (p, s).  Each
    round moves the ranks along the edges that are out of order; an ordered log needs none, others as many as the
    longest run of edges that is out of order.  What is left has no cycle, so the rounds end.
    """
    staged = stage(linked, "op1-linked")
    nodes = staged.select("uid", "conversation", "call_id", "kind", "link", "position", "call_uid", "call_position", "needs")
    to_result = nodes.where("kind = 'result' and call_uid is not null").select(
        "conversation", F.col("call_uid").alias("src"), F.col("uid").alias("dst"), F.col("call_position").alias("before"), F.col("position").alias("at"))
    wanted = nodes.where("kind = 'call'").select(
        "conversation", F.explode("needs").alias("call_id"), F.col("uid").alias("dst"), F.col("position").alias("at"))
    answers = nodes.where("kind = 'result' and link = 'linked'").select(
        "conversation", "call_id", F.col("uid").alias("src"), F.col("position").alias("before"))
    from_result = same(wanted, answers, ["conversation", "call_id"], "inner").select("conversation", "src", "dst", "before", "at")
    edges = stage(to_result.unionByName(from_result).select(
        "conversation", "src", "dst", (~F.coalesce(F.col("before") < F.col("at"), F.lit(False))).alias("back")).distinct(), "op1-edges")
    # a cycle has an edge that doesn't go forward in the log; other conversations have none
    turned = edges.where("back").select("conversation").distinct()
    cycles = staged.select(F.col("uid").alias("node"), F.col("uid").alias("component")).limit(0)
    if not turned.isEmpty():
        cycles = stage(graph.scc(same(edges, turned, ["conversation"], "left_semi").select("src", "dst")), "op1-cycles")
        if not cycles.isEmpty():
            ends = edges
            for end in ("src", "dst"):
                ends = ends.join(cycles.select(F.col("node").alias(end), F.col("component").alias("c_" + end)), end, "left")
            edges = stage(ends.where("not coalesce(c_src = c_dst, false)").select("src", "dst"), "op1-acyclic")
    staged = staged.join(cycles.select(F.col("node").alias("uid"), F.lit(True).alias("on_cycle")), "uid", "left").withColumn(
        "on_cycle", F.coalesce("on_cycle", F.lit(False)))
    ranks = nodes.select("uid", F.struct(F.col("position").alias("p"), F.lit(0).alias("s")).alias("rank"))
    moved: DataFrame | None = None
    while True:
        now = ranks if moved is None else ranks.join(moved.withColumnRenamed("rank", "_m"), "uid", "left").select(
            "uid", F.coalesce("_m", "rank").alias("rank"))
        reach = (
            edges.join(now.select(F.col("uid").alias("src"), F.col("rank").alias("from")), "src")
            .groupBy(F.col("dst").alias("uid")).agg(F.max(F.struct(F.col("from.p").alias("p"), (F.col("from.s") + 1).alias("s"))).alias("least"))
        )
        late = stage(reach.join(now, "uid").where("rank < least").select("uid", F.col("least").alias("rank")), "op1-late")
        if late.isEmpty():
            break
        before, moved = moved, late if moved is None else stage(late.unionByName(moved.join(late, "uid", "left_anti")), "op1-moved")
        if before is not None:
            drop(before, late)
    if moved is None:
        return staged.withColumns({"rank_position": F.col("position"), "rank_step": F.lit(0)})
    return staged.join(moved, "uid", "left").withColumns({
        "rank_position": F.coalesce("rank.p", "position"), "rank_step": F.coalesce("rank.s", F.lit(0))}).drop("rank")


def validate(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds fields (the tool's schema) and errors, a sorted array<string>: empty for a valid call, null for rows that
    aren't calls.

    'unknown tool', 'missing F', 'unexpected F', 'F is not T', 'F has no known type'.  The fields of one tool are
    gathered (a tool's schema is small whatever the data's size); the join is by tool.
    """
    fields = schemas.where("tool is not null and field is not null").distinct().groupBy("tool").agg(
        F.sort_array(F.collect_list(F.struct("field", "type", "required"))).alias("fields"))
    args = F.coalesce(F.col("arguments"), F.create_map().cast("map<string,string>"))

    def problem(value: Column, kind: Column) -> Column:
        out = F.lit("has no known type")
        for name, pattern in _TYPES.items():
            out = F.when(kind == name, F.when(~value.rlike(pattern), F.lit(f"is not {name}"))).otherwise(out)
        return out

    missing = F.transform(
        F.filter("fields", lambda f: F.coalesce(f["required"], F.lit(False)) & args[f["field"]].isNull()), lambda f: F.concat(F.lit("missing "), f["field"]))
    wrong = F.array_compact(F.transform(
        F.filter("fields", lambda f: args[f["field"]].isNotNull()),
        lambda f: F.concat(f["field"], F.lit(" "), problem(args[f["field"]], f["type"]))))
    known = F.transform("fields", lambda f: f["field"])
    extra = F.transform(
        F.filter(F.map_keys(args), lambda k: ~F.array_contains(known, k)), lambda k: F.concat(F.lit("unexpected "), k))
    errors = F.when(F.col("fields").isNull(), F.array(F.lit("unknown tool"))).otherwise(F.array_sort(F.concat(missing, wrong, extra)))
    return (
        messages.join(fields, "tool", "left")
        .withColumn("errors", F.when(F.col("kind") == "call", errors))
    )


def quoted(text: Column) -> Column:
    """A string as JSON."""
    held = F.to_json(F.array(text))
    return F.substring(held, F.lit(2), F.length(held) - 2)


def canonical_json(messages: DataFrame) -> DataFrame:
    """Adds json: keys in alphabetical order, no spaces, arguments sorted by name, absent parts left out.

    An argument whose schema says integer, number or boolean, and whose text is one, is written as such (an integer -0 as
    0); all others are strings.  An argument that is null is null.
    """
    args, fields = F.col("arguments"), F.coalesce(F.col("fields"), F.array().cast("array<struct<field:string,type:string,required:boolean>>"))

    def written(k: Column) -> Column:
        value = args[k]
        plain = F.lit(False)
        for name in ("integer", "number", "boolean"):
            plain = plain | (F.exists(fields, lambda f: (f["field"] == k) & (f["type"] == name)) & value.rlike(_TYPES[name]))
        text = F.when(value.isNull(), "null").when(plain, F.when(value == "-0", "0").otherwise(value)).otherwise(quoted(value))
        return F.concat(quoted(k), F.lit(":"), text)

    inside = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(args)), written), ","), F.lit("}"))
    part = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value))
    whole = lambda *parts: F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    id_, content = part("id", quoted(F.col("call_id"))), part("content", quoted(F.col("content")))
    call = whole(part("arguments", inside), id_, F.lit('"kind":"call"'), part("name", quoted(F.col("tool"))))
    result = whole(content, id_, F.lit('"kind":"result"'))
    plain = whole(content, part("kind", quoted(F.col("kind"))))
    return messages.withColumn("json", F.when(F.col("kind") == "call", call).when(F.col("kind") == "result", result).otherwise(plain))


def format_chats(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """Links, orders, validates and serialises; adds seq, the place 0.. in the conversation's order, and on_cycle.

    Null conversations form one conversation of their own; null positions sort first.  Repeated rows stay, as
    'duplicate'.  An empty relation gives an empty result.  Other columns of the input are kept, but for those named
    like one that this module adds (`OWN`), which are replaced or left out.
    """
    others = [c for c in messages.columns if c.lower() not in {*INPUT, *OWN}]
    taken = messages.select(*INPUT, *[F.col(f"`{c}`") for c in others])
    full = canonical_json(validate(order(link(taken)), schemas)).drop("fields")
    keys = ["conversation", "rank_position", "rank_step", "uid"]
    placed = stage(indexed(full, keys, "op1-order", "_at"), "op1-placed")
    starts = placed.groupBy("conversation").agg(F.min("_at").alias("_start"))
    return same(placed, starts, ["conversation"], "inner").withColumn("seq", F.col("_at") - F.col("_start")).drop("_at", "_start")
