"""Benchmark decontamination: a prefix-filtered set join of document shingles with benchmark windows.

A window is `width` consecutive words of an item (a shorter item is one window); a document is hit where all words
of a window occur in a row.  Full containment is a set join with threshold 1, whose necessary prefix is the one
rarest shingle of a window: a document that holds the window holds that shingle.

1. One pass over the texts keeps, of each document, the shingles that a bitmap of the benchmark's shingles passes,
   with their positions and the words around them (the bitmap's size is bounded; a false pass costs a row, no more).
2. Shingles are ordered by their frequency in the documents; each window's rarest is its prefix token.
3. Documents and windows are joined on that token; a candidate has to leave room before and after it (length and
   position bounds), and its words are compared with the window's, one by one.

Only DataFrame expressions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import MAX_BITS, ascii_lower, bitmap, free_name, has_bit, let, stage, with_position

WIDTH = 10
SHINGLE = 3
#: What parts words, after A-Z are lower-cased (fixed value of the contract).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text; null and texts without words give an empty array."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _shingles(w: Column, sizes: list[int]) -> Column:
    """array<struct<p, s, h>>: position, size and hash of the shingles of each size."""
    parts = []
    for s in sizes:
        last = F.size(w) - s
        at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(at, _shingle_at(w, s)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _shingle_at(w: Column, s: int):
    return lambda p: F.struct(
        p.alias("p"), F.lit(s).alias("s"), F.xxhash64(F.lit(s), *[F.get(w, p + i) for i in range(s)]).alias("h"))


def windows(benchmark: DataFrame, width: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, words of each window; items without words and null items have none."""
    split = benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    return split.select("item", F.explode(F.transform(starts, lambda p: F.slice("w", p + 1, width))).alias("words")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, carry: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(base, found): base has _uid, the carried columns and n_words for each row of docs; found has _uid, start, length, items
    (array of item ids) for each occurrence of a window."""
    items = stage(windows(benchmark, width), "op8-items")
    wins = stage(
        items.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("win", F.xxhash64("words"))
        .withColumn("size", F.size("words")), "op8-windows")
    sizes = sorted(min(shingle, r[0]) for r in wins.select("size").distinct().collect())  # at most `width` values
    sizes = sorted(set(sizes))
    if not sizes:
        base = docs.select(*carry, F.size(words(F.col("text"))).cast("long").alias("n_words"))
        base = stage(with_position(base, "_uid"), "op8-base")
        none = base.limit(0).select("_uid", F.lit(0).alias("start"), F.lit(0).alias("length"), F.array().cast(items.schema["item"].dataType.simpleString().join(["array<", ">"])).alias("items"))
        return base, none
    # all shingles of a window, in its own size
    tokens = stage(wins.select("win", "words", "items", "size", F.explode(
        F.filter(_shingles(F.col("words"), sizes), lambda x: x["s"] == F.least(F.col("size"), F.lit(shingle)))).alias("x")
    ).select("win", "words", "items", "size", F.col("x.p").alias("p"), F.col("x.h").alias("h")), "op8-tokens")
    n = tokens.select("h").distinct().count()
    bits = min(MAX_BITS, 1 << max(12, math.ceil(math.log2(64 * max(1, n)))))
    held = bitmap(tokens.select(F.pmod("h", F.lit(bits)).alias("slot")), "slot", bits)

    def passing(w: Column) -> Column:
        cut = F.filter(_shingles(w, sizes), lambda x: has_bit(held, F.pmod(x["h"], F.lit(bits))))
        around = lambda p: F.slice(w, F.greatest(p - (width - 1), F.lit(0)) + 1, 2 * width)
        return F.struct(F.size(w).cast("long").alias("n_words"), F.transform(cut, lambda x: F.struct(
            x["p"].alias("p"), x["h"].alias("h"), around(x["p"]).alias("around"))).alias("x"))

    scan = docs.select(*carry, let(words(F.col("text")), passing).alias("r"))
    base = stage(with_position(scan.select(*carry, F.col("r.n_words").alias("n_words"), F.col("r.x").alias("x")), "_uid"), "op8-base")
    seen = base.where("size(x) > 0").select("_uid", "n_words", F.explode("x").alias("x")).select("_uid", "n_words", "x.*")
    # order by rarity: documents' frequencies of the benchmark's shingles
    often = seen.groupBy("h").agg(F.count(F.lit(1)).alias("f"))
    prefix = (
        tokens.join(often, "h", "left").groupBy("win")
        .agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), F.col("h"), F.col("p"))).alias("least"), F.first("words").alias("words"), F.first("items").alias("items"), F.first("size").alias("size"))
        .where("least.f > 0")
        .select(F.col("least.h").alias("h"), F.col("least.p").alias("o"), "words", "items", "size")
    )
    found = (
        seen.join(stage(prefix, "op8-prefix"), "h")
        .where("p >= o and p - o + size <= n_words")
        .where(F.slice("around", F.least(F.col("p"), F.lit(width - 1)) - F.col("o") + 1, F.col("size")) == F.col("words"))
        .select("_uid", (F.col("p") - F.col("o")).alias("start"), F.col("size").alias("length"), "items")
    )
    return base.select("_uid", *carry, "n_words"), found


def covered(spans: Column) -> Column:
    """Number of words in the union of spans, an array<struct<start, length>>."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), zero, lambda a, s: F.struct(
        F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).cast("long").alias("n"),
    ), lambda a: a["n"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs without any benchmark window, all columns as they are, whatever their names.  Rows of one doc_id
    and text go or stay together; null texts and null ids are rows like others; an empty table gives an empty one."""
    base, found = hits(docs.select("doc_id", "text", F.xxhash64("text").alias("_d")), benchmark, width, carry=("doc_id", "_d"))
    id_, digest = free_name(docs.columns, "_id"), free_name(docs.columns, "_digest")
    bad = base.join(found.select("_uid").distinct(), "_uid", "left_semi").select(F.col("doc_id").alias(id_), F.col("_d").alias(digest)).distinct()
    return docs.join(stage(bad, "op8-bad"), docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(digest)), "left_anti")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """_uid, doc_id, n_words, n_hit, items (sorted strings), spans for each row of docs.

    Null and empty texts have no words.  Repeated rows are judged one by one.  An empty benchmark hits nothing.
    A document's spans and items are gathered in its row: they are bounded by its own words.
    """
    base, found = hits(docs, benchmark, width)
    per_doc = found.groupBy("_uid").agg(
        F.collect_set(F.struct("start", "length")).alias("spans"),
        F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_set("items")), lambda i: i.cast("string")))).alias("items"))
    out = base.join(per_doc, "_uid", "left")
    return out.select(
        "_uid", "doc_id", "n_words", F.coalesce(covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")
