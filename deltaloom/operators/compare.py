"""Comparisons of keyed relations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.operators.numbering import parallelism

#: Hashes of a digest that travel as one row, 4 KB.
BLOCK = 128


def long_form(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, property, hash): each column of a row as its own row, hashed as text; null hashes to null."""
    return rows.select(key, F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.sha2(F.col(c).cast("string").cast("binary"), 256))])).alias("property", "hash"))


def property_diff(stored: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Stored properties that differ live.  Driven by the stored side: a property that only the live side has
    never differs, one that it lacks has a null hash."""
    return (
        stored.join(live.withColumnRenamed("hash", "live_hash"), [key, "property"], "left")
        .where(~F.col("hash").eqNullSafe(F.col("live_hash"))).select(key, "property", F.col("hash").alias("stored_hash"), "live_hash")
    )


def drift(stored: DataFrame, live: DataFrame, key: str, columns: list[str], unscoped: Column | None = None) -> DataFrame:
    """(key, cls, property, stored_hash, live_hash): managed rows that differ, missing and unmanaged keys, and keys that only
    live and of which the condition `unscoped` says that nobody decided about them.

    One full join on the key; rows that are equal end there, only the differing ones become rows of properties.  has_drift
    asks for managed and missing rows alone.
    """
    own, other = (x.select(key, F.struct(*columns).alias(n)) for x, n in ((stored, "_s"), (live, "_l")))
    pairs = own.join(other, key, "full").where("not _s <=> _l")
    digest_of = lambda side, c: F.sha2(F.col(f"{side}.{c}").cast("string").cast("binary"), 256)
    none = F.lit(None).cast("string")
    row = lambda cls, prop, a, b: F.struct(cls.alias("cls"), prop.alias("property"), a.alias("stored_hash"), b.alias("live_hash"))
    alone = F.when(F.col("_l").isNull(), "missing").otherwise(F.when(unscoped, "unscoped").otherwise("unmanaged") if unscoped is not None else F.lit("unmanaged"))
    both = F.filter(F.array(*[row(F.lit("managed"), F.lit(c), digest_of("_s", c), digest_of("_l", c)) for c in columns]), lambda r: ~r["stored_hash"].eqNullSafe(r["live_hash"]))
    found = F.when(F.col("_s").isNull() | F.col("_l").isNull(), F.array(row(alone, none, none, none))).otherwise(both)
    return pairs.select(key, F.explode(found).alias("r")).select(key, "r.*")


def has_drift(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.max(F.col("cls").isin("managed", "missing")), F.lit(False)).alias("has_drift"))


def baseline(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, status): equal, differs, only here, missing here."""
    digest = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    a, b = left.select(key, digest.alias("_a")), right.select(key, digest.alias("_b"))
    status = F.when(F.col("_b").isNull(), "only here").when(F.col("_a").isNull(), "missing here").when(F.col("_a") == F.col("_b"), "equal").otherwise("differs")
    return a.join(b, key, "full").select(key, status.alias("status"))


def changes(wanted: DataFrame, recorded: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): create without a record, overwrite where its digest is null, alter where it differs, none."""
    r = recorded.select(key, F.col(digest).alias("_r"), F.lit(True).alias("_has"))
    action = F.when(F.col("_has").isNull(), "create").when(F.col("_r").isNull(), "overwrite").when(F.col("_r") != F.col(digest), "alter").otherwise("none")
    return wanted.join(r, key, "left").select(key, action.alias("action"))


def path_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, path, note) over flattened relations (key, path, value): differs, absent in left, absent in right."""
    a, b = left.select(key, "path", F.col("value").alias("_a"), F.lit(1).alias("_l")), right.select(key, "path", F.col("value").alias("_b"), F.lit(1).alias("_r"))
    note = F.when(F.col("_l").isNull(), "absent in left").when(F.col("_r").isNull(), "absent in right").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return a.join(b, [key, "path"], "full").select(key, "path", note.alias("note")).where("note is not null")


def prefix_violations(base: DataFrame, head: DataFrame, pos: str, columns: list[str]) -> DataFrame:
    """Positions of an append-only log whose row is gone or changed in head: (pos, problem)."""
    a, b = (x.select(pos, F.struct(*columns).alias(n)) for x, n in ((base, "_a"), (head, "_b")))
    problem = F.when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, pos, "left").select(pos, problem.alias("problem")).where("problem is not null")


def untouched_changes(before: DataFrame, after: DataFrame, touched: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows outside `touched` that differ between two snapshots: all of them have to be equal."""
    out = lambda x: x.join(touched, key, "left_anti")
    return baseline(out(before), out(after), key, columns).where("status <> 'equal'")


def unique_pairs(gone: DataFrame, new: DataFrame, shape: list[str], key: str) -> DataFrame:
    """Rename candidates: (old, new) that are the only ones of their shape on both sides."""
    one = lambda x, n: x.groupBy(*shape).agg(F.count(F.lit(1)).alias("_c"), F.min(key).alias(n)).where("_c = 1").drop("_c")
    return one(gone, "old").join(one(new, "new"), shape)


def greedy_match(left: DataFrame, right: DataFrame, key: str, value: list[str]) -> DataFrame:
    """(left key, right key, how): first by equal key, then what is left by equal value in key order, each used once."""
    named = left.select(key).join(right.select(key), key).select(F.col(key).alias("left_key"), F.col(key).alias("right_key"), F.lit("name").alias("how"))
    rank = lambda x, n: x.select(*value, F.col(key).alias(n), F.row_number().over(Window.partitionBy(*value).orderBy(key)).alias("_n"))
    a = rank(left.join(right, key, "left_anti"), "left_key")
    b = rank(right.join(left, key, "left_anti"), "right_key")
    return named.unionByName(a.join(b, [*value, "_n"]).select("left_key", "right_key", F.lit("value").alias("how")))


def new_only(now: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    """Findings that were not there before."""
    return now.join(before, key, "left_anti")


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of a relation, whatever the order of its rows: sha256 over its rows' sha256 in order, at every size.

    A row is hashed as JSON with its nulls, so values can't run into each other.  Hashes are sorted in ranges and put
    together to blocks, in parallel; blocks are runs of one order, so they sort as their bytes do.  The last step, as sha256
    goes from front to back, is one task: 32 bytes for each row pass through it, a batch at a time.
    """
    hashed = rows.select(F.unhex(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)).alias("h"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"block": pa.array([b"".join(found[i:i + BLOCK]) for i in range(0, len(found), BLOCK)], pa.binary())})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, some = hashlib.sha256(), False
        for batch in batches:
            for block in batch.column(0).to_pylist():
                state.update(block.hex().encode())
                some = True
        yield pa.RecordBatch.from_pydict({"digest": pa.array([state.hexdigest() if some else None], pa.string())})

    runs = hashed.repartitionByRange(parallelism(rows.sparkSession), "h").sortWithinPartitions("h").mapInArrow(blocks, "block binary")
    return runs.repartition(1).sortWithinPartitions("block").mapInArrow(whole, "digest string").agg(F.max("digest").alias("digest"))


def mark_dropped(stored: DataFrame, gone: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Rows of gone keys get the status dropped; nothing is ever deleted."""
    marked = gone.select(key, F.lit(True).alias("_gone")).distinct()
    return stored.join(marked, key, "left").withColumn(status, F.when(F.col("_gone"), "dropped").otherwise(F.col(status))).drop("_gone")


def renamed_items(left: DataFrame, right: DataFrame, key: str, value: list[str], name: str) -> DataFrame:
    """(left name, right name) of items that hold the same value under another name: pairs by name go first, the rest pair by
    value in the order of names, each once.  A pair is a rename, not a difference."""
    pairs = greedy_match(left.withColumnRenamed(name, "_n"), right.withColumnRenamed(name, "_n"), "_n", [key, *value])
    return pairs.where("how = 'value'").select(F.col("left_key").alias("old"), F.col("right_key").alias("new"))


def aligned(live: DataFrame, declared: DataFrame, key: list[str]) -> DataFrame:
    """Live rows whose sub-object somebody declared; the others are not compared."""
    return live.join(declared.select(*key).distinct(), key, "left_semi")


def read_back(stored: DataFrame, live: DataFrame, key: str, skip: DataFrame, gone: DataFrame) -> DataFrame:
    """`property_diff` without the properties that a reader skips, and one row for each object that is gone or unsupported."""
    rows = property_diff(stored.join(skip, "property", "left_anti").join(gone, key, "left_anti"), live.join(skip, "property", "left_anti"), key)
    whole = gone.join(stored.select(key).distinct(), key, "left_semi").select(
        key, F.lit("*").alias("property"), F.lit(None).cast("string").alias("stored_hash"), F.lit(None).cast("string").alias("live_hash")).distinct()
    return rows.unionByName(whole)


def upsert(stored: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Last writer wins: for each key the row of the highest version, the incoming one where equal."""
    tagged = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return tagged.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_new")


def overlay(old: DataFrame, new: DataFrame, scope: str, value) -> DataFrame:
    """A snapshot in which one scope's rows come from new and the others from old."""
    return old.where(F.col(scope) != value).unionByName(new.where(F.col(scope) == value))
